"""The stacks of the queries train their presets in full, whatever rounds that takes."""

from pyspark.sql import functions as F

from starfold.models import DEPTH_SIX, MANY_LEAVES, Stack
from starfold.models.stack import TASK_ROWS, _few_tasks
from starfold.plans.runs import RUNS
from starfold.queries import QUERIES, learning


def test_oof_stack_asks_for_every_round(spark, monkeypatch, tmp_path):
    docs = [(i, "a b c" * (i % 5 + 1), "de" if i % 2 else "en", "web", 10 + i) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    labels = [(i, i % 2, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    asked = []

    class Seen(Stack):
        def fit(self, train):
            asked.extend([*self.base, self.blender])
            self.oof = train.withColumns({"score_0": F.lit(0.5), "score_1": F.lit(0.5)})
            return self

    monkeypatch.setattr(learning, "Stack", Seen)
    monkeypatch.setattr(learning, "_FITTED", {})
    assert QUERIES["oof_stack"](spark, str(tmp_path)).count() == 20
    assert asked == [MANY_LEAVES, DEPTH_SIX, MANY_LEAVES]
    assert [s.rounds for s in asked] == [1000, 800, 1000] and {s.patience for s in asked} == {50}


def test_run_stacked_asks_for_every_round(spark, monkeypatch):
    ran = []

    class Scored:
        submission = spark.range(1)

    monkeypatch.setattr(learning.bindings, "company_star", lambda *_: {})
    monkeypatch.setattr(learning, "score_companies", lambda star, run: ran.append(run) or Scored)
    monkeypatch.setattr(learning, "_FITTED", {})
    assert QUERIES["run_stacked"](spark, "anywhere").count() == 1
    assert ran == [RUNS["stacked"]]
    assert [m.rounds for m in ran[0].models] == [1000, 800]


def test_few_rows_are_read_by_few_tasks(spark):
    rows = spark.range(0, 100, 1, 8)
    assert _few_tasks(rows, 100).rdd.getNumPartitions() == 1
    assert sorted(r.id for r in _few_tasks(rows, 100).collect()) == list(range(100))
    assert _few_tasks(rows, 2 * TASK_ROWS + 1).rdd.getNumPartitions() == 3
    assert _few_tasks(rows, 100 * TASK_ROWS).rdd.getNumPartitions() == 8
    assert _few_tasks(rows.limit(0), 0).count() == 0
