import math
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from starfold.models import (
    DEPTH_SIX,
    FEW_LEAVES,
    MANY_LEAVES,
    BoostedClassifier,
    BoostSettings,
    Stack,
    area_under_roc,
    areas_under_roc,
    best_round,
    feature_map,
    feature_vector,
    gain_importance,
    metric_history,
    out_of_fold,
    prefix_model,
    split_importance,
    submission,
    top_features,
)
from starfold.models import boosting
from starfold.models.boosting import round_metrics
from starfold.models.stack import fold_mean
from starfold.operators import exact_folds
from starfold.session import materialize

NAMES = ["x", "y", "noise"]
SMALL = BoostSettings(rounds=5, learning_rate=0.3, depth=2, row_share=0.8, feature_share=0.9)


@pytest.fixture(scope="module")
def rows(spark):
    """A planted signal: the label follows x + y, with some noise."""
    rng = np.random.default_rng(5)
    x, y, z = rng.random(400), rng.random(400), rng.random(400)
    label = (x + y + 0.3 * rng.standard_normal(400) > 1).astype(int)
    data = [(i, int(t), float(a), float(b), float(c)) for i, (t, a, b, c) in enumerate(zip(label, x, y, z))]
    df = spark.createDataFrame(data, "EID long, TARGET int, x double, y double, noise double")
    return materialize(exact_folds(feature_vector(df.repartition(4), NAMES), "EID", 3), "rows")


@pytest.fixture(scope="module")
def fitted(rows):
    return BoostedClassifier(SMALL).fit(rows.where("fold > 0"), rows.where("fold = 0"))


def auc_by_pairs(pairs):
    up = [s for t, s in pairs if t == 1]
    down = [s for t, s in pairs if t == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in up for b in down)
    return wins / (len(up) * len(down))


def test_depth_from_leaves():
    assert MANY_LEAVES.tree_depth() == 7
    assert FEW_LEAVES.tree_depth() == 4
    assert DEPTH_SIX.tree_depth() == 6


def test_best_round_is_patient():
    assert best_round([3, 2, 2.5, 2.4, 1], patience=2, larger_is_better=False) == 2
    assert best_round([3, 2, 2.5, 2.4, 1], patience=3, larger_is_better=False) == 5
    assert best_round([0.5, 0.7, 0.7], patience=50, larger_is_better=True) == 2
    assert best_round([], patience=1, larger_is_better=True) == 0


def test_prefix_equals_a_shorter_fit(rows):
    train = rows.where("fold > 0").select("features", F.col("TARGET").cast("double").alias("TARGET"))
    long = SMALL.with_(row_share=1.0).estimator("features", "TARGET").fit(train)
    short = SMALL.with_(row_share=1.0, rounds=3).estimator("features", "TARGET").fit(train)
    cut = prefix_model(long, 3)
    assert cut.getNumTrees == 3
    held = rows.where("fold = 0")
    a = [r.probability[1] for r in cut.transform(held).orderBy("EID").collect()]
    b = [r.probability[1] for r in short.transform(held).orderBy("EID").collect()]
    assert a == pytest.approx(b, abs=1e-12)


def test_scores_are_probabilities_and_repeatable(rows, fitted):
    held = rows.where("fold = 0")
    first = {r.EID: r.score for r in fitted.predict(held).collect()}
    again = BoostedClassifier(SMALL).fit(rows.where("fold > 0"), held)
    second = {r.EID: r.score for r in again.predict(held).collect()}
    assert first == second
    assert all(0 < p < 1 for p in first.values())
    assert set(fitted.predict(held).columns) == {*held.columns, "score"}
    with pytest.raises(ValueError):
        BoostedClassifier(SMALL).get_model()


def test_area_under_roc_counts_ties_half(spark, rows, fitted):
    pairs = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9), (1, 0.2)]
    df = spark.createDataFrame(pairs, "t int, s double")
    assert area_under_roc(df, "t", "s") == pytest.approx(auc_by_pairs(pairs))
    scored = fitted.predict(rows.where("fold = 0"))
    got = area_under_roc(scored, "TARGET", "score")
    assert got == pytest.approx(auc_by_pairs([(r.TARGET, r.score) for r in scored.collect()]))
    assert got > 0.7


def test_history_by_hand(spark, rows):
    model = BoostedClassifier(SMALL).fit(rows.where("fold > 0")).get_model()
    held = rows.where("fold = 0").select("features", F.col("TARGET").cast("double").alias("TARGET"))
    losses = round_metrics(model, held, "TARGET")
    assert len(losses) == 5
    for n in (1, 5):
        scored = prefix_model(model, n).transform(held).collect()
        by_hand = [
            -math.log(r.probability[1] if r.TARGET == 1 else r.probability[0]) for r in scored
        ]
        # The training loss is twice the log loss of the probability.
        assert losses[n - 1] == pytest.approx(2 * np.mean(by_hand))
    for chunk in (2, 25):
        areas = round_metrics(model, held, "TARGET", "areaUnderROC", chunk=chunk)
        for n in (1, 5):
            scored = prefix_model(model, n).transform(held).collect()
            pairs = [(r.TARGET, r.probability[1]) for r in scored]
            assert areas[n - 1] == pytest.approx(auc_by_pairs(pairs))
    table = metric_history(spark, losses)
    assert [r["round"] for r in table.orderBy("round").collect()] == [1, 2, 3, 4, 5]


def test_patience_ends_the_history_early(rows):
    model = BoostedClassifier(SMALL).fit(rows.where("fold > 0")).get_model()
    held = rows.where("fold = 0").select("features", F.col("TARGET").cast("double").alias("TARGET"))
    full = round_metrics(model, held, "TARGET", "areaUnderROC", chunk=1)
    for patience in (1, 2):
        short = round_metrics(model, held, "TARGET", "areaUnderROC", patience, chunk=1)
        assert full[: len(short)] == short
        assert best_round(short, patience, True) == best_round(full, patience, True)


@pytest.mark.parametrize("shares", [(0.8, 0.9), (0.8, 0.6), (0.6, 0.4)])
def test_prefix_equals_a_shorter_fit_with_sampling(rows, shares):
    train = rows.where("fold > 0").select("features", F.col("TARGET").cast("double").alias("TARGET"))
    settings = SMALL.with_(row_share=shares[0], feature_share=shares[1], rounds=6)
    long = settings.estimator("features", "TARGET").fit(train)
    short = settings.with_(rounds=3).estimator("features", "TARGET").fit(train)
    held = rows.where("fold = 0")
    a, b = ([r.probability[1] for r in m.transform(held).orderBy("EID").collect()] for m in (prefix_model(long, 3), short))
    assert a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("metric", ["logLoss", "areaUnderROC"])
def test_patience_ends_training(rows, monkeypatch, metric):
    """Fewer rounds than asked are trained, and the model kept is that of a full training."""
    from starfold.models import boosting

    monkeypatch.setattr(boosting, "FIRST_ROUNDS", 4)
    train, held = rows.where("fold > 0"), rows.where("fold = 0")
    settings = SMALL.with_(rounds=64, patience=3, depth=3, learning_rate=1.0)
    model = BoostedClassifier(settings, metric=metric).fit(train, held)
    assert model.trained_rounds < 64
    full = BoostedClassifier(settings.with_(rounds=model.trained_rounds)).fit(train).get_model()
    columns = held.select("features", F.col("TARGET").cast("double").alias("TARGET"))
    history = round_metrics(full, columns, "TARGET", metric)
    assert model.get_model().getNumTrees == best_round(history, 3, metric != "logLoss")
    assert model.history == pytest.approx(history[: len(model.history)])
    assert len(model.train_history) == model.get_model().getNumTrees


def test_areas_in_one_pass(spark, rows, fitted):
    scored = fitted.predict(rows).withColumn("tied", F.round("score", 1)).withColumn("far", (F.col("score") - 0.5) * 900)
    pairs = scored.select("TARGET", "score", "tied", "far").collect()
    want = [auc_by_pairs([(r.TARGET, r[c]) for r in pairs]) for c in ("score", "tied", "far")]
    for buckets in (1, 7, 4096):
        assert areas_under_roc(scored, "TARGET", ["score", "tied", "far"], buckets) == pytest.approx(want)


def test_tolerance_stops_training(rows):
    train, held = rows.where("fold > 0"), rows.where("fold = 0")
    eager = BoostedClassifier(SMALL.with_(rounds=20, tolerance=0.5)).fit(train, held)
    strict = BoostedClassifier(SMALL.with_(rounds=20, tolerance=0.0)).fit(train, held)
    assert eager.get_model().getNumTrees < strict.get_model().getNumTrees
    assert len(eager.history) == len(eager.train_history) == eager.get_model().getNumTrees
    assert area_under_roc(strict.predict(held), "TARGET", "score") > 0.7


def test_split_importance_counts_the_printed_splits(fitted):
    model = fitted.get_model()
    used = [int(i) for i in re.findall(r"If \(feature (\d+)", model.toDebugString)]
    want = {NAMES[i]: used.count(i) / len(used) for i in set(used)}
    table = split_importance(model, NAMES)
    got = [(r.feature, r.fscore) for r in table.collect()]
    assert dict(got) == pytest.approx(want)
    assert got == sorted(got, key=lambda r: (r[1], r[0]))
    assert [r.feature for r in top_features(table, 1).collect()] == [got[-1][0]] or (
        got[-1][1] == got[-2][1]
    )
    assert sum(r.fscore for r in gain_importance(model, NAMES).collect()) == pytest.approx(1)


def test_feature_map_follows_the_vector(spark):
    assert [tuple(r) for r in feature_map(spark, NAMES).orderBy("index").collect()] == [
        (0, "x", "q"), (1, "y", "q"), (2, "noise", "q")
    ]


@pytest.fixture(scope="module")
def stacked(rows):
    return out_of_fold(rows, [SMALL, SMALL.with_(depth=1)], folds=3)


def test_out_of_fold_scores_come_from_other_folds(rows, stacked):
    scores, models = stacked
    got = {r.EID: (r.fold, r.score_0, r.score_1) for r in scores.collect()}
    assert len(got) == 400 and scores.count() == 400
    for m in range(2):
        for i in range(3):
            held = models[m][i].predict(rows.where(F.col("fold") == i)).collect()
            assert all(got[r.EID][0] == i and got[r.EID][1 + m] == r.score for r in held)


def test_fold_mean_is_the_mean_over_fold_models(rows, stacked):
    _, models = stacked
    sample = rows.where("EID < 20")
    got = {r.EID: r.score_1 for r in fold_mean(sample, models).collect()}
    parts = [{r.EID: r.score for r in m.predict(sample).collect()} for m in models[1]]
    for key, value in got.items():
        assert value == pytest.approx(sum(p[key] for p in parts) / 3)


def test_stack_scores_every_row_once(rows):
    stack = Stack([SMALL, SMALL.with_(depth=1)], SMALL.with_(rounds=2), folds=3).fit(rows)
    assert stack.oof.count() == 400
    scored = stack.predict(rows.drop("TARGET"))
    out = submission(scored, 0.34)
    assert out.columns == ["EID", "FORTARGET", "PROB"]
    assert out.select("EID").distinct().count() == out.count() == 400
    assert area_under_roc(scored.join(rows.select("EID", "TARGET"), "EID"), "TARGET", "score") > 0.7


def test_submission_keeps_one_row_per_key(spark):
    rows = [(1, 0.22200001, 1), (1, 0.9, 2), (2, 0.222, 1), (3, 1e-8, 1), (4, 0.2220000049, 1)]
    df = spark.createDataFrame(rows, "EID long, score double, row_id long")
    got = sorted(map(tuple, submission(df, 0.222, order="row_id").collect()))
    assert got == [(1, 1, "0.22200001"), (2, 0, "0.222"), (3, 0, "1e-08"), (4, 0, "0.222")]
    copies = df.where("EID > 1").union(df.where("EID > 1"))
    assert submission(copies, 0.222).count() == 3


def test_last_margins_are_not_written(spark, monkeypatch):
    """Only a chunk that another follows is written; the areas are the same."""
    rows = [(float(i * 37 % 101 > 50), Vectors.dense([i % 13, i * 7 % 29])) for i in range(300)]
    frame = spark.createDataFrame(rows, ["TARGET", "features"])
    model = BoostedClassifier(BoostSettings(rounds=5, depth=3)).fit(frame).get_model()
    written = []
    original = boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, name: written.append(name) or original(df, name))
    whole = boosting.round_metrics(model, frame, "TARGET", "areaUnderROC")
    assert len(whole) == 5 and written == []
    assert boosting.round_metrics(model, frame, "TARGET", "areaUnderROC", chunk=2) == pytest.approx(whole)
    assert len(written) == 2
