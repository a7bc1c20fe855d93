"""Recipes learned once, kept models, sparse vectors, growing codebooks."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from starfold.models import Boosted, BoostedClassifier, BoostedModel, BoostSettings, Stacked, StackedModel, feature_vector
from starfold.operators import append_codes, codebook, exact_folds
from starfold.operators.encode import WideCategory
from starfold.operators.sparse import as_vectors, sparse_counts, sparse_parts, stored_vector, vector_entries
from starfold.plans import BASE, CARRY, STACKED, WIDE, company_matrix, feature_names
from starfold.plans.fitted import FittedRecipe, fit_recipe
from starfold.plans.runs import RUNS, KeptRun, score_companies
from starfold.session import materialize
from starfold.sources import STAR_SCHEMAS

from test_company import ROWS


@pytest.fixture(scope="module")
def star(spark):
    return tables(spark, ROWS)


def tables(spark, rows):
    schemas = {k: v for k, v in STAR_SCHEMAS.items() if k in rows}
    schemas["spine"] = STAR_SCHEMAS["train"]
    for name in ("alter", "branch"):
        schemas[name] += ", row_id long"
    return {k: spark.createDataFrame(rows[k], schemas[k]) for k in rows}


def by_company(df):
    return {r.EID: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("recipe", [BASE, CARRY, WIDE, STACKED], ids=lambda r: r.name)
def test_applied_to_what_it_learned_from_nothing_changes(spark, star, tmp_path, recipe):
    path = str(tmp_path / "recipe")
    fit_recipe(star, recipe).save(path)
    loaded = FittedRecipe.load(spark, path)
    matrix = loaded.matrix(star)
    assert matrix.columns == company_matrix(star, recipe).columns
    assert by_company(matrix) == by_company(company_matrix(star, recipe))


def later(spark):
    """Larger amounts, other categories and fewer groups than the tables learned from."""
    rows = {k: [] for k in ROWS} | {"spine": [(9, None)]}
    rows["entbase"] = [(9, 4999.0, 7.0, None, 1.0)]
    rows["alter"] = [(9, "77", "2016-03-01", "999万元", "5000", 1), (9, "01", "2016-02-01", "1", "1", 2)]
    rows["branch"] = [(9, "x", 1, 2010, None, 1)] * 5
    rows["right"] = [(9, 30, "a", "2012-03-01", None), (9, 99, "a", "2012-03-01", None), (9, 11, "a", "2012-03-01", None)]
    rows["recruit"] = [(9, "zp1", "2015-01-01", 3.0), (9, "new", "2015-01-01", 1.0)]
    return tables(spark, rows)


def test_later_data_stays_on_the_learned_scale(spark, star):
    import math

    fitted = fit_recipe(star, BASE)
    got = by_company(fitted.matrix(later(spark)))[9]
    assert got["ZCZB"] == pytest.approx(math.log(5000) / math.log(100))
    assert got["branch_count"] == 5.0  # the largest learned count is 1
    assert (got["ALTERNO_0"], got["ALTERNO_1"], got["ALTERNO_2"]) == (0, 0, 1)
    assert (got["RIGHTTYPE_11"], got["RIGHTTYPE_30"], got["WZCODE_zp1"], got["WZCODE_zp2"]) == (1, 1, 1, 0)
    assert (got["ETYPE_1"], got["right_count"], got["recruit_RECRNUM_count"]) == (0, 3, 2)
    wide = by_company(fit_recipe(star, WIDE).matrix(later(spark)))[9]
    assert wide["right"] == 1.5  # three rights, the largest learned number is two


def test_vectors_equal_the_matrix(spark, star):
    for recipe in (BASE, WIDE, STACKED):
        fitted = fit_recipe(star, recipe)
        rows, names = fitted.vectors(star)
        listing = {r["index"]: r.feature for r in names.collect()}
        assert sorted(listing) == list(range(len(listing)))
        matrix = company_matrix(star, recipe)
        assert sorted(listing.values()) == sorted(feature_names(matrix))
        want = by_company(matrix)
        for r in rows.collect():
            assert r.features.size == len(listing)
            for i, v in enumerate(r.features.toArray()):
                expected = want[r.EID][listing[i]]
                count = listing[i].startswith(("ETYPE", "ALTERNO", "RIGHTTYPE", "WZCODE"))
                assert v == pytest.approx(max(expected, 0) if count else expected)


def test_grown_recipe_keeps_old_codes(spark, star):
    fitted = fit_recipe(star, BASE)
    grown = fitted.grow(later(spark))
    old = {r.feature: r["index"] for r in fitted.vectors(star)[1].collect()}
    new = {r.feature: r["index"] for r in grown.vectors(later(spark))[1].collect()}
    assert set(new) - set(old) == {"ETYPE_7", "ALTERNO_3", "RIGHTTYPE_99", "WZCODE_new"}
    codes = {(c, r[c]): r.code for c, b in grown.books.items() for r in b.collect()}
    for c, b in fitted.books.items():
        assert all(codes[c, r[c]] == r.code for r in b.collect())
    assert by_company(grown.matrix(later(spark)))[9]["WZCODE_new"] == 1


def wide_star(spark, codes):
    rng = random.Random(codes)
    rows = {k: [] for k in ROWS}
    for e in range(160):
        good = rng.random() < 0.5
        rows["spine"].append((e, int(good) if e < 120 else None))
        rows["entbase"].append((e, float(rng.randrange(1, 900)), float(rng.randrange(codes)), 1.0, 1.0))
        rows["lawsuit"].append((e, "2014-01-01", 900.0 if good else 1.0))
        for k in range(12):
            rows["recruit"].append((e, f"s{rng.randrange(codes)}", "2015-01-01", 1.0))
            rows["right"].append((e, rng.randrange(codes), "a", "2012-03-01", None))
            rows["alter"].append((e, f"c{rng.randrange(codes)}", "2013-02-01", "1", "2", e * 100 + k))
    return tables(spark, rows)


@pytest.mark.parametrize("name", ["wide"])
def test_codes_of_any_width_are_trained_on(spark, name):
    """Over a thousand values in a column: no column per value, and the run goes through."""
    star = materialize_all(wide_star(spark, 20_000))
    run = RUNS[name].sized(rounds=2, depth=2)
    with pytest.raises(WideCategory):
        company_matrix(star, run.recipe)
    outcome = score_companies(star, run)
    assert outcome.features.count() > 3000
    assert sorted(r.EID for r in outcome.submission.collect()) == list(range(120, 160))


def materialize_all(star):
    return {k: materialize(v, k) for k, v in star.items()}


@pytest.mark.parametrize("name", ["base", "stacked"])
def test_kept_run_scores_as_before(spark, tmp_path, name):
    star = materialize_all(wide_star(spark, 5))
    outcome = score_companies(star, RUNS[name].sized(rounds=2, depth=2, folds=2))
    path = str(tmp_path / "run")
    outcome.kept.save(path)
    loaded = KeptRun.load(spark, path)
    test = dict(star, spine=star["spine"].where("TARGET is null"))
    want = sorted(map(tuple, outcome.submission.collect()))
    assert sorted(map(tuple, loaded.score(test).collect())) == want
    # One company alone is scored as among the others: nothing is learned from the tables scored.
    alone = {k: v.where("EID = 130") for k, v in star.items()}
    assert [tuple(r) for r in loaded.score(alone).collect()] == [w for w in want if w[0] == 130]
    with pytest.raises(ValueError, match="other features"):
        loaded.score(dict(test, entbase=test["entbase"].withColumn("more", F.lit(1.0))))


# models ----------------------------------------------------------------------------------------

SMALL = BoostSettings(rounds=3, learning_rate=0.3, depth=2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame([(i, int(a + b > 1), a, b) for i, a, b in data], "EID long, TARGET int, a double, b double")
    return materialize(exact_folds(feature_vector(df.repartition(3), ["a", "b"]), "EID", 3), "rows")


def scores(df):
    return {r.EID: r.score for r in df.select("EID", "score").collect()}


def test_reloaded_model_scores_alike(rows, tmp_path):
    marked = rows.withColumn("held", (F.col("fold") == 0).cast("int"))
    model = Boosted(settings=SMALL.with_(rounds=20, patience=2), validCol="held", metric="areaUnderROC").fit(marked)
    plain = BoostedClassifier(SMALL.with_(rounds=20, patience=2), metric="areaUnderROC").fit(rows.where("fold > 0"), rows.where("fold = 0"))
    path = str(tmp_path / "model")
    model.write().save(path)
    loaded = BoostedModel.load(path)
    assert scores(loaded.transform(rows)) == scores(model.transform(rows)) == scores(plain.predict(rows))
    assert loaded.fitted.history == plain.history and loaded.fitted.settings == plain.settings
    assert (loaded.uid, loaded.getOrDefault("metric")) == (model.uid, "areaUnderROC")
    with pytest.raises(Exception, match="exists"):
        model.write().save(path)
    model.write().overwrite().save(path)
    assert scores(loaded.transform(rows, {loaded.scoreCol: "score"})) == scores(model.transform(rows))


def test_reloaded_stack_scores_alike(rows, tmp_path):
    model = Stacked(base=[SMALL, SMALL.with_(depth=1)], blender=SMALL.with_(rounds=2), folds=3).fit(rows)
    path = str(tmp_path / "stack")
    model.write().save(path)
    loaded = StackedModel.load(path)
    assert len(loaded._boosters()) == 7
    assert scores(loaded.transform(rows)) == scores(model.transform(rows))


def test_model_in_a_pipeline(rows, tmp_path):
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="x"), Boosted(settings=SMALL, featuresCol="x", scoreCol="p")]
    model = Pipeline(stages=stages).fit(rows)
    path = str(tmp_path / "pipeline")
    model.write().save(path)
    first, second = (m.transform(rows).select("EID", "p").orderBy("EID").collect() for m in (model, PipelineModel.load(path)))
    assert first == second


# sparse vectors and codebooks ------------------------------------------------------------------


def test_sparse_vectors_hold_every_count(spark):
    data = [(1, "b"), (1, "b"), (1, None), (2, "a"), (2, "c"), (3, "zz"), (None, "a")]
    df = spark.createDataFrame(data, "EID long, c string")
    book = spark.createDataFrame([("a", 0), ("b", 1), (None, 2), ("c", 3)], "c string, code long")
    parts = sparse_parts(sparse_counts(df, "EID", "c", book, offset=10), "EID")
    vectors = as_vectors(parts.select("EID", stored_vector(20, F.col("indices"), F.col("values")).alias("features")))
    got = {r.EID: (r.features.size, r.features.indices.tolist(), r.features.values.tolist()) for r in vectors.collect()}
    assert got == {1: (20, [11, 12], [2.0, 1.0]), 2: (20, [10, 13], [1.0, 1.0])}
    entries = sorted(map(tuple, vector_entries(vectors, "EID", "features").collect()))
    assert entries == [(1, 11, 2.0), (1, 12, 1.0), (2, 10, 1.0), (2, 13, 1.0)]


@pytest.mark.parametrize("small_rows", [10_000, 2])
def test_codebook_only_grows(spark, small_rows):
    first = spark.createDataFrame([(1, "x"), (2, "m"), (3, None), (4, "x")], "i long, c string")
    book = materialize(codebook(first, "c", "i")[0], "book")
    more = spark.createDataFrame([(9, "k"), (5, "q"), (6, None), (7, "x"), (8, "b"), (10, "q")], "i long, c string")
    grown = append_codes(book, more, "c", "i", small_rows)
    codes = {r.c: r.code for r in grown.collect()}
    assert codes == {"x": 0, "m": 1, None: 2, "q": 3, "b": 4, "k": 5}
    assert {r.c: r.code for r in append_codes(grown, more, "c", "i").collect()} == codes
    by_value = append_codes(book.limit(0), more, "c")
    assert sorted((r.code, r.c) for r in by_value.collect() if r.c) == [(1, "b"), (2, "k"), (3, "q"), (4, "x")]
