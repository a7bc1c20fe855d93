import math

import pytest
from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    FeatureBlock,
    align,
    anti,
    assemble,
    attach,
    base_rate,
    coverage,
    distinct_ids,
    stack_rows,
    unique_rows,
)


def by_key(df, key="EID"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_rates_of_null_groups_stay_null(spark):
    rows = [(1, None, 2010), (1, None, 2012), (2, 1, 2011), (2, 0, None), (2, None, 2015)]
    df = spark.createDataFrame(rows, "EID int, home int, y int")
    features = {
        "rate": fn.flag_rate("home"),
        "n": fn.present("home"),
        "rows": fn.row_count(),
        "last": fn.latest("y"),
        "first": fn.earliest("y"),
        "span": fn.year_span("y"),
        "mean": fn.truncated_mean("y"),
    }
    got = by_key(FeatureBlock("b", df, features).build())
    assert got[1] == {"EID": 1, "rate": None, "n": 0, "rows": 2, "last": 2012, "first": 2010,
                      "span": 2, "mean": 2011}
    assert got[2] == {"EID": 2, "rate": 0.5, "n": 2, "rows": 3, "last": 2015, "first": 2011,
                      "span": 4, "mean": 2013}


def test_all_null_sum_is_zero_and_mean_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 0.1), (2, 0.2)], "EID int, x double")
    features = {"sum": fn.total_of("x"), "n": fn.present("x"), "mean": fn.mean_of("x")}
    got = by_key(FeatureBlock("b", df, features).build())
    assert got[1] == {"EID": 1, "sum": 0.0, "n": 0, "mean": None}
    assert got[2] == {"EID": 2, "sum": pytest.approx(0.3), "n": 2, "mean": pytest.approx(0.15)}


def test_sums_drop_no_digit_and_have_no_limit(spark):
    rows = [(1, 0.004)] * 3 + [(2, 1e12), (2, 1e12 + 0.25), (3, float("nan")), (3, 1.0), (4, 1e300)]
    df = spark.createDataFrame(rows, "EID int, x double")
    got = by_key(FeatureBlock("b", df, {"sum": fn.total_of("x"), "mean": fn.mean_of("x")}).build())
    assert got[1]["sum"] == pytest.approx(0.012, rel=1e-12) and got[1]["mean"] == pytest.approx(0.004, rel=1e-12)
    assert got[2]["sum"] == 2e12 + 0.25 and got[4]["sum"] == 1e300
    assert math.isnan(got[3]["sum"]) and math.isnan(got[3]["mean"])
    exact = df.where("EID < 3").selectExpr("EID", "cast(x as decimal(38, 18)) as x")
    got = by_key(FeatureBlock("b", exact, {"sum": fn.total_of("x")}).build())
    assert got[1]["sum"] == 0.012 and got[2]["sum"] == 2e12 + 0.25


def test_null_keys_make_no_entity(spark):
    df = spark.createDataFrame([(None, 1), (1, 1)], "EID int, x int")
    assert list(by_key(FeatureBlock("b", df, {"n": fn.row_count()}).build())) == [1]


def test_latest_row_and_largest_month_differ(spark):
    rows = [(1, 1, 2014, 12, "old"), (1, 2, 2016, 1, "a"), (1, 3, 2016, 1, "b"), (1, 4, 2015, 7, "c")]
    df = spark.createDataFrame(rows, "EID int, row_id long, y int, m int, v string")
    place = fn.order_key("y", "m", "row_id")
    features = {
        "v": fn.carry_latest("v", place),
        "last_month": fn.carry_latest("m", place),
        "top_month": fn.biggest("m"),
        "first": fn.carry_first("v", "row_id"),
    }
    got = by_key(FeatureBlock("b", df, features).build())[1]
    assert got == {"EID": 1, "v": "b", "last_month": 1, "top_month": 12, "first": "old"}


def test_order_key_sorts_like_the_triple(spark):
    big = 9223372036854775807
    rows = [(2000, 1, big), (2000, 2, -big), (2000, 2, 0), (1999, 12, big), (2001, 1, -5)]
    df = spark.createDataFrame(rows, "y int, m int, t long")
    got = [tuple(r) for r in df.orderBy(fn.order_key("y", "m", "t")).collect()]
    assert got == sorted(rows)


def test_carried_null_is_kept(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, None, 2)], "EID int, x double, row_id long")
    out = FeatureBlock("b", df, {"x": fn.carry_latest("x", F.col("row_id"))}).build()
    assert by_key(out)[1]["x"] is None


def test_share_of_entity_without_any_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "d"), (2, None)], "EID int, d string")
    out = FeatureBlock("b", df, {"s": fn.share_where(F.col("d").isNotNull())}).build()
    assert {k: v["s"] for k, v in by_key(out).items()} == {1: 0.0, 2: 0.5}


def test_category_counts_add_up_to_the_known_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, None)], "EID int, c string")
    counts = fn.category_counts("c", ["a", "b"], "C")
    got = by_key(FeatureBlock("b", df, counts | {"known": fn.present("c")}).build())
    assert got[1] == {"EID": 1, "C_a": 1, "C_b": 1, "known": 2}
    assert got[2] == {"EID": 2, "C_a": 0, "C_b": 0, "known": 0}
    with_null = fn.category_counts("c", ["a", None], "C", names=["C_0", "C_1"], null_category=True)
    assert by_key(FeatureBlock("b", df, with_null).build())[1]["C_1"] == 1
    with pytest.raises(ValueError):
        fn.category_counts("c", [None], "C")


def test_scaled_and_derived_features(spark):
    df = spark.createDataFrame([(1, "x")] * 3 + [(2, "x")], "EID int, c string")
    block = FeatureBlock(
        "b", df, {"n": fn.present("c")}, scaled={"share": "n"}, derived={"bin": fn.log_bin("n")},
        drop=("n",),
    )
    assert by_key(block.build()) == {
        1: {"EID": 1, "share": 1.0, "bin": 1},
        2: {"EID": 2, "share": 1 / 3, "bin": 0},
    }


def test_duplicate_entity_raises(spark):
    good = spark.createDataFrame([(1, 2.0), (2, 3.0)], "EID int, x double")
    assert unique_rows(good, "EID").count() == 2
    bad = good.union(spark.createDataFrame([(2, 4.0)], good.schema))
    with pytest.raises(Exception, match="duplicate EID: 2"):
        unique_rows(bad, "EID").collect()


def test_assembly_keeps_the_spine_and_fills(spark):
    spine = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "EID int, TARGET int")
    block = spark.createDataFrame([(1, 5.0), (9, 1.0)], "EID int, x double")
    got = by_key(assemble(spine, [block], fill=-999, skip=["TARGET"]))
    assert got == {
        1: {"EID": 1, "TARGET": 1, "x": 5.0},
        2: {"EID": 2, "TARGET": None, "x": -999.0},
        3: {"EID": 3, "TARGET": 0, "x": -999.0},
    }


def test_profile(spark):
    a = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "EID int, TARGET int")
    b = spark.createDataFrame([(2,), (3,), (3,)], "EID int")
    assert tuple(base_rate(a).first()) == (3, 1, 1 / 3)
    assert distinct_ids([a, b], "EID").first()[0] == 3
    assert tuple(coverage(b, "EID", a, "EID").first()) == (2, 2, 1.0)
    assert sorted(r.EID for r in anti(a, b, "EID").collect()) == [1]
    assert stack_rows(a, b).count() == 6


def test_attach_small_and_large_lookup_agree(spark):
    df = spark.range(0, 900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    lookup = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = attach(df, lookup, "k", small_rows=10_000)
    large = attach(df, lookup, "k", small_rows=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
