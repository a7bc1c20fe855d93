import hashlib

import pytest
from pyspark.sql import functions as F

from starfold.operators import (
    exact_folds,
    exact_split,
    hash_fold,
    hash_split,
    stratified_holdout,
)


def md5(key, seed):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


def lowest(keys, seed, n):
    return set(sorted(keys, key=lambda k: md5(k, seed))[:n])


@pytest.fixture(scope="module")
def spine(spark):
    rows = [(i, 1 if i < 15 else 0) for i in range(40)]
    return spark.createDataFrame(rows, "EID long, TARGET int")


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_exact_strata_round_half_even(spine, bits):
    got = stratified_holdout(spine, "EID", "TARGET", {1: 0.3, 0: 0.1}, seed=70, bits=bits)
    rows = got.collect()
    valid = {r.EID for r in rows if r.is_valid}
    assert valid == lowest(range(15), 70, 4) | lowest(range(15, 40), 70, 2)
    assert len(rows) == 40


def test_unnamed_labels_are_never_held_out(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(60)], "EID long, TARGET int")
    got = stratified_holdout(df, "EID", "TARGET", {1: 0.5}, seed=1).collect()
    assert len(got) == 60
    assert {r.TARGET for r in got if r.is_valid} == {1}


@pytest.mark.parametrize("n", [1, 7, 100])
def test_exact_split_takes_the_ceiling(spark, n):
    got = exact_split(spark.range(n).withColumnRenamed("id", "EID"), "EID", 0.3, 10000).collect()
    want = -(-3 * n // 10)
    assert {r.EID for r in got if r.is_valid} == lowest(range(n), 10000, want)


@pytest.mark.parametrize("n", [3, 8, 103])
def test_exact_folds_differ_by_one_row(spark, n):
    got = exact_folds(spark.range(n).withColumnRenamed("id", "EID"), "EID", 8, bits=3).collect()
    sizes = [sum(r.fold == f for r in got) for f in range(8)]
    assert sizes == [n // 8 + (f < n % 8) for f in range(8)]
    order = [r.fold for r in sorted(got, key=lambda r: md5(r.EID, 2017))]
    assert order == sorted(order)


def test_few_rows_are_ranked_per_cut(spark):
    """The second split leaves about n / 2^(2 * bits) hashes for the ranking."""
    from starfold.operators import split

    ids = spark.range(20_000).withColumnRenamed("id", "EID")
    plan = []
    original = split._refined

    def watched(near, bits):
        plan.append(near.count())
        return original(near, bits)

    split._refined = watched
    try:
        got = exact_split(ids, "EID", 0.3, 10000, bits=2).where("is_valid = 1").count()
    finally:
        split._refined = original
    assert got == 6000 and plan[0] < 20_000 / 4 * 1.2


def test_copies_of_a_key_stay_together(spark):
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("EID"))
    for out, df in (
        ("is_valid", exact_split(ids, "EID", 0.3, 10000, bits=2)),
        ("fold", exact_folds(ids, "EID", 4, bits=4)),
    ):
        assert df.count() == 3000
        assert df.groupBy("EID").agg(F.count_distinct(out).alias("n")).agg(F.max("n")).first()[0] == 1


def test_hash_folds_do_not_depend_on_partitioning(spark):
    ids = spark.range(2000).withColumnRenamed("id", "EID")
    one = {r.EID: r.fold for r in ids.coalesce(1).withColumn("fold", hash_fold("EID", 8)).collect()}
    many = {r.EID: r.fold for r in ids.repartition(13).withColumn("fold", hash_fold("EID", 8)).collect()}
    assert one == many
    assert one == {k: int(md5(k, 2017)[:8], 16) % 8 for k in range(2000)}
    sizes = [list(one.values()).count(f) for f in range(8)]
    assert min(sizes) > 200


def test_hash_split_share(spark):
    ids = spark.range(4000).withColumnRenamed("id", "EID")
    got = ids.withColumn("v", hash_split("EID", 0.3, 5)).agg(F.avg("v")).first()[0]
    assert abs(got - 0.3) < 0.03
