"""Plans and results that must hold when one key owns a third of the rows."""

import pytest
from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import FeatureBlock, assemble, matching
from starfold.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
HOT, ROWS = 7, 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """Row i belongs to key 7 when i is a multiple of three."""
    i = F.col("id")
    return spark.range(0, ROWS, 1, 12).select(
        F.when(i % 3 == 0, F.lit(HOT)).otherwise(i % 501).alias("EID"),
        i.alias("row_id"),
        (i % 100 / 100).alias("x"),
        F.concat(F.lit("c"), (i % 4).cast("string")).alias("c"),
        (2000 + i % 15).cast("int").alias("y"),
        (1 + i % 12).cast("int").alias("m"),
    )


def expected():
    groups = {}
    for i in range(ROWS):
        groups.setdefault(HOT if i % 3 == 0 else i % 501, []).append(i)
    out = {}
    for key, ids in groups.items():
        last = max(ids, key=lambda i: (2000 + i % 15, 1 + i % 12, i))
        out[key] = (
            len(ids),
            round(sum(i % 100 for i in ids) / 100, 2),
            sum(i % 4 == 1 for i in ids),
            last,
            min(ids),
        )
    return out


def block(df):
    features = {
        "n": fn.row_count(),
        "total": fn.total_of("x"),
        "last": fn.carry_latest("row_id", fn.order_key("y", "m", "row_id")),
        "first": fn.carry_first("row_id", "row_id"),
    }
    return FeatureBlock("hot", df, features | fn.category_counts("c", ["c1"], "C")).build()


def test_hot_key_block_is_whole(hot):
    got = {r.EID: (r.n, round(r.total, 2), r.C_c1, r["last"], r["first"]) for r in block(hot).collect()}
    assert got == expected()


def test_hot_key_is_combined_before_the_shuffle(hot):
    """Every map task sends at most one row per key."""
    plan = block(hot)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "partial_sum" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_hot_key_joins_do_not_fan_out(spark, hot):
    spine = spark.range(0, 600).select(F.col("id").alias("EID"))
    wide = assemble(spine, [block(hot), block(hot).withColumnsRenamed({c: f"b_{c}" for c in
                    ("n", "total", "last", "first", "C_c1")})], fill=-999)
    assert wide.count() == 600
    assert wide.agg(F.sum(F.when(F.col("n") > 0, F.col("n")))).first()[0] == ROWS - sum(
        len_ for key, (len_, *_) in expected().items() if key >= 600
    )
    assert matching(hot, hot, "EID").count() == ROWS


def test_star_join_shuffles_the_spine_once(spark):
    """Four joins on one key: one exchange per side and none between the joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["star_assembly"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Spine, orders, events and the order lines (per order, its owners, per customer).
    assert plan.count("Exchange hashpartitioning") == 6
    assert plan.count("SortMergeJoin") == 4


def test_scaled_block_reads_its_source_once(spark):
    """Order lines and orders are joined once, while the block is written."""
    from starfold.operators import blocks

    plans = []
    original = blocks.materialize

    def watched(df, name, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, name, by)

    blocks.materialize = watched
    try:
        df = QUERIES["company_branch_base"](spark, FOLDER)
    finally:
        blocks.materialize = original
    after = df._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and plans[0].count("lineitem.parquet") == 1 and "lineitem.parquet" not in after


FITS_MODELS = {"oof_rows", "run_rows", "gbt_stump", "gbt_stump_reload", "gbt_cells", "patience_stop", "write_cells_importance"}
FITS_MODELS |= {name for name in ORACLES if name.startswith("cells_")}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "SortAggregate")


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FITS_MODELS))
def test_plan_has_no_slow_operator(spark, name):
    """No all-pairs join, no Python row function and no sort-based aggregation, whatever the size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [bad for bad in FORBIDDEN if bad in plan] == []
