"""Hold-outs, splits and folds over labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import (
    exact_folds,
    exact_split,
    hash_fold,
    hash_split,
    stratified_holdout,
)
from starfold.queries.registry import query
from starfold.sources import table


def _labels(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("EID"), F.col("quality").alias("TARGET")
    )


def _ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("EID"))


def _number_sql(seed, key="doc_id"):
    return f"cast('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 8) as bigint)"


def _holdout_sql(seed):
    return f"""with r as (
      select doc_id as EID, quality as TARGET,
             row_number() over (partition by quality order by md5(doc_id::varchar || ':{seed}')) as k,
             count(*) over (partition by quality) as n
      from labels)
    select EID, TARGET, (k <= round_even(case TARGET when 1 then 0.3 when 0 then 0.1 end * n, 0))::int as is_valid
    from r"""


@query("stratified_holdout", _holdout_sql(70))
def stratified(spark, sf):
    return stratified_holdout(_labels(spark, sf), "EID", "TARGET", {1: 0.3, 0: 0.1}, seed=70)


@query("stratified_holdout_seed40", _holdout_sql(40))
def stratified_other(spark, sf):
    return stratified_holdout(_labels(spark, sf), "EID", "TARGET", {1: 0.3, 0: 0.1}, seed=40)


@query(
    "random_split",
    f"select doc_id as EID, ({_number_sql(10000)} < {int(0.3 * (1 << 32))})::int as is_valid from documents",
)
def random_split(spark, sf):
    return _ids(spark, sf).withColumn("is_valid", hash_split("EID", 0.3, 10000))


@query(
    "random_split_exact",
    """with r as (select doc_id as EID, row_number() over (order by md5(doc_id::varchar || ':10000')) as k,
                         count(*) over () as n from documents)
       select EID, (k <= ceil(0.3 * n))::int as is_valid from r""",
)
def random_split_exact(spark, sf):
    return exact_split(_ids(spark, sf), "EID", 0.3, seed=10000)


@query("kfold_assign", f"select doc_id as EID, ({_number_sql(2017)} % 8)::int as fold from documents")
def kfold_assign(spark, sf):
    return _ids(spark, sf).withColumn("fold", hash_fold("EID", 8, 2017))


@query(
    "kfold_exact",
    """with r as (select doc_id as EID, row_number() over (order by md5(doc_id::varchar || ':2017')) - 1 as k,
                         count(*) over () as n from documents),
            s as (select EID, k, n // 8 as base, n % 8 as extra from r)
       select EID, (case when k < extra * (base + 1) then k // (base + 1)
                         else extra + (k - extra * (base + 1)) // base end)::int as fold from s""",
)
def kfold_exact(spark, sf):
    return exact_folds(_ids(spark, sf), "EID", 8, 2017)


@query(
    "fold_slices",
    f"""with f as (select doc_id, ({_number_sql(2017)} % 8)::int as fold from labels)
        select i::int as fold, count(*) filter (where f.fold <> i) as train_rows,
               count(*) filter (where f.fold = i) as valid_rows,
               sum(case when f.fold = i then doc_id end)::bigint as valid_id_sum
        from f, range(8) t(i) group by i""",
)
def fold_slices(spark, sf):
    """Row counts of every train/valid slice, from one pass over the fold sizes."""
    folds = _labels(spark, sf).withColumn("fold", hash_fold("EID", 8, 2017))
    sizes = folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("valid_rows"), F.sum("EID").alias("valid_id_sum")
    )
    total = folds.agg(F.count(F.lit(1))).scalar()
    return sizes.select(
        "fold", (total - F.col("valid_rows")).alias("train_rows"), "valid_rows", "valid_id_sum"
    )
