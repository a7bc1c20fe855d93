"""Deterministic hold-outs and folds.

Every choice depends only on (key, seed) through an md5 hash, so a re-run task or another cluster
size gives the same split. The plain hash forms need no shuffle at all. The exact forms also hit
exact row counts: a count per hash bucket finds the bucket holding the wanted rank, the next hash
digits split that bucket again, only what is left of it is ranked, and the resulting cut hash is
compared against every row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions.scalars import flag

_ANY = "all"


def hash_text(key: Column | str, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def hash_fold(key: Column | str, folds: int, seed: int = 2017) -> Column:
    """Fold number 0..folds-1; fold sizes are near-equal."""
    return (_number(hash_text(key, seed), 8) % folds).cast("int")


def hash_split(key: Column | str, share: float, seed: int) -> Column:
    """1 for about ``share`` of the keys, else 0."""
    limit = int(share * (1 << 32))
    return (_number(hash_text(key, seed), 8) < limit).cast("int")


def stratified_holdout(
    df: DataFrame,
    key: str,
    label: str,
    shares: dict,
    seed: int,
    out: str = "is_valid",
    bits: int = 16,
) -> DataFrame:
    """Mark exactly ``round(share * n)`` rows (half to even) of each label value as validation.

    ``shares`` maps label value to share; other labels are never held out.
    """
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in (str(kv[0]), float(kv[1]))])
    stratum = F.col(label).cast("string")
    wanted = F.array(F.bround(F.try_element_at(share, F.col("_s")) * F.col("_n"), 0).cast("long"))
    cuts = _cut_hashes(df.where(stratum.isin([str(v) for v in shares])), key, stratum, wanted, seed, bits)
    cut = F.get(F.try_element_at(cuts, stratum), 0)
    return df.withColumn(out, flag(hash_text(key, seed) <= cut))


def exact_split(
    df: DataFrame, key: str, share: float, seed: int, out: str = "is_valid", bits: int = 16
) -> DataFrame:
    """Mark exactly ``ceil(share * n)`` rows as validation."""
    wanted = F.array(F.ceil(F.lit(float(share)) * F.col("_n")).cast("long"))
    cuts = _cut_hashes(df, key, F.lit(_ANY), wanted, seed, bits)
    cut = F.get(F.try_element_at(cuts, F.lit(_ANY)), 0)
    return df.withColumn(out, flag(hash_text(key, seed) <= cut))


def exact_folds(
    df: DataFrame, key: str, folds: int, seed: int = 2017, out: str = "fold", bits: int = 16
) -> DataFrame:
    """Fold numbers whose sizes differ by at most one row; the first folds take the extra rows."""
    n = F.col("_n")
    extra = n % folds
    wanted = F.array(
        *[(F.floor(n / folds) * i + F.least(extra, F.lit(i))).cast("long") for i in range(1, folds)]
    )
    cuts = F.try_element_at(_cut_hashes(df, key, F.lit(_ANY), wanted, seed, bits), F.lit(_ANY))
    h = hash_text(key, seed)
    return df.withColumn(out, reduce(add, [flag(h > F.get(cuts, i)) for i in range(folds - 1)], F.lit(0)))


def _cut_hashes(
    df: DataFrame, key: str, stratum: Column, wanted: Column, seed: int, bits: int
) -> Column:
    """Map stratum -> hashes sitting at the wanted 1-based ranks, as a scalar subquery.

    ``wanted`` is an array over ``_n`` (rows in the stratum) and ``_s`` (its name); ranks below 1
    give no cut. A bucket table has at most 2**bits rows per stratum and cut. Buckets are split
    twice, by different hash digits, so about n / 2**(2 * bits) keys are ranked per cut: 250 of
    10**12 with the default. Copies of a key are counted together before the ranking;
    they stay on one side of the cut, so counts are exact when keys are unique.
    """
    grouped = _ranked(df, key, stratum, wanted, seed, bits)
    grouped = grouped.groupBy("_s").agg(F.sort_array(F.collect_list("_h")).alias("_cuts"))
    return grouped.agg(F.map_from_entries(F.collect_list(F.struct("_s", "_cuts")))).scalar()


def _ranked(
    df: DataFrame, key: str, stratum: Column, wanted: Column, seed: int, bits: int
) -> DataFrame:
    """(stratum, cut number, hash) at each wanted rank."""
    h = hash_text(key, seed)
    first = F.shiftright(_number(h, 8), 32 - bits)
    hashed = df.select(stratum.alias("_s"), first.alias("_b"), h.alias("_h"))
    counts = hashed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_s").orderBy("_b")
    totals = (
        counts.withColumn("_cum", F.sum("_c").over(upto))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy("_s")))
        .select("*", F.posexplode(wanted).alias("_i", "_rank"))
        .where((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_cum")))
        .where(F.col("_rank") > F.col("_cum") - F.col("_c"))
        .select("_s", "_b", "_i", (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_local"))
    )
    # One row per (stratum, wanted rank): bounded by the caller's parameters, not by the data.
    near = hashed.join(F.broadcast(totals), ["_s", "_b"])
    return _refined(near, bits)


def _refined(near: DataFrame, bits: int) -> DataFrame:
    """Split the chosen buckets by the digits after their own bits, then rank what is left."""
    digits = _number(F.substring("_h", 1 + bits // 4, 8), 8)
    rows = near.withColumn("_f", F.shiftright(digits, 32 - bits - bits % 4))
    counts = rows.groupBy("_s", "_i", "_local", "_f").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_s", "_i").orderBy("_f")
    counts = counts.withColumn("_cum", F.sum("_c").over(upto))
    chosen = counts.where((F.col("_cum") >= F.col("_local")) & (F.col("_cum") - F.col("_c") < F.col("_local")))
    chosen = chosen.select("_s", "_i", "_f", (F.col("_local") - F.col("_cum") + F.col("_c")).alias("_rest"))
    left = rows.join(F.broadcast(chosen), ["_s", "_i", "_f"])
    copies = left.groupBy("_s", "_i", "_rest", "_h").agg(F.count(F.lit(1)).alias("_m"))
    place = F.sum("_m").over(Window.partitionBy("_s", "_i").orderBy("_h"))
    reached = copies.withColumn("_place", place).where(F.col("_place") >= F.col("_rest"))
    return reached.where(F.col("_place") - F.col("_m") < F.col("_rest")).select("_s", "_i", "_h")
