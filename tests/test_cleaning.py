import math
import random

import pytest
from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    fill_truncated_mean,
    fill_truncated_min,
    log_scale,
    matching,
    scale_by_max,
)
from starfold.sources import reject_count


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_amount_unit_is_cut_not_scaled(spark):
    df = spark.createDataFrame(
        [(1, "100万元"), (2, "250.5"), (3, "abc"), (4, None), (5, "nan"), (6, "1万元x"), (7, ""), (8, "1.0d"), (9, " -1.5e2 ")],
        "EID int, a string",
    ).coalesce(1)
    assert column(df, fn.parse_amount("a")) == [100.0, 250.5, None, None, None, None, None, None, -150.0]
    assert reject_count(df, "a", fn.parse_amount("a")).first()[0] == 5
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(fn.parse_amount("a", strict=True)).collect()


def test_filter_drops_null_and_log_has_no_value_below_minus_one(spark):
    df = spark.createDataFrame([(10.0,), (90000.0,), (None,), (0.0,), (-1.0,), (-5.0,)], "z double")
    assert sorted(column(df.where(F.col("z") < 90000), "z")) == [-5.0, -1.0, 0.0, 10.0]
    logs = {r.z: r.l for r in df.select("z", fn.log1p_or_null("z").alias("l")).collect()}
    assert logs[-1.0] is None and logs[-5.0] is None and logs[0.0] == 0.0
    assert logs[10.0] == pytest.approx(math.log1p(10))


def test_date_pieces(spark):
    df = spark.createDataFrame([("2016-03",), ("2016/03/01",), ("2016",), (None,), ("x-y",)], "d string")
    df = df.coalesce(1)
    assert column(df, fn.date_piece("d", 1)) == [2016, None, 2016, None, None]
    assert column(df, fn.date_piece("d", 2)) == [3, None, None, None, None]
    assert column(df, fn.date_piece("d", 1, "/")) == [None, 2016, 2016, None, None]


def test_rounding_is_half_even_and_threshold_strict(spark):
    df = spark.createDataFrame([(0.123456785,), (0.222,), (0.22200001,), (1e-8,)], "p double").coalesce(1)
    rounded = df.select(fn.round_half_even("p").alias("p"))
    assert column(rounded, "p") == [0.12345678, 0.222, 0.22200001, 1e-8]
    assert column(rounded, fn.decision("p", 0.222)) == [0, 0, 1, 0]


def test_probability_text_is_the_shortest_decimal(spark):
    random.seed(3)
    values = [0.0, 1.0, 0.5, 1e-8, 1.2e-7, 9.99e-6, 1e-4, 9.999e-5, 0.001, 0.1, 0.99999999]
    values += [round(random.random() * 10 ** -random.randint(0, 7), 8) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "p double").coalesce(1)
    assert column(df, fn.probability_text("p")) == [str(v) for v in values]


def test_ratio_and_flags(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double").coalesce(1)
    assert column(df, fn.ratio("a", "b")) == [None, None, 1.5]
    assert column(df, fn.flag(F.col("b") > 1)) == [0, 0, 1]
    assert column(df, fn.replace_value("a", 1.0, -1.0)) == [-1.0, -1.0, 3.0]
    assert column(df, fn.fill_from("b", "a")) == [0.0, 1.0, 2.0]


def test_fills_are_truncated_toward_zero(spark):
    df = spark.createDataFrame([(1.0,), (4.9,), (None,), (-1.7,)], "x double").coalesce(1)
    assert column(fill_truncated_mean(df, "x"), "x") == [1.0, 4.9, 1.0, -1.7]
    assert column(fill_truncated_min(df, "x"), "x") == [1.0, 4.9, -1.0, -1.7]


def test_numeric_fill_keeps_types_and_skips_text(spark):
    df = spark.createDataFrame([(None, None, None)], "k long, i int, s string")
    out = fn.fill_numeric(df, -999, skip=["k"])
    assert out.dtypes == df.dtypes
    assert tuple(out.first()) == (None, -999, None)


def test_scaling(spark):
    df = spark.createDataFrame([(3.0,), (None,), (0.0,), (-2.0,)], "x double").coalesce(1)
    assert column(scale_by_max(df, "x"), "x") == [1.0, None, 0.0, -2.0 / 3.0]
    top = math.log1p(3)
    scaled = column(log_scale(df, "x", fill="mean"), "x")
    mean = math.trunc((top + 0.0) / 2)
    assert scaled == pytest.approx([1.0, mean / top, 0.0, mean / top])


def test_scaling_by_a_zero_maximum_gives_null(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert column(scale_by_max(df, "x"), "x") == [None, None]


def test_matching_keeps_repeated_rows_once_each(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "EID int, v string")
    right = spark.createDataFrame([(1,), (1,), (1,), (3,)], "EID int")
    assert sorted(column(matching(left, right, "EID"), "v")) == ["a", "b"]
