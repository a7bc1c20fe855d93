import pytest
from pyspark.sql import functions as F

from starfold.operators import (
    category_counts_long,
    category_vectors,
    dictionary_encode,
    first_seen_values,
    one_hot,
    vocabulary,
    wide_category_counts,
)
from starfold.operators.encode import WideCategory

ROWS = [(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "c"), (6, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "row_id long, c string")


def test_vocabulary_refuses_instead_of_dropping(df):
    assert vocabulary(df, "c") == ["a", "b", "c"]
    with pytest.raises(WideCategory):
        vocabulary(df, "c", max_values=2)
    with pytest.raises(WideCategory):
        first_seen_values(df, "c", "row_id", max_values=2)


def test_first_seen_order_includes_null(df):
    assert first_seen_values(df, "c", "row_id") == ["b", "a", None, "c"]


def test_one_hot_null_is_all_zeros_or_its_own_value(df):
    plain = {r.row_id: r for r in one_hot(df, "c").collect()}
    assert (plain[3].c_a, plain[3].c_b, plain[3].c_c) == (0, 0, 0)
    assert (plain[1].c_a, plain[1].c_b, plain[1].c_c) == (0, 1, 0)
    named = one_hot(df, "c", without=("b",), null_category="none")
    assert named.columns == ["row_id", "c_a", "c_c", "c_none"]
    assert {r.row_id for r in named.where("c_none = 1").collect()} == {3, 6}


def test_one_hot_of_doubles_has_names_without_dots(spark):
    df = spark.createDataFrame([(1.0,), (2.5,)], "ETYPE double")
    assert one_hot(df, "ETYPE").columns == ["ETYPE_1", "ETYPE_2_5"]


@pytest.mark.parametrize("small_rows", [100, 2])
def test_dictionary_codes_by_first_appearance(df, small_rows):
    got = dictionary_encode(df, "c", order="row_id", out="code", small_rows=small_rows)
    codes = {r.row_id: r.code for r in got.collect()}
    assert codes == {1: 0, 2: 1, 3: 2, 4: 0, 5: 3, 6: 2}


def test_wide_dictionary_numbers_every_value_once(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 3001).cast("string").alias("c"))
    got = dictionary_encode(df, "c", out="code", small_rows=10).distinct()
    pairs = sorted((r.c, r.code) for r in got.collect())
    assert [code for _, code in pairs] == list(range(3001))


def test_long_counts_and_vectors_have_no_limit(spark):
    df = spark.range(0, 9000).select((F.col("id") % 4).alias("EID"), (F.col("id") % 3001).cast("string").alias("c"))
    long = category_counts_long(df, "EID", "c")
    assert long.count() == 9000 - 0 * 4 and long.agg(F.sum("n")).first()[0] == 9000
    rows = category_vectors(df, "EID", "c").collect()
    values = sorted({str(i) for i in range(3001)})
    for r in rows:
        want = {}
        for i in range(9000):
            if i % 4 == r.EID:
                want[values.index(str(i % 3001))] = want.get(values.index(str(i % 3001)), 0) + 1
        assert dict(zip(r.codes, r.counts)) == want and list(r.codes) == sorted(want)


def test_wide_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None)], "EID int, c string")
    got = wide_category_counts(df, "EID", "c", ["a", "b"], "C").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0), (2, 0, 1)]
