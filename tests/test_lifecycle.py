"""Stored states, rejects, buckets, observed counts, sketches, versions, hot lookups."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    StateStore,
    attach_spread,
    distinct_sketches,
    estimates,
    hot_keys,
    merge_sketches,
    observed,
)
from starfold.plans import STACKED, WIDE, company_matrix
from starfold.plans.fitted import fit_recipe
from starfold.plans.incremental import IncrementalStar
from starfold.operators.states import StateBlock
from starfold.queries import QUERIES, company
from starfold.queries.lifecycle import order_rows, order_states
from starfold.sources import (
    STAR_FILES,
    Conflict,
    Versions,
    committed_path,
    read_csv,
    read_csv_checked,
    write_committed,
    write_scored_atomic,
)

from test_company import ROWS
from test_fitted import tables as company_tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# states ----------------------------------------------------------------------------------------


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "states"), order_states())


def sliced(spark):
    rows = order_rows(spark, FOLDER)
    return rows, [rows.where(F.pmod("o_orderkey", F.lit(5)) == i) for i in range(5)]


def rounded_features(df):
    return rows_of(df.select(*[F.round(c, 6) if t == "double" else c for c, t in df.dtypes]))


def test_states_merge_to_the_whole(spark, store):
    rows, parts = sliced(spark)
    block = order_states()
    want = rounded_features(block.finish(block.states(rows)))
    for i, part in enumerate(parts):
        store.put(f"d{i}", part)
    assert rounded_features(store.features()) == want
    store.compact()
    assert store.slices() == [f"d{i}" for i in range(5)]
    assert rounded_features(store.features()) == want
    with pytest.raises(ValueError, match="part of the base"):
        store.put("d1", parts[1])
    store.put("late", rows.limit(0))
    assert rounded_features(store.features()) == want


def test_putting_a_slice_again_replaces_it(spark, store):
    rows, parts = sliced(spark)
    for i, part in enumerate(parts):
        store.put(f"d{i}", part.limit(3) if i == 2 else part)
    store.put("d2", parts[2])
    block = order_states()
    assert rounded_features(store.features()) == rounded_features(block.finish(block.states(rows)))


def test_features_read_states_and_a_slice_reads_itself(spark, store):
    """History is not read again: the plan of a new slice has that slice, that of the features only states."""
    _, parts = sliced(spark)
    seen = []
    original = store.block.__class__.states

    def watched(self, rows):
        out = original(self, rows)
        seen.append(plan(out))
        return out

    store.block.__class__.states = watched
    try:
        for i, part in enumerate(parts):
            store.put(f"d{i}", part)
    finally:
        store.block.__class__.states = original
    assert all(p.count("Scan parquet") == 1 and "orders.parquet" in p for p in seen)
    whole = plan(store.merged())
    assert "orders.parquet" not in whole and whole.count("Scan parquet") == 5 and "SortAggregate" not in whole


def test_failed_slice_leaves_the_store(spark, store):
    _, parts = sliced(spark)
    store.put("d0", parts[0])
    before = rounded_features(store.features())
    broken = parts[1].withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.put("d1", broken)
    assert store.slices() == ["d0"] and rounded_features(store.features()) == before


@pytest.mark.parametrize("recipe", [WIDE, STACKED], ids=lambda r: r.name)
def test_company_matrix_from_slices(spark, tmp_path, recipe):
    """Rows of one company lie in several slices; the matrix is that of all rows at once."""
    star = company_tables(spark, ROWS)
    held = IncrementalStar(spark, str(tmp_path / "star"), fit_recipe(star, recipe), star)
    for i in (1, 0):
        held.put(f"d{i}", company_tables(spark, {k: [r for j, r in enumerate(v) if j % 2 == i] for k, v in ROWS.items()}))
    got, want = held.matrix(star["spine"], star["entbase"]), company_matrix(star, recipe)
    assert got.columns == want.columns
    for a, b in zip(rows_of(got), rows_of(want)):
        assert a == pytest.approx(b)
    held.stores["right"].put("d2", star["right"])
    with pytest.raises(ValueError, match="different slices"):
        held.slices()


def test_slices_put_at_once(spark, tmp_path, monkeypatch):
    """Several slices of a table are aggregated in one pass and are the slices that single puts store."""
    star = company_tables(spark, ROWS)
    fitted = fit_recipe(star, STACKED)
    number = lambda rows: F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    one, many = (IncrementalStar(spark, str(tmp_path / n), fitted, star) for n in ("one", "many"))
    for i in range(3):
        one.put(f"d{i}", {n: t.where(number(t) == i) for n, t in star.items()})
    seen, original = [], StateBlock.states
    monkeypatch.setattr(StateBlock, "states", lambda self, *args: seen.append(self.name) or original(self, *args))
    many.put_slices(["d0", "d1", "d2"], star, number)
    assert sorted(seen) == sorted(many.stores)
    assert many.slices() == one.slices() == ["d0", "d1", "d2"]
    for name, store in many.stores.items():
        content, other = (s.versions.read()["parts"] for s in (store, one.stores[name]))
        for d in content:
            assert rows_of(store._read({d: content[d]})) == rows_of(one.stores[name]._read({d: other[d]}))
    assert rows_of(many.matrix(star["spine"], star["entbase"])) == rows_of(one.matrix(star["spine"], star["entbase"]))


def test_written_star_grows_in_files(spark, tmp_path, monkeypatch):
    """A task writes a bounded number of rows; rows keep their order over the files."""
    rows = [(i % 7, i, None, f"2015-01-{i % 28 + 1:02}", "1", "2") for i in range(1000)]
    alter = spark.createDataFrame(rows, "EID long, row_id long, ALTERNO string, ALTDATE string, ALTBE string, ALTAF string")
    spine = spark.createDataFrame([(i, 1 if i else None) for i in range(7)], "EID long, TARGET int")
    monkeypatch.setattr(company.bindings, "company_star", lambda *_: {"spine": spine, "alter": alter})
    monkeypatch.setattr(company, "table", lambda *a: alter if a[2] == "orders" else spine)
    monkeypatch.setattr(company, "scratch_path", lambda *_: str(tmp_path / "csv"))
    monkeypatch.setattr(company, "CSV_ROWS", 100)
    folder = company._write_star(spark, "none")
    written = f"{folder}/{STAR_FILES['alter']}"
    assert len(list(Path(written).glob("part-*.csv"))) == 10
    read = read_csv(spark, written, "EID long, ALTDATE string", row_key="row_id").orderBy("row_id").collect()
    assert [(r.EID, r.ALTDATE) for r in read] == [(r[0], r[3]) for r in rows]


def test_wide_joins_read_less_in_a_task(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    star = company_tables(spark, ROWS)
    try:
        spark.conf.unset(size)
        company_matrix(star)
        assert spark.conf.get(size) == "16m"
        spark.conf.set(size, "32m")
        company_matrix(star)
        assert spark.conf.get(size) == "32m"
    finally:
        spark.conf.unset(size) if before is None else spark.conf.set(size, before)


# rejects ---------------------------------------------------------------------------------------


def test_rejects_say_where_and_what(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount,year\n1,5万元,2015\n2,?,2015\n3,7,20x5\n4,8\n")
    (tmp_path / "b.csv").write_text("id,amount,year\n5,,\n6,1,2,3\nx,y,z\n7,nan,2015.0\n")
    kinds = "id long, amount string, year int"
    read = read_csv_checked(spark, str(tmp_path), kinds, {"amount": fn.parse_amount("amount")})
    assert rows_of(read.accepted) == [(1, "5万元", 2015), (5, None, None), (7, "nan", 2015)]
    found = {(r.file.rsplit("/", 1)[1], r.line, r.column, r.text) for r in read.rejects.collect()}
    assert found == {
        ("a.csv", 2, "amount", "?"), ("a.csv", 3, "year", "20x5"), ("a.csv", 4, None, "4,8"),
        ("b.csv", 2, None, "6,1,2,3"), ("b.csv", 3, "id", "x"), ("b.csv", 3, "amount", "y"), ("b.csv", 3, "year", "z"),
    }
    assert "csv" not in plan(read.accepted).lower().replace("csv-", "") or "Scan parquet" in plan(read.accepted)


# buckets ---------------------------------------------------------------------------------------


def test_bucketed_star_shuffles_no_child(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["star_bucketed"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in text
    assert text.count("SelectedBucketsCount") + text.count("Bucketed: true") >= 4


# counts in passing -----------------------------------------------------------------------------


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    rows = spark.range(1000, numPartitions=4).mapInPandas(count, "id long")
    path = str(tmp_path / "out")
    seen = observed(rows, lambda df: df.write.parquet(path), rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    assert seen == {"rows": 1000, "even": 500} and passes.value == 1000
    assert spark.read.parquet(path).count() == 1000


# sketches --------------------------------------------------------------------------------------


def test_sketches_of_slices_merge(spark):
    ids = spark.range(60_000).select((F.col("id") % 20_000).alias("u"), (F.col("id") % 7).alias("day"), F.lit("x").alias("g"))
    slices = distinct_sketches(ids, ["g", "day"], "u")
    merged = estimates(merge_sketches(slices, ["g"])).first().distinct
    weeks = merge_sketches(slices.withColumn("part", F.col("day") > 2), ["g", "part"])
    assert abs(merged - 20_000) <= 600
    assert estimates(merge_sketches(weeks, ["g"])).first().distinct == merged
    assert estimates(distinct_sketches(ids.limit(0), ["g"], "u")).collect() == []


# versions --------------------------------------------------------------------------------------


def test_failed_write_leaves_the_earlier_result(spark, tmp_path):
    folder = str(tmp_path / "result")
    good = spark.createDataFrame([(1, 0, "0.1"), (2, 1, "0.9")], "EID long, FORTARGET int, PROB string")
    write_scored_atomic(good, folder)
    broken = spark.range(100).select(
        "id", F.lit(1).alias("FORTARGET"), F.when(F.col("id") < 90, "0.5").otherwise(F.raise_error(F.lit("lost"))).alias("PROB")
    ).withColumnRenamed("id", "EID")
    with pytest.raises(Exception, match="lost"):
        write_scored_atomic(broken, folder)
    read = spark.read.csv(committed_path(spark, folder), header=True)
    assert rows_of(read) == [("1", "0", "0.1"), ("2", "1", "0.9")]
    assert Versions(spark, folder).numbers() == [1]


def test_versions_are_kept_and_dropped(spark, tmp_path):
    folder = str(tmp_path / "versions")
    write = lambda df, path: df.write.parquet(path)
    paths = [write_committed(spark.range(n), folder, write) for n in (1, 2, 3, 4)]
    versions = Versions(spark, folder)
    assert [spark.read.parquet(committed_path(spark, folder, n)).count() for n in (1, 4)] == [1, 4]
    with pytest.raises(Conflict):
        versions.commit({"parts": {}}, 3)
    (tmp_path / "versions" / "half-written").mkdir()
    versions.drop_unused(keep=2)
    assert versions.numbers() == [3, 4]
    assert sorted(p.name for p in (tmp_path / "versions").iterdir()) == sorted(["_versions", *[p.rsplit("/", 1)[1] for p in paths[2:]]])
    assert spark.read.parquet(committed_path(spark, folder)).count() == 4
    with pytest.raises(FileNotFoundError):
        committed_path(spark, str(tmp_path / "nothing"))


# hot lookups -----------------------------------------------------------------------------------


def test_hot_lookup_is_spread(spark):
    """Half of all rows have one key; no task of the join gets a tenth of them."""
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 != 0, F.col("id") % 3000).alias("k"), F.col("id").alias("v")
    )
    lookup = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("name"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    for name, value in zip(names, ("-1", "64", "false")):
        spark.conf.set(name, value)
    try:
        assert hot_keys(rows, "k", 1 / 256) == [7]
        joined = attach_spread(rows, lookup, "k")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        got = joined.agg(F.count("*"), F.count("name"), F.sum("name"), F.count_if(F.col("k").isNull())).first()
    finally:
        spark.conf.unset(names[0])
        spark.conf.set(names[1], "8")
        spark.conf.set(names[2], "true")
    assert max(sizes) < 4000 and sum(sizes) == 40_000
    want = rows.join(lookup, "k", "left").agg(F.count("*"), F.count("name"), F.sum("name"), F.count_if(F.col("k").isNull())).first()
    assert tuple(got) == tuple(want)
    plain = attach_spread(rows.where("k <> 7").limit(10_000), lookup, "k")
    assert "_salt" not in plain.columns and plain.count() == 10_000
