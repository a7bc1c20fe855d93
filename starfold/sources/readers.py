"""Readers. Types are declared, never inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.session import materialize
from starfold.sources.schemas import STAR_FILES, STAR_SCHEMAS, TABLE_SCHEMAS


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    other: str | None = None,
    strict: bool = False,
    row_key: str | None = None,
) -> DataFrame:
    """CSV with a header row; columns are matched by name, not position.

    All files of a folder must have the same header: a file with another one raises when it is read.

    Declared columns get their type, and text that does not parse becomes NULL (or raises when
    ``strict``). Whole numbers may be written as "2015.0". Undeclared columns are cast to
    ``other``, or dropped when it is None. ``row_key`` adds a key that sorts rows in file order.
    """
    # enforceSchema off: Spark compares the header of every file with the one it planned by
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    declared = _fields(schema)
    columns = [_typed(f.name, f.dataType, strict).alias(f.name) for f in declared]
    if other:
        known = {f.name for f in declared}
        columns += [
            _typed(c, T.StructType.fromDDL(f"c {other}")[0].dataType, strict).alias(c)
            for c in raw.columns
            if c not in known
        ]
    if not row_key:
        return raw.select(*columns)
    return _in_file_order(raw.select(*columns, *_place()), path, row_key)


@dataclass(frozen=True)
class Checked:
    """Rows that could be read whole, and why the others could not."""

    accepted: DataFrame
    rejects: DataFrame


def read_csv_checked(
    spark: SparkSession, path: str, schema: str | T.StructType, parsers: Mapping[str, Column] | None = None
) -> Checked:
    """CSV with a header row, in one pass: typed rows, and rejects (file, line, column, text).

    A value that is present but not of its declared type is a reject with its column and text; so is a
    value for which ``parsers`` (column -> expression over the text columns) gives NULL. A line with
    too few or too many values is a reject without column whose text is the line. A row with any reject
    is not accepted. ``line`` numbers the rows of a file's block, header left out. Undeclared columns
    are dropped. Both frames are read from one written table.
    """
    header = spark.read.option("header", True).csv(path).columns
    broken = "_broken_line"
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, broken]])
    reader = spark.read.schema(text).option("header", True).option("enforceSchema", False)
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).csv(path)
    typed = {f.name: _typed(f.name, f.dataType, False) for f in _fields(schema)}
    tests = typed | dict(parsers or {})
    kind = "struct<column:string,text:string>"

    def problem(column, value, wrong):
        return F.when(wrong, F.struct(column.alias("column"), value.alias("text")).cast(kind))

    def unreadable(name, parsed):
        value = F.col(f"`{name}`")
        missing = F.lower(F.trim(value)).isin("nan", "")
        return problem(F.lit(name), value, value.isNotNull() & ~missing & parsed.isNull())

    whole = F.col(broken).isNull()
    problems = F.when(whole, F.array_compact(F.array(*[unreadable(n, c) for n, c in tests.items()]))).otherwise(
        F.array(problem(F.lit(None).cast("string"), F.col(broken), ~whole))
    )
    rows = materialize(
        raw.select(
            *[c.alias(n) for n, c in typed.items()],
            F.col("_metadata.file_path").alias("_file"),
            (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_line"),
            problems.alias("_problems"),
        ),
        "checked",
    )
    rejects = rows.select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.explode("_problems").alias("p"))
    return Checked(
        rows.where(F.size("_problems") == 0).select(*typed), rejects.select("file", "line", "p.column", "p.text")
    )


FILE_ROWS = 50_000


def _place() -> list[Column]:
    """File, block and row number within the task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        row.alias("_row"),
    ]


def _in_file_order(rows: DataFrame, path: str, row_key: str) -> DataFrame:
    """Add a key that sorts rows as they stand in the input, files by path.

    The bytes before a row's block, over all files, order the blocks; rows of one task are counted in
    order. Both fit one decimal, whatever the number of files, so the key stays in a fixed-width buffer.
    """
    files = rows.sparkSession.read.format("binaryFile").load(path)
    # One row per input file; only names and lengths are read.
    before = F.sum("length").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("_metadata.file_path").alias("_file"), "length")
    files = materialize(files.select("_file", F.coalesce(before, F.lit(0)).alias("_before")), "input-files")
    if files.limit(FILE_ROWS + 1).count() <= FILE_ROWS:
        files = F.broadcast(files)
    block = (F.col("_before") + F.col("_start")).cast("decimal(18,0)") * F.lit(1 << 33).cast("decimal(10,0)")
    key = (block + F.col("_row").cast("decimal(10,0)")).cast("decimal(28,0)")
    return rows.join(files, "_file", "left").withColumn(row_key, key).drop("_file", "_start", "_row", "_before")


def reject_count(raw: DataFrame, column: str, parsed: Column) -> DataFrame:
    """Rows whose text is present but does not parse."""
    return raw.agg(F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("rejects"))


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet", TABLE_SCHEMAS.get(name))


def read_star(spark: SparkSession, folder: str, row_key: str = "row_id") -> dict[str, DataFrame]:
    """All tables of the company star from CSV files in one folder."""
    return {
        name: read_csv(
            spark,
            f"{folder.rstrip('/')}/{file}",
            STAR_SCHEMAS[name],
            other="double" if name == "entbase" else None,
            row_key=None if name in ("train", "test", "entbase") else row_key,
        )
        for name, file in STAR_FILES.items()
    }


def _fields(schema: str | T.StructType | None) -> list[T.StructField]:
    if schema is None:
        return []
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return list(schema.fields)


def _typed(name: str, kind: T.DataType, strict: bool) -> Column:
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegerType):
        return _cast(_number(text, strict), "int", strict)
    return _number(text, strict) if isinstance(kind, T.DoubleType) else _cast(text, kind, strict)


def _number(text: Column, strict: bool) -> Column:
    """Text as double, with "nan" read as missing."""
    return F.nanvl(_cast(text, "double", strict), F.lit(None))


def _cast(c: Column, kind, strict: bool) -> Column:
    return c.cast(kind) if strict else c.try_cast(kind)
