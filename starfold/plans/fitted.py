"""Recipes that are learned once and applied to later data.

``fit_recipe`` reads every maximum, mean and category list a recipe needs from one set of tables; what it
learned is one stored table. Applied to other tables it gives the same features on the same scale, whatever
those tables hold: new categories are left out until ``grow`` appends them behind the known ones.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.operators.encode import WideCategory, append_codes, codebook
from starfold.operators.scale import log_stats
from starfold.operators.sparse import dense_and_sparse, sparse_counts, sparse_parts
from starfold.plans.company import (
    AMOUNTS,
    BASE,
    KEY,
    MISSING,
    Recipe,
    alter_rows,
    company_matrix,
    company_types,
    entbase_rows,
    feature_names,
)
from starfold.session import bound_partitions, materialize

#: column -> (table, type of its values, order of first appearance or None for value order)
CATEGORIES = {
    "ETYPE": ("entbase", "double", None),
    "ALTERNO": ("alter", "string", "row_id"),
    "RIGHTTYPE": ("right", "int", None),
    "WZCODE": ("recruit", "string", None),
}
LEARNED = "item string, position long, number double, text string"


def category_rows(
    tables: Mapping[str, DataFrame], recipe: Recipe, column: str, counted: bool = False
) -> DataFrame:
    """The rows whose values of ``column`` are learned; NULL is a value of ALTERNO alone.

    ``counted`` gives the rows that are counted: changes over the amount limit have codes, but no counts.
    """
    if column == "ETYPE":
        rows = company_types(entbase_rows(tables["entbase"], recipe), recipe)
    else:
        rows = tables[CATEGORIES[column][0]]
    if column == "ALTERNO" and counted:
        rows = alter_rows(rows, recipe)
    return rows if column == "ALTERNO" else rows.where(F.col(column).isNotNull())


def _kept_codes(book: DataFrame, recipe: Recipe, column: str) -> tuple[DataFrame, int]:
    """The codebook without the values the recipe has no feature for, with ``place`` 0.., and its size.

    Only the codes left out, as few as the recipe names, are read here; the book stays a table.
    """
    by_value = {"ETYPE": recipe.etype_without, "RIGHTTYPE": recipe.right_without}.get(column, ())
    by_code = recipe.alter_without if column == "ALTERNO" else ()
    out = F.lit(False)
    if by_value:
        out = F.coalesce(F.col(column).isin(*by_value), F.lit(False))
    if by_code:
        out = F.col("code").isin(*by_code)
    gone = [r.code for r in book.where(out).select("code").collect()]
    place = reduce(lambda p, code: p - (F.col("code") > code).cast("int"), gone, F.col("code"))
    size = book.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    return book.where(~out).withColumn("place", place), size - len(gone)


def _feature_name(column: str) -> Column:
    """Names as ``dummy_name`` gives them; ALTERNO is named by its code."""
    if column == "ALTERNO":
        return F.concat(F.lit("ALTERNO_"), F.col("code").cast("string"))
    text = F.col(column).cast("string")
    if CATEGORIES[column][1] == "double":
        text = F.regexp_replace(text, r"\.0$", "")
    return F.concat(F.lit(f"{column}_"), F.translate(text, ".", "_"))


@dataclass(frozen=True)
class FittedRecipe:
    """A recipe with its learned scalars pinned, and one codebook (value, code) per category column."""

    recipe: Recipe
    books: Mapping[str, DataFrame]

    def table(self) -> DataFrame:
        """Everything learned as rows (item, position, number, text); numbers without a value are NULL."""
        spark = next(iter(self.books.values())).sparkSession
        options = [
            (f"option {f.name}", 0, None, json.dumps(getattr(self.recipe, f.name)))
            for f in fields(Recipe)
            if f.name not in ("values", "scalars")
        ]
        scalars = [(f"scalar {n}", 0, v, None) for n, v in self.recipe.scalars.items()]
        parts = [spark.createDataFrame(options + scalars, LEARNED)]
        for column, book in self.books.items():
            parts.append(
                book.select(
                    F.lit(f"code {column}").alias("item"),
                    F.col("code").alias("position"),
                    F.lit(None).cast("double").alias("number"),
                    F.col(column).cast("string").alias("text"),
                )
            )
        return reduce(DataFrame.unionByName, parts)

    def save(self, path: str) -> None:
        self.table().write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedRecipe:
        """Options and scalars are read here; the codebooks stay tables of any size."""
        learned = spark.read.schema(LEARNED).parquet(path)
        few = learned.where(~F.col("item").startswith("code ")).collect()
        known = {f.name: f for f in fields(Recipe)}
        options = {r.item.removeprefix("option "): json.loads(r.text) for r in few if r.item.startswith("option ")}
        options = {k: tuple(v) if isinstance(v, list) else v for k, v in options.items() if k in known}
        scalars = {r.item.removeprefix("scalar "): r.number for r in few if r.item.startswith("scalar ")}
        books = {
            column: learned.where(F.col("item") == f"code {column}").select(
                F.col("text").cast(kind).alias(column), F.col("position").alias("code")
            )
            for column, (_, kind, _) in CATEGORIES.items()
        }
        return cls(Recipe(**options, scalars=scalars), books)

    def grow(self, tables: Mapping[str, DataFrame]) -> FittedRecipe:
        """The same recipe with categories of later tables appended; scalars and old codes stay."""
        grown = {
            column: append_codes(self.books[column], category_rows(tables, self.recipe, column), column, order)
            for column, (_, _, order) in CATEGORIES.items()
        }
        return replace(self, books=grown)

    def pinned(self, max_values: int = 1000) -> Recipe:
        """The recipe with its category lists, for a matrix with one column per category."""
        values = {}
        for column, book in self.books.items():
            rows = book.orderBy("code").limit(max_values + 1).collect()
            if len(rows) > max_values:
                raise WideCategory(f"{column} has more than {max_values} values")
            values[column] = [r[column] for r in rows]
        return replace(self.recipe, values=values)

    def matrix(self, tables: Mapping[str, DataFrame], fill: float | None = MISSING) -> DataFrame:
        """One row per company of ``tables`` with one column per feature, on the learned scale."""
        return company_matrix(tables, self.pinned(), fill)

    def vectors(self, tables: Mapping[str, DataFrame], fill: float = MISSING) -> tuple[DataFrame, DataFrame]:
        """(rows, names): EID, TARGET, split and a feature vector; index, feature, kind.

        Category counts of any width are the sparse end of the vector, an absent one is 0; the other
        features come first and take ``fill`` where they are missing.
        """
        dense = company_matrix(tables, replace(self.recipe, categories=False), fill)
        names = feature_names(dense)
        start, parts, listings = len(names), [], []
        for column in CATEGORIES:
            book, size = _kept_codes(self.books[column], self.recipe, column)
            rows = category_rows(tables, self.recipe, column, counted=True)
            parts.append(sparse_counts(rows, KEY, column, book.select(column, F.col("place").alias("code")), start))
            listings.append(book.select((F.col("place") + start).cast("int").alias("index"), _feature_name(column).alias("feature")))
            start += size
        spark = dense.sparkSession
        first = spark.createDataFrame(list(enumerate(names)), "index int, feature string")
        listing = reduce(DataFrame.unionByName, listings, first).withColumn("kind", F.lit("q"))
        counts = sparse_parts(reduce(DataFrame.unionByName, parts), KEY)
        return dense_and_sparse(dense, names, counts, KEY, start), materialize(listing, "feature-names")


def _scalar_readers(tables: Mapping[str, DataFrame], recipe: Recipe) -> dict:
    """name -> one-row frame of the learned numbers of that name."""
    def stats(rows, column):
        return rows.sparkSession.range(1).select(log_stats(rows, column).alias("s")).select("s.*")

    def largest_group(rows, count):
        grouped = rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(count.alias("n"))
        return grouped.agg(F.max("n").cast("double").alias("top"))

    readers = {"ZCZB": lambda: stats(entbase_rows(tables["entbase"], recipe), "ZCZB")}
    changes = alter_rows(tables["alter"], recipe)
    for c in AMOUNTS:
        if recipe.amount_raw:
            readers[c] = lambda c=c: changes.agg(F.avg(c).cast("double").alias("mean"))
        else:
            readers[c] = lambda c=c: stats(changes, c)
    if not recipe.branch_life:
        readers["branch_count"] = lambda: largest_group(tables["branch"], F.count("TYPECODE"))
    if not recipe.right_dates:
        readers["right"] = lambda: largest_group(tables["right"], F.count(F.lit(1)))
    return readers


def fit_recipe(tables: Mapping[str, DataFrame], recipe: Recipe = BASE) -> FittedRecipe:
    """Learn every scalar and category list of the recipe from ``tables``.

    One pass per number group and per category column, side by side; a few numbers come to the
    driver, the codebooks are written tables.
    """
    bound_partitions(tables["entbase"].sparkSession)
    readers = _scalar_readers(tables, recipe)

    def read(name):
        row = readers[name]().first()
        return {f"{name}.{k}": v for k, v in row.asDict().items()}

    def learn(column):
        book, _ = codebook(category_rows(tables, recipe, column), column, CATEGORIES[column][2])
        return materialize(book, "codebook")

    with ThreadPool(4) as pool:
        scalars = pool.map(read, readers)
        books = pool.map(learn, CATEGORIES)
    found = reduce(lambda a, b: a | b, scalars)
    return FittedRecipe(replace(recipe, scalars=found), dict(zip(CATEGORIES, books)))
