"""Feature recipes for the company star.

A recipe says which features a scoring run uses; each child table becomes one feature block, so it
is read and shuffled once however many features it gives. The ``matrix`` joins the blocks onto the
labelled and unlabelled companies together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    FeatureBlock,
    assemble,
    fill_truncated_mean,
    first_seen_values,
    log_scale,
    one_hot,
    unique_rows,
    vocabulary,
)
from starfold.session import bound_partitions

KEY = "EID"
MISSING = -999


@dataclass(frozen=True)
class Recipe:
    """Options of one feature set; the defaults are the base run.

    ``values`` pins the categories of a column (ETYPE, ALTERNO, RIGHTTYPE, WZCODE) and ``scalars`` the
    maxima and means by name (``scalar_names``). What is not pinned is read from the data when a block is
    built. Without ``categories`` the blocks have no column per category.
    """

    name: str = "base"
    capital_limit: float | None = 90000
    etype_without: tuple = (2.0,)
    etype_null: float | None = None
    entbase_drop: tuple[str, ...] = ()
    capital_gap: bool = True
    amount_limit: float | None = 2000000
    amount_fill: str = "mean"
    amount_raw: bool = False
    alter_carry: tuple[str, ...] = ("ALTAF_ALTBE",)
    alter_first: bool = False
    alter_without: tuple[int, ...] = ()
    branch_life: bool = False
    branch_span: bool = False
    right_dates: bool = True
    right_without: tuple = ()
    invest_life: str = "invest_life_ratio"
    breakfaith_more: bool = False
    recruit_mean: bool = True
    money: str | None = None
    categories: bool = True
    values: Mapping[str, Sequence] = field(default_factory=dict)
    scalars: Mapping[str, float | None] = field(default_factory=dict)


# Limits and dropped categories of the four scoring runs.
BASE = Recipe()
CARRY = replace(BASE, name="carry", alter_carry=("ALTAF_ALTBE", "ALTBE", "ALTAF"))
WIDE = Recipe(
    name="wide",
    capital_limit=1000000,
    etype_without=(1.0, 2.0, 4.0),
    etype_null=0.0,
    entbase_drop=("TZINUM",),
    capital_gap=False,
    amount_limit=None,
    amount_raw=True,
    alter_first=True,
    alter_without=(10, 11),
    branch_span=True,
    right_dates=False,
    right_without=(30,),
    invest_life="invest_close_ratio",
    breakfaith_more=True,
    recruit_mean=False,
    money="log",
)
STACKED = Recipe(
    name="stacked",
    capital_limit=None,
    etype_null=0.0,
    capital_gap=False,
    amount_limit=None,
    amount_fill="min",
    branch_life=True,
    money="scaled",
)
RECIPES = {r.name: r for r in (BASE, CARRY, WIDE, STACKED)}


def entbase_block(entbase: DataFrame, recipe: Recipe = BASE, helper: bool = False) -> DataFrame:
    """Scaled capital, company type one-hot and the remaining numeric columns.

    ``helper`` keeps ``_capital``, the unscaled log of the capital.
    """
    rows = entbase_rows(entbase, recipe)
    scaled = log_scale(rows, "ZCZB", fill="mean", log_out="_capital", stats=_log_stats(recipe, "ZCZB"))
    types = scaled.drop("ETYPE")
    if recipe.categories:
        types = one_hot(
            scaled,
            "ETYPE",
            values=_values(recipe, "ETYPE", lambda: _types(rows, recipe)),
            without=recipe.etype_without,
            null_category=recipe.etype_null,
        )
    out = fn.fill_numeric(types, 0, skip=[KEY, "_capital"])
    if recipe.capital_gap:
        out = out.withColumn("ZCZB_FINZB", F.col("ZCZB") - F.col("FINZB"))
    return unique_rows(out.drop(*recipe.entbase_drop, *(() if helper else ("_capital",))), KEY)


def entbase_rows(entbase: DataFrame, recipe: Recipe) -> DataFrame:
    """The rows that the capital limit of the recipe keeps."""
    return entbase if recipe.capital_limit is None else entbase.where(F.col("ZCZB") < recipe.capital_limit)


def company_types(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """EID and ETYPE with the category that stands for NULL."""
    value = F.col("ETYPE")
    if recipe.etype_null is not None:
        value = F.coalesce(value, F.lit(recipe.etype_null))
    return rows.select(KEY, value.alias("ETYPE"))


def _types(rows: DataFrame, recipe: Recipe) -> list:
    return vocabulary(company_types(rows, recipe), "ETYPE")


def _log_stats(recipe: Recipe, column: str):
    """Pinned statistics of a column as ``log_stats`` gives them, None when they are not pinned."""
    if f"{column}.top" not in recipe.scalars:
        return None
    parts = ("top", "mean", "low")
    return F.struct(*[F.lit(recipe.scalars[f"{column}.{p}"]).cast("double").alias(p) for p in parts])


def _mean(recipe: Recipe, column: str):
    name = f"{column}.mean"
    return F.lit(recipe.scalars[name]).cast("double") if name in recipe.scalars else None


def _tops(recipe: Recipe, *names: str) -> dict:
    return {n: recipe.scalars[f"{n}.top"] for n in names if f"{n}.top" in recipe.scalars}


def _values(recipe: Recipe, column: str, discover) -> Sequence:
    return recipe.values[column] if column in recipe.values else discover()


def pin_values(tables: Mapping[str, DataFrame], recipe: Recipe, order: str = "row_id") -> Recipe:
    """The recipe with its categories read once, so later data gets the same feature columns.

    The columns not pinned yet are read side by side.
    """
    if not recipe.categories:
        return recipe
    entbase = entbase_rows(tables["entbase"], recipe)
    readers = {
        "ETYPE": lambda: _types(entbase, recipe),
        "ALTERNO": lambda: first_seen_values(tables["alter"], "ALTERNO", order),
        "RIGHTTYPE": lambda: vocabulary(tables["right"], "RIGHTTYPE"),
        "WZCODE": lambda: vocabulary(tables["recruit"], "WZCODE"),
    }
    missing = [c for c in readers if c not in recipe.values]
    if not missing:
        return recipe
    with ThreadPool(len(missing)) as pool:
        found = pool.map(lambda c: readers[c](), missing)
    return replace(recipe, values=dict(recipe.values) | dict(zip(missing, found)))


@dataclass(frozen=True)
class Parts:
    """A block before it is aggregated: its rows, its features and what is done with them afterwards.

    ``features`` come from ``kit``, the module with the aggregate builders: ``functions`` for one
    aggregation, ``functions.states`` for stored states.
    """

    name: str
    rows: DataFrame
    features: Mapping
    options: Mapping = field(default_factory=dict)

    def build(self) -> DataFrame:
        return FeatureBlock(self.name, self.rows, self.features, KEY, **self.options).build()


def alter_block(alter: DataFrame, recipe: Recipe = BASE, order: str = "row_id") -> DataFrame:
    """Change counts by code, amounts of the latest change, first and last change date."""
    return alter_parts(alter, recipe, order).build()


def alter_parts(alter: DataFrame, recipe: Recipe = BASE, order: str = "row_id", kit=fn) -> Parts:
    rows = alter_rows(alter, recipe)
    if recipe.amount_raw:
        for c in AMOUNTS:
            rows = fill_truncated_mean(rows, c, mean=_mean(recipe, c))
        change = fn.log1p_or_null(F.col("ALTAF") - F.col("ALTBE"))
    else:
        scaled = rows
        for c, out in zip(AMOUNTS, ("_af", "_be")):
            scaled = log_scale(scaled, c, fill=recipe.amount_fill, out=out, stats=_log_stats(recipe, c))
        rows = scaled.withColumns({"ALTAF": F.col("_af"), "ALTBE": F.col("_be")})
        change = F.col("ALTAF") - F.col("ALTBE")
    rows = rows.withColumns(
        {
            "ALTAF_ALTBE": change,
            "_y": fn.date_piece("ALTDATE", 1),
            "_m": fn.date_piece("ALTDATE", 2),
        }
    ).withColumn("_ym", F.col("_y") * 100 + F.col("_m"))
    place = _order(alter, order)
    features = {}
    if recipe.categories:
        codes = _values(recipe, "ALTERNO", lambda: first_seen_values(alter, "ALTERNO", order))
        kept = [(i, v) for i, v in enumerate(codes) if i not in recipe.alter_without]
        features = kit.category_counts(
            "ALTERNO", [v for _, v in kept], "ALTERNO",
            names=[fn.dummy_name("ALTERNO", i) for i, _ in kept], null_category=True,
        )
    features |= {c: kit.carry_latest(c, place) for c in recipe.alter_carry}
    features |= {"_first": kit.earliest("_ym"), "_last": kit.latest("_ym")}
    dates = {"last_year": _year("_last"), "last_month": _month("_last")}
    if recipe.alter_first:
        dates |= {"first_year": _year("_first"), "first_month": _month("_first")}
    return Parts("alter", rows, features, {"derived": dates, "drop": ("_first", "_last"), "fill": -1})


AMOUNTS = ("ALTAF", "ALTBE")


def alter_rows(alter: DataFrame, recipe: Recipe) -> DataFrame:
    """Changes with their amounts as numbers, as far as the amount limit of the recipe keeps them."""
    rows = alter.withColumns({c: fn.parse_amount(F.coalesce(F.col(c), F.lit("0"))) for c in AMOUNTS})
    return rows if recipe.amount_limit is None else rows.where(F.col("ALTAF") < recipe.amount_limit)


def _order(df: DataFrame, order: str):
    """Latest (year, month) row, ties by ``order``: packed for the whole numbers that readers give."""
    kind = df.schema[order].dataType
    if kind.typeName() in ("integer", "long"):
        return fn.order_key("_y", "_m", order)
    if kind.typeName() == "decimal" and kind.scale == 0 and kind.precision <= 28:
        return fn.order_key("_y", "_m", order, kind.precision)
    return F.struct("_ym", order)


def _year(c: str):
    return F.floor(F.col(c) / 100).cast("int")


def _month(c: str):
    return F.pmod(F.col(c), F.lit(100)).cast("int")


def branch_block(branch: DataFrame, recipe: Recipe = BASE, order: str = "row_id") -> DataFrame:
    """Branch count, closing behaviour, home share and branch years."""
    return branch_parts(branch, recipe, order).build()


def branch_parts(branch: DataFrame, recipe: Recipe = BASE, order: str = "row_id", kit=fn) -> Parts:
    life = fn.fill_from("B_ENDYEAR", "B_REYEAR") - F.col("B_REYEAR")
    rows = branch.withColumn("_life", life)
    home = {"IFHOME": kit.flag_rate("IFHOME")}
    if recipe.branch_life:
        lived = fn.replace_value("_life", 0, -1)
        features = {"sub_life": kit.carry_first(lived, order)} | home
        features |= {"B_REYEAR": kit.mean_of("B_REYEAR")}
        return Parts("branch", rows.where("_life >= 0"), features)
    features = home | {
        "branch_close_rate": kit.flag_rate(fn.flag(F.col("_life") > 0)),
        "_branches": kit.present("TYPECODE"),
        "bran_lastY": kit.latest("B_REYEAR"),
        "bran_firstY": kit.earliest("B_REYEAR"),
    }
    if recipe.branch_span:
        features["year_sub"] = kit.year_span("B_REYEAR")
    options = {"scaled": {"branch_count": "_branches"}, "tops": _tops(recipe, "branch_count")}
    options |= {"derived": {"branch_count_bin": fn.log_bin("_branches")}, "drop": ("_branches",)}
    return Parts("branch", rows, features, options)


def right_block(right: DataFrame, recipe: Recipe = BASE) -> DataFrame:
    """Rights by type, their number, last application date and share granted."""
    return right_parts(right, recipe).build()


def right_parts(right: DataFrame, recipe: Recipe = BASE, kit=fn) -> Parts:
    features = {}
    if recipe.categories:
        types = _values(recipe, "RIGHTTYPE", lambda: vocabulary(right, "RIGHTTYPE"))
        types = [v for v in types if v not in recipe.right_without]
        features = kit.category_counts("RIGHTTYPE", types, "RIGHTTYPE")
    features |= {
        "right_count": kit.row_count(),
        "right_get_rate": kit.share_where(F.col("FBDATE").isNotNull()),
    }
    if recipe.right_dates:
        features |= {
            "right_last_year": kit.latest(fn.date_piece("ASKDATE", 1)),
            "right_last_month": kit.biggest(fn.date_piece("ASKDATE", 2)),
        }
        return Parts("right", right, features)
    return Parts("right", right, features, {"scaled": {"right": "right_count"}, "tops": _tops(recipe, "right")})


def invest_block(invest: DataFrame, recipe: Recipe = BASE) -> DataFrame:
    """Shares held, home share, share of ended investments and the last investment year."""
    return invest_parts(invest, recipe).build()


def invest_parts(invest: DataFrame, recipe: Recipe = BASE, kit=fn) -> Parts:
    ended = fn.fill_from("BTENDYEAR", "BTYEAR") > F.col("BTYEAR")
    features = {
        "BTBL_SUM": kit.total_of("BTBL"),
        "BTBL_COUNT": kit.present("BTBL"),
        "BTBL_RATIO": kit.mean_of("BTBL"),
        "invest_home_prob": kit.flag_rate("IFHOME"),
        recipe.invest_life: kit.flag_rate(fn.flag(ended)),
        "BTYEAR": kit.latest("BTYEAR"),
    }
    return Parts("invest", invest, features)


def project_block(project: DataFrame, recipe: Recipe = BASE) -> DataFrame:
    """Last project year, largest project month and home share."""
    return project_parts(project, recipe).build()


def project_parts(project: DataFrame, recipe: Recipe = BASE, kit=fn) -> Parts:
    features = {
        "DJDATE_Y": kit.latest(fn.date_piece("DJDATE", 1)),
        "DJDATE_M": kit.biggest(fn.date_piece("DJDATE", 2)),
        "project_home_prob": kit.flag_rate("IFHOME"),
    }
    return Parts("project", project, features)


def lawsuit_block(lawsuit: DataFrame, recipe: Recipe = BASE) -> DataFrame:
    """Lawsuits with an amount, last lawsuit year; with ``money`` the summed amount as helper."""
    return lawsuit_parts(lawsuit, recipe).build()


def lawsuit_parts(lawsuit: DataFrame, recipe: Recipe = BASE, kit=fn) -> Parts:
    features = {
        "lawsuit_LAWAMOUNT_count": kit.present("LAWAMOUNT"),
        "LAWDATE_Y": kit.latest(fn.date_piece("LAWDATE", 1)),
    }
    if recipe.money:
        features["_claims"] = kit.total_of("LAWAMOUNT")
    return Parts("lawsuit", lawsuit, features)


def lawsuit_amounts(lawsuit: DataFrame) -> DataFrame:
    """The amount features of lawsuits: log-binned sum, mean, count and last dates."""
    features = {
        "_sum": fn.total_of("LAWAMOUNT"),
        "lawsuit_LAWAMOUNT_count": fn.present("LAWAMOUNT"),
        "lawsuit_LAWAMOUNT_avg": fn.mean_of("LAWAMOUNT"),
        "LAWDATE_Y": fn.latest(fn.date_piece("LAWDATE", 1)),
        "LAWDATE_M": fn.biggest(fn.date_piece("LAWDATE", 2)),
    }
    derived = {"lawsuit_LAWAMOUNT_sum": fn.log_bin("_sum"), "money_sum": fn.log1p_or_null("_sum")}
    return FeatureBlock("lawsuit", lawsuit, features, derived=derived, drop=("_sum",)).build()


def breakfaith_block(breakfaith: DataFrame, recipe: Recipe = BASE) -> DataFrame:
    """Broken promises: number, number ended and first year."""
    return breakfaith_parts(breakfaith, recipe).build()


def breakfaith_parts(breakfaith: DataFrame, recipe: Recipe = BASE, kit=fn) -> Parts:
    features = {"breakfaith_is_count": kit.row_count()}
    if recipe.breakfaith_more:
        features |= {
            "breakfaith_is_sum": kit.present("SXENDDATE"),
            "FBDATE_Y": kit.earliest(fn.date_piece("FBDATE", 1, "/")),
        }
    return Parts("breakfaith", breakfaith, features)


def recruit_block(recruit: DataFrame, recipe: Recipe = BASE) -> DataFrame:
    """Job postings by site, people wanted in total, postings, people per posting."""
    return recruit_parts(recruit, recipe).build()


def recruit_parts(recruit: DataFrame, recipe: Recipe = BASE, kit=fn) -> Parts:
    features = {}
    if recipe.categories:
        sites = _values(recipe, "WZCODE", lambda: vocabulary(recruit, "WZCODE"))
        features = kit.category_counts("WZCODE", sites, "WZCODE")
    features |= {
        "recruit_RECRNUM_sum": kit.total_of("RECRNUM"),
        "recruit_RECRNUM_count": kit.row_count(),
    }
    derived = {}
    # Fixed value: the name of this feature in the scoring runs.
    if recipe.recruit_mean:
        derived["recurt_info_ration"] = fn.ratio("recruit_RECRNUM_sum", "recruit_RECRNUM_count")
    return Parts("recruit", recruit, features, {"derived": derived})


def money_ratio(recipe: Recipe):
    """Claimed amount over capital, from the helper columns of the joined row."""
    if recipe.money == "log":
        return fn.ratio(fn.log1p_or_null("_claims"), "_capital")
    return fn.scaled_down(fn.ratio("_claims", "ZCZB"), 10000)


def company_matrix(
    tables: Mapping[str, DataFrame], recipe: Recipe = BASE, fill: float | None = MISSING
) -> DataFrame:
    """One row per company of the spine with every feature of the recipe.

    ``tables["spine"]`` holds EID and TARGET, and ``split`` ("train" or "test") if it comes from two
    lists; without it a NULL target marks the companies to be scored.
    """
    bound_partitions(tables["spine"].sparkSession)
    recipe = pin_values(tables, recipe)
    children = {name: parts(tables[name], recipe).build() for name, parts in CHILDREN.items()}
    return matrix_of(tables["spine"], tables["entbase"], children, recipe, fill)


#: child table -> its block before aggregation, in the order of the matrix
CHILDREN = {
    "alter": alter_parts,
    "branch": branch_parts,
    "right": right_parts,
    "invest": invest_parts,
    "project": project_parts,
    "lawsuit": lawsuit_parts,
    "breakfaith": breakfaith_parts,
    "recruit": recruit_parts,
}


def matrix_of(
    spine: DataFrame, entbase: DataFrame, children: Mapping[str, DataFrame], recipe: Recipe, fill: float | None
) -> DataFrame:
    """The blocks of all child tables and of the company table on the spine."""
    bound_partitions(spine.sparkSession)
    blocks = [entbase_block(entbase, recipe, helper=recipe.money == "log"), *[children[c] for c in CHILDREN]]
    wide = assemble(spine, blocks, KEY)
    if recipe.money:
        wide = wide.withColumn("money_BL", money_ratio(recipe)).drop("_claims", "_capital")
    return wide if fill is None else fn.fill_numeric(wide, fill, skip=[KEY, "TARGET", "split"])


def feature_names(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in (KEY, "TARGET", "split")]
