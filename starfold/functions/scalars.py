"""Scalar column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the unit suffix an amount may carry. It is cut off, not multiplied in.
AMOUNT_UNIT = "万元"

# A failed cast costs an exception per row, so only text matching this reaches the cast.
_WHOLE = r"^\s*[+-]?[0-9]{1,10}\s*$"


def parse_amount(c: Column | str, strict: bool = False) -> Column:
    """Amount text to double: the unit at the end is cut off.

    Text that is no number gives NULL, or raises when ``strict``; "nan" is missing. Java's type
    suffixes ("1.0d") are not part of a number.
    """
    text = _col(c).cast("string")
    bare = F.when(
        text.endswith(AMOUNT_UNIT), F.substring(text, F.lit(1), F.length(text) - len(AMOUNT_UNIT))
    ).otherwise(text)
    if strict:
        return bare.cast("double")
    plain = F.when(~F.substring(bare, -1, 1).isin("", "d", "D", "f", "F"), bare)
    return F.nanvl(plain.try_cast("double"), F.lit(None))


def log1p_or_null(c: Column | str) -> Column:
    """ln(1 + x); NULL for x <= -1, where no finite value exists."""
    return F.log1p(_col(c))


def log_bin(c: Column | str) -> Column:
    """ln(1 + x) cut to its whole part."""
    return log1p_or_null(c).cast("int")


def date_piece(c: Column | str, part: int, sep: str = "-") -> Column:
    """The ``part``-th piece (1 = year, 2 = month) of a date string as int; NULL when absent."""
    piece = F.get(F.split(_col(c), re.escape(sep)), part - 1)
    return F.when(piece.rlike(_WHOLE), piece).try_cast("int")


def round_half_even(c: Column | str, places: int = 8) -> Column:
    return F.bround(_col(c), places)


def decision(score: Column | str, threshold: float) -> Column:
    """1 when the score is strictly above the threshold, else 0."""
    return flag(_col(score) > F.lit(threshold))


def flag(condition: Column) -> Column:
    """A condition as 0/1; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division as double that gives NULL, not an error, for a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def scaled_down(c: Column | str, factor: float) -> Column:
    return _col(c) / F.lit(float(factor))


def probability_text(c: Column | str) -> Column:
    """A probability already rounded to 8 places as the shortest decimal text.

    From 1e-4 up it is plain ("0.5", "0.0001"); below it uses a two-digit exponent ("1.2e-05").
    Spark's own cast switches to exponents below 1e-3 and writes them differently.
    """
    p = _col(c)
    fixed = F.format_string("%.8f", p)
    plain = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    digits = F.format_string("%d", F.bround(p * F.lit(1e8), 0).cast("long"))
    tail = F.regexp_replace(F.substring(digits, 2, 8), "0+$", "")
    tiny = F.concat(
        F.substring(digits, 1, 1),
        F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)),
        F.lit("e-0"),
        (F.lit(9) - F.length(digits)).cast("string"),
    )
    return F.when((p > 0) & (p < 1e-4), tiny).when(p.isNotNull(), plain)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
