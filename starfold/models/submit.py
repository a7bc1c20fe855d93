"""From scores to the submission table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions.scalars import decision, probability_text, round_half_even


def submission(
    scored: DataFrame, threshold: float, key: str = "EID", score: str = "score",
    order: str | None = None,
) -> DataFrame:
    """One row per key: EID, FORTARGET, PROB.

    The score is rounded half-even to 8 places before it is compared, strictly, with the
    threshold. With ``order`` the first row of a repeated key counts; without, copies are equal.
    """
    if order is not None:
        scored = scored.groupBy(key).agg(F.min_by(score, order).alias(score))
    else:
        scored = scored.select(key, score).dropDuplicates([key])
    rounded = scored.select(F.col(key).alias("EID"), round_half_even(score, 8).alias("_p"))
    return rounded.select(
        "EID", decision("_p", threshold).alias("FORTARGET"), probability_text("_p").alias("PROB")
    )
