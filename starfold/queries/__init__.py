"""Every operator as a query over the test tables, with the SQL that must give the same rows."""

from starfold.queries import (  # noqa: F401
    aggregates,
    cleaning,
    company,
    encoding,
    joins,
    learning,
    lifecycle,
    profiles,
    splits,
    twins,
)
from starfold.queries.registry import ORACLES, QUERIES  # noqa: F401
