"""The company matrix from stored states: a new slice of the child tables does not read history again."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions import states
from starfold.operators.states import NUMBER, StateBlock, StateStore
from starfold.plans.company import CHILDREN, KEY, MISSING, Recipe, matrix_of
from starfold.plans.fitted import FittedRecipe


class IncrementalStar:
    """States of every child table in one folder, merged into the matrix of a fitted recipe.

    The recipe must be fitted: its maxima, means and categories hold for all slices alike. ``like`` gives
    the columns of the child tables; none of its rows is read. A latest or first row is found across slices
    by the date and ``row_id``, so row ids must go on over slices.
    """

    def __init__(self, spark: SparkSession, folder: str, fitted: FittedRecipe, like: Mapping[str, DataFrame]):
        self.recipe: Recipe = fitted.pinned()
        self.stores = {
            name: StateStore(spark, f"{folder.rstrip('/')}/{name}", self._block(name, like[name])) for name in CHILDREN
        }

    def _parts(self, name: str, rows: DataFrame):
        return CHILDREN[name](rows, self.recipe, kit=states)

    def _block(self, name: str, rows: DataFrame) -> StateBlock:
        parts = self._parts(name, rows)
        return StateBlock(name, parts.features, KEY, **parts.options)

    def put(self, slice_name: str, tables: Mapping[str, DataFrame]) -> None:
        """Store the states of one slice of all child tables; put again, a slice is replaced."""
        for name, store in self.stores.items():
            store.put(slice_name, self._parts(name, tables[name]).rows)

    def put_slices(
        self, names: Sequence[str], tables: Mapping[str, DataFrame], number: Callable[[DataFrame], Column]
    ) -> None:
        """``put`` for several slices of the tables at once; ``number`` gives the place of a row's slice in ``names``."""
        for name, store in self.stores.items():
            rows = tables[name].withColumn(NUMBER, number(tables[name]))
            store.put_slices(names, self._parts(name, rows).rows, F.col(NUMBER))

    def slices(self) -> list[str]:
        """The slices held; raises when a put was cut off and some tables lack its slice."""
        held = {name: store.slices() for name, store in self.stores.items()}
        if len({tuple(s) for s in held.values()}) > 1:
            raise ValueError(f"tables hold different slices, put the missing ones again: {held}")
        return next(iter(held.values()))

    def compact(self) -> None:
        for store in self.stores.values():
            store.compact()

    def matrix(self, spine: DataFrame, entbase: DataFrame, fill: float | None = MISSING) -> DataFrame:
        """One row per company of the spine with every feature; of the child tables only states are read."""
        self.slices()
        children = {name: store.features() for name, store in self.stores.items()}
        return matrix_of(spine, entbase, children, self.recipe, fill)
