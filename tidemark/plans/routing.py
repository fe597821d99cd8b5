"""Answering summaries from rollups that are already there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import Measurement
from tidemark.operators import rollup

#: Grains from fine to coarse; each can be made from those before it, save that months and years don't consist of weeks.
GRAINS = ("1 hour", "1 day", "week", "month", "quarter", "year")


def makes(fine: str, coarse: str) -> bool:
    """Whether buckets of one grain are whole numbers of buckets of another."""
    if fine not in GRAINS or coarse not in GRAINS or GRAINS.index(fine) > GRAINS.index(coarse):
        return fine == coarse
    return fine != "week" or coarse == "week"


@dataclass
class Router:
    """A measurement's rollups of one field, by grain and dimensions. `summary` reads the coarsest that can answer, else the points."""

    of: Measurement
    value: str | None = None
    kept: list[tuple[str, tuple[str, ...], DataFrame]] = field(default_factory=list)

    def keep(self, grain: str, dimensions: tuple[str, ...], table: DataFrame) -> Router:
        """Register a rollup table made by `rollup.rollup` or `rollup.coarser`."""
        self.kept.append((grain, dimensions, table))
        return self

    def source(self, grain: str, dimensions: tuple[str, ...], filters: tuple[str, ...] = ()) -> tuple[str, tuple[str, ...], DataFrame] | None:
        """The coarsest rollup with these dimensions and filter columns, and among equals the one with fewest dimensions."""
        fit = [k for k in self.kept if makes(k[0], grain) and {*dimensions, *filters} <= {*k[1]}]
        return max(fit, key=lambda k: (GRAINS.index(k[0]) if k[0] in GRAINS else -1, -len(k[1])), default=None)

    def summary(self, grain: str, dimensions: tuple[str, ...] = (), equal: dict[str, object] | None = None) -> DataFrame:
        """Summary by dimensions and buckets of a grain, of points whose tags have the given values."""
        equal = equal or {}
        found = self.source(grain, dimensions, tuple(equal))
        df = self.of.source if found is None else found[2]
        for name, value in equal.items():
            df = df.where(F.col(name) == value)
        if found is None:
            return rollup.rollup(self.of.over(df), grain, dimensions, self.value)
        if found[0] == grain and set(found[1]) == set(dimensions):
            return df
        return rollup.coarser(df, grain, dimensions)
