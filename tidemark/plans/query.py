"""The query builder: an immutable description of a query that becomes one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.aggregates import aggregate, time_of, value_of
from tidemark.functions.predicates import Predicate, all_equal
from tidemark.model import Measurement
from tidemark.operators.buckets import bucket_start
from tidemark.operators.quantiles import SHARES, with_quantile


@dataclass(frozen=True, eq=False)
class Query:
    """A query on a measurement. Each step returns a new query; `df()` gives the DataFrame.

    Ranges include both ends; an unset end is open. Limits apply to result rows after sorting, never to what is
    aggregated; None is no limit and 0 gives no rows.
    """

    of: Measurement
    start: object = None
    end: object = None
    condition: Predicate | None = None
    aggregates: tuple[tuple[str, str | None, str], ...] = ()
    groups: tuple[str, ...] = ()
    every: str | None = None
    ascending: bool = True
    sorted: bool = True
    rows: int | None = None
    skip: int = 0
    zero: bool = False
    chosen: tuple[str, ...] = ()

    def range(self, start: object = None, end: object = None) -> Query:
        """Points from start to end, both included; times, or ISO strings."""
        return replace(self, start=start, end=end)

    def where(self, condition: Predicate | Column) -> Query:
        """Points that meet a condition, and the conditions before."""
        added = condition if isinstance(condition, Predicate) else Predicate(F.coalesce(condition, F.lit(False)))
        return replace(self, condition=added if self.condition is None else self.condition & added)

    def tagged(self, **tags: object) -> Query:
        """Points whose tags have these values."""
        return self.where(all_equal({self.of.tag(k): v for k, v in tags.items()}))

    def agg(self, name: str, field: str | None = None, into: str | None = None) -> Query:
        """Add an aggregate of a field (the first one by default) as column `into` (its name by default)."""
        return replace(self, aggregates=(*self.aggregates, (name, field, into or name)))

    def group_by(self, *tags: str) -> Query:
        return replace(self, groups=tuple(self.of.tag(t) for t in tags))

    def bucket(self, every: str) -> Query:
        """Group by time: "30 seconds", "1 hour", "1 day", or the calendar's "week", "month", "quarter", "year"."""
        return replace(self, every=every)

    def order(self, ascending: bool = True) -> Query:
        return replace(self, ascending=ascending, sorted=True)

    def unordered(self) -> Query:
        """Leave rows in any order; saves a sort where the result is aggregated further."""
        return replace(self, sorted=False)

    def limit(self, rows: int | None) -> Query:
        if rows is not None and rows < 0:
            raise InvalidArgument("a limit can't be negative")
        return replace(self, rows=rows)

    def offset(self, rows: int) -> Query:
        if rows < 0:
            raise InvalidArgument("an offset can't be negative")
        return replace(self, skip=rows)

    def select(self, *fields: str) -> Query:
        """Fields to return; without a choice, all."""
        return replace(self, chosen=tuple(self.of.field(f) for f in fields))

    def missing_as_zero(self, on: bool = True) -> Query:
        """Count missing or non-numeric values as 0.0 instead of leaving them out."""
        return replace(self, zero=on)

    def points(self) -> DataFrame:
        """The points that the range and the conditions leave."""
        df, time = self.of.source, F.col(self.of.time)
        if self.start is not None:
            df = df.where(time >= _moment(self.start))
        if self.end is not None:
            df = df.where(time <= _moment(self.end))
        if self.of.day is not None:  # a range of times alone prunes no partitions
            if self.start is not None:
                df = df.where(F.col(self.of.day) >= F.to_date(_moment(self.start)))
            if self.end is not None:
                df = df.where(F.col(self.of.day) <= F.to_date(_moment(self.end)))
        return df if self.condition is None else df.where(self.condition.column)

    def df(self) -> DataFrame:
        """The result."""
        m, df = self.of, self.points()
        if not self.aggregates:
            if self.groups or self.every:
                raise InvalidArgument("groups and buckets need an aggregate")
            df = self._sorted(df, m.order(self.ascending))
            return df.select(*dict.fromkeys((m.time, *m.tags, *(self.chosen or m.fields), *m.tiebreak)))
        kinds = dict(m.source.dtypes)
        names = [*self.groups, *(["bucket"] if self.every else [])]
        keys = [F.col(g) for g in self.groups] + ([bucket_start(F.col(m.time), self.every)] if self.every else [])
        fields = dict.fromkeys(m.field(field) for _, field, _ in self.aggregates)
        df = df.select("*", *(value_of(f, kinds[f], self.zero).alias(f"value_of_{f}") for f in fields), *(k.alias(f"key_{i}") for i, k in enumerate(keys)))
        held = [f"key_{i}" for i in range(len(keys))]
        columns = {into: aggregate(m, name, f"value_of_{m.field(field)}") for name, field, into in self.aggregates if name not in SHARES}
        if len(self.aggregates) == 1:
            columns["time"] = time_of(m, self.aggregates[0][0])
        columns["points"] = F.count("*")
        out = df.groupBy(*held).agg(*(c.alias(into) for into, c in columns.items()))
        for name, field, into in self.aggregates:
            if name in SHARES:
                out = with_quantile(out, df, held, f"value_of_{m.field(field)}", name, into)
        shown = dict.fromkeys([*(into for _, _, into in self.aggregates), *columns])
        out = out.select(*(F.col(k).alias(n) for k, n in zip(held, names, strict=True)), *shown)
        by = (["bucket"] if self.every else []) + list(self.groups)
        return self._sorted(out, [F.col(c).asc() if self.ascending else F.col(c).desc() for c in by])

    def _sorted(self, df: DataFrame, by: list[Column]) -> DataFrame:
        if by and (self.sorted or self.rows is not None or self.skip):
            df = df.orderBy(*by)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.rows is None else df.limit(self.rows)


def _moment(at: object) -> Column:
    if isinstance(at, Column):
        return at
    return F.lit(at.isoformat(sep=" ") if isinstance(at, datetime) else str(at)).cast("timestamp_ntz")
