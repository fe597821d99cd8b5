"""Aggregates over a field of a measurement, as columns for any groupBy or window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.model import Measurement


def _seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6


def _first(m: Measurement, v: str) -> Column:
    return F.min_by(v, m.moment())


def _last(m: Measurement, v: str) -> Column:
    return F.max_by(v, m.moment())


def _rate(m: Measurement, v: str) -> Column:
    span = _seconds(F.max(m.time)) - _seconds(F.min(m.time))
    return (_last(m, v) - _first(m, v)) / F.nullif(span, F.lit(0.0))


def _not_nan(v: str) -> Column:
    return F.when(~F.isnan(v), F.col(v))


#: By name, on a column by name. Median is the upper one of an even number of values; percentiles are exact, by
#: interpolation; standard deviation is of the population; least and largest leave NaN out. As columns, median and
#: percentiles hold the different values of a group; queries compute them by operators/quantiles.py, which doesn't.
AGGREGATES: dict[str, Callable[[Measurement, str], Column]] = {
    "count": lambda m, v: F.count(v),
    "sum": lambda m, v: F.sum(v),
    "avg": lambda m, v: F.avg(v),
    "min": lambda m, v: F.min(_not_nan(v)),
    "max": lambda m, v: F.max(_not_nan(v)),
    "first": _first,
    "last": _last,
    "stddev": lambda m, v: F.stddev_pop(v),
    "median": lambda m, v: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{v}` DESC)"),
    "p95": lambda m, v: F.percentile(v, F.lit(0.95)),
    "p99": lambda m, v: F.percentile(v, F.lit(0.99)),
    "rate": _rate,
}


def value_of(field: str, kind: str = "double", missing_as_zero: bool = False) -> Column:
    """A field as a double: null where it is missing or its type is not numeric."""
    numeric = F.lit(None).cast("double") if kind in ("string", "boolean", "binary") else F.col(field).cast("double")
    return F.coalesce(numeric, F.lit(0.0)) if missing_as_zero else numeric


def aggregate(m: Measurement, name: str, value: str) -> Column:
    """The aggregate of that name over a column of doubles; an unknown name is an error."""
    if name not in AGGREGATES:
        raise InvalidArgument(f"unknown aggregate {name!r}; known: {', '.join(AGGREGATES)}")
    return AGGREGATES[name](m, value)


def time_of(m: Measurement, name: str) -> Column:
    """The time an aggregate stands for: the latest of its points for `last`, else the earliest."""
    return F.max(m.time) if name == "last" else F.min(m.time)
