"""Duplicates, deletes, retention and age tiers, as plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.predicates import Predicate, exact_set
from tidemark.model import Measurement


def _at(moment: object) -> Column:
    return moment if isinstance(moment, Column) else F.lit(str(moment)).cast("timestamp_ntz")


def last_write_wins(m: Measurement, second: bool = False) -> DataFrame:
    """One point per series and time, the last written (largest tiebreak); with `second`, per series and second, whatever its time within that.

    An aggregate, not a window: partial maxima are formed before the shuffle, so rewritten points cost little.
    """
    time = F.date_trunc("second", m.time).cast("timestamp_ntz") if second else F.col(m.time)
    rest = [c for c in m.source.columns if c not in m.tags]
    if not m.tiebreak:
        raise InvalidArgument("the last write can only be told by a tiebreak column, such as a running number of writes")
    picked = m.source.groupBy(*m.tags, time.alias("moment")).agg(F.max_by(F.struct(*rest), F.struct(*m.tiebreak)).alias("row"))
    columns = [F.col(c) if c in m.tags else F.col("moment").alias(c) if c == m.time else F.col(f"row.{c}").alias(c) for c in m.source.columns]
    return picked.select(*columns)


def without_range(m: Measurement, start: object, end: object, condition: Predicate | None = None) -> DataFrame:
    """Points outside a range (both ends in it); with a condition, only points that meet it are deleted."""
    inside = F.coalesce(F.col(m.time).between(_at(start), _at(end)), F.lit(False))
    return m.source.where(~(inside if condition is None else inside & condition.column))


def without_series(m: Measurement, tags: dict[str, object]) -> DataFrame:
    """Points of all series but the one with exactly these tags."""
    return m.source.where((~exact_set(tags, m.tags)).column)


def without_measurement(df: DataFrame, column: str, name: str) -> DataFrame:
    """Points of other measurements; names are compared whole."""
    return df.where(F.coalesce(F.col(column) != name, F.lit(True)))


def retained(m: Measurement, cutoff: object) -> DataFrame:
    """Points not older than the cutoff; one just at it stays."""
    return m.source.where(F.col(m.time) >= _at(cutoff))


def without_day(m: Measurement, day: str) -> DataFrame:
    """Points of other days (UTC)."""
    return m.source.where(F.coalesce(F.col(m.time).cast("date") != F.lit(day).cast("date"), F.lit(True)))


def tier(time: Column, now: object, hot_days: int = 7, warm_days: int = 30) -> Column:
    """hot under hot_days of age, warm under warm_days, else cold."""
    age = _at(now) - time
    return F.when(age < F.make_dt_interval(F.lit(hot_days)), "hot").when(age < F.make_dt_interval(F.lit(warm_days)), "warm").otherwise("cold")
