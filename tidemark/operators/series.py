"""The catalog of series, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import exact_set
from tidemark.model import Measurement
from tidemark.operators.order import numbered

#: Dictionaries of at most so many entries are sent to every task.
BROADCAST_ENTRIES = 100_000


def catalog(m: Measurement) -> DataFrame:
    """One row per series: tags, first and last time, number of points."""
    return m.source.groupBy(*m.tags).agg(F.min(m.time).alias("min_time"), F.max(m.time).alias("max_time"), F.count("*").alias("point_count"))


def overlapping(series: DataFrame, start: object, end: object) -> DataFrame:
    """Series with a point not before start and one not after end: those whose span meets the range."""
    at = lambda x: F.lit(str(x)).cast("timestamp_ntz")
    return series.where((F.col("max_time") >= at(start)) & (F.col("min_time") <= at(end)))


def with_exact_tags(m: Measurement, series: DataFrame, tags: dict[str, object]) -> DataFrame:
    """Series with exactly these tags."""
    return series.where(exact_set(tags, m.tags).column)


def counts(m: Measurement, measurement_column: str | None = None) -> DataFrame:
    """One row: number of series, of measurements and of points, first and last time."""
    series = m.source.groupBy(*m.tags, *([measurement_column] if measurement_column and measurement_column not in m.tags else [])).agg(F.count("*").alias("n"), F.min(m.time).alias("low"), F.max(m.time).alias("high"))
    measurements = F.countDistinct(measurement_column) if measurement_column else F.lit(1).cast("long")
    return series.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.count("*").alias("series"), measurements.alias("measurements"), F.min("low").alias("first_ts"), F.max("high").alias("last_ts"))


def measurements(df: DataFrame, column: str) -> DataFrame:
    """The different measurements."""
    return df.select(F.col(column).alias("measurement")).distinct()


def dictionary(df: DataFrame, tag: str) -> DataFrame:
    """Ids of a tag's values, from 1 in order of value. Values, not points, are numbered; null has none."""
    return numbered(df.where(F.col(tag).isNotNull()).select(F.col(tag).alias("value")).distinct(), ["value"], "id")


def encoded(df: DataFrame, tag: str, ids: DataFrame) -> DataFrame:
    """df with a tag's values replaced by their ids. The dictionary is broadcast up to BROADCAST_ENTRIES, else shuffled."""
    small = ids.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    table = ids.select(F.col("value").alias(tag), F.col("id").alias(f"{tag}_id"))
    return df.join(F.broadcast(table) if small else table, tag, "left").drop(tag)


def decoded(df: DataFrame, tag: str, ids: DataFrame) -> DataFrame:
    """The inverse of `encoded`."""
    small = ids.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    table = ids.select(F.col("id").alias(f"{tag}_id"), F.col("value").alias(tag))
    return df.join(F.broadcast(table) if small else table, f"{tag}_id", "left").drop(f"{tag}_id")
