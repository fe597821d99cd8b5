"""Changes between neighbouring points of a series. Windows hold a day of a series, see order.py."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import Measurement
from tidemark.operators.order import with_previous, with_running_sum


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def rate(m: Measurement, field: str | None = None) -> DataFrame:
    """Points with `rate`, the change per second since the series' point before; null for the first and where no time has passed."""
    f = F.col(m.field(field))
    x = with_previous(m, F.struct(f.alias("f"), F.col(m.time).alias("t")), "r_before")
    seconds = (_micros(F.col(m.time)) - _micros(F.col("r_before.t"))) / 1e6
    return x.withColumn("rate", (f - F.col("r_before.f")) / F.nullif(seconds, F.lit(0.0))).drop("r_before")


def delta(m: Measurement, field: str | None = None) -> DataFrame:
    """Points with `delta`: the first value of a series as it is, then differences."""
    f = F.col(m.field(field))
    return with_previous(m, f, "r_before").withColumn("delta", f - F.coalesce("r_before", F.lit(0))).drop("r_before")


def undelta(df: DataFrame, m: Measurement) -> DataFrame:
    """The values that `delta` came from, as `value`."""
    return with_running_sum(replace(m, source=df, fields=()), F.col("delta"), "value")


def delta_of_delta(m: Measurement) -> DataFrame:
    """Points with `step_us`, the time step in microseconds, and `dod_us`, its change; null for a series' first and first two points."""
    stepped = with_previous(m, F.col(m.time), "r_before").withColumn("step_us", _micros(F.col(m.time)) - _micros(F.col("r_before"))).drop("r_before")
    return with_previous(m.over(stepped), F.col("step_us"), "r_before").withColumn("dod_us", F.col("step_us") - F.col("r_before")).drop("r_before")
