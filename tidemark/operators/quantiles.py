"""Exact quantiles whose memory doesn't grow with a group's values.

A sketch of fixed size gives each group two values that enclose the quantile, with a slack ten times the sketch's error. A second pass counts
the values below them in place and keeps, per group, only the different values between them: some 2 in 1,000 of a large group, and all of
one under 2,000. Those are sorted with their running counts, with spill, and the ones at the quantile's positions are taken. So nothing is
held whole, and the result is that of sorting every value. Should a sketch ever enclose the wrong values, the query fails; it never answers wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a group's values below each quantile.
SHARES = {"median": 0.5, "p95": 0.95, "p99": 0.99}
ACCURACY = 10_000
SLACK = 10 / ACCURACY


def _positions(name: str, n: Column) -> tuple[Column, Column]:
    """The position from 0 among n sorted values, and the whole one at or below it. The median is the upper one of two."""
    at = F.floor(n / 2).cast("double") if name == "median" else (n - 1) * F.lit(SHARES[name])
    return at, F.floor(at).cast("long")


def with_quantile(out: DataFrame, points: DataFrame, keys: list[str], value: str, name: str, into: str) -> DataFrame:
    """out, which has one row for each value of the keys in points, with a quantile of a column of doubles.

    Nulls are left out and NaN is the largest value; null keys are equal; a group without values gets null. Names that start with q_ are used within.
    """
    x = points.select(*keys, F.col(value).alias("q_v")).where("q_v IS NOT NULL")
    ends = F.percentile_approx("q_v", [max(SHARES[name] - SLACK, 0.0), min(SHARES[name] + SLACK, 1.0)], ACCURACY)
    sketch = F.struct(F.count("*").alias("n"), ends.alias("ends"))
    if keys:
        x = _beside(x, x.groupBy(*keys).agg(sketch.alias("q_sketch")), keys)
    else:  # one row
        x = x.withColumn("q_sketch", x.agg(sketch.alias("q_sketch")).scalar())
    low, high = (F.when(F.col("q_sketch.n") * SLACK >= 2, F.col("q_sketch.ends")[i]) for i in (0, 1))  # the slack is to be a place or more
    below, above = (F.coalesce(c, F.lit(False)) for c in (F.col("q_v") < low, F.col("q_v") > high))
    counted = x.where(~above).groupBy(*keys, F.col("q_sketch.n").alias("q_n"), F.when(~below, F.col("q_v")).alias("q_v")).agg(F.count("*").alias("q_count"))
    so_far = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("q_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("q_upto", F.sum("q_count").over(so_far))
    at, lower = _positions(name, F.col("q_n"))
    holds = lambda place: (place < F.col("q_upto")) & (place >= F.col("q_upto") - F.col("q_count"))
    picked = counted.groupBy(*keys).agg(
        F.max("q_n").alias("q_n"), F.max(F.when(holds(lower), F.col("q_v"))).alias("q_low"), F.max(F.when(holds(F.ceil(at).cast("long")), F.col("q_v"))).alias("q_high"))
    part = at - lower
    between = F.when((part == 0) | (F.col("q_low") == F.col("q_high")), F.col("q_low")).otherwise((1 - part) * F.col("q_low") + part * F.col("q_high"))
    missed = F.col("q_n").isNotNull() & (F.col("q_low").isNull() | F.col("q_high").isNull())
    picked = picked.select(*keys, F.when(missed, F.raise_error(F.lit(f"the sketch for {name} doesn't enclose it")).cast("double")).otherwise(between).alias(into))
    if keys:
        return _beside(out, picked, keys, "left")
    return out.withColumn(into, picked.scalar())


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with columns of the same keys; null keys are equal."""
    renamed = other.withColumnsRenamed({k: f"q_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"q_{k}"))
    return df.join(renamed, same, how).drop(*(f"q_{k}" for k in keys))
