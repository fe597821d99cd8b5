"""Numbers and neighbours in an order, without a window over all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.model import Measurement


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the session's spark.checkpoint.dir. Where none is set, a local session gets a temporary folder, and any other is refused."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def numbered(df: DataFrame, by: list[str], into: str) -> DataFrame:
    """df with numbers from 1 in the order of columns that make rows unique.

    A range-partitioned sort is written; each partition's rows count on within it, and the partitions' sizes, one row each, give where
    it begins.
    """
    placed = written(df.orderBy(*by).withColumn("o_place", F.monotonically_increasing_id()))
    part = F.shiftright("o_place", 33)
    sizes = placed.groupBy(part.alias("o_part")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("o_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("o_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("o_begin"))
    number = F.col("o_begin") + F.col("o_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("o_part", part).join(F.broadcast(begins), "o_part").withColumn(into, number.cast("long")).drop("o_part", "o_place", "o_begin")


def _slices(m: Measurement, df: DataFrame, every: str) -> DataFrame:
    return df.withColumn("o_slice", F.date_trunc(every, F.col(m.time)).cast("timestamp_ntz"))


def _back(m: Measurement, df: DataFrame, ends: DataFrame) -> DataFrame:
    """df joined with a value of its series and slice; null tags are equal."""
    keys = [*m.tags, "o_slice"]
    renamed = ends.withColumnsRenamed({k: f"o_end_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"o_end_{k}"))
    return df.join(renamed, same, "left").drop("o_slice", *(f"o_end_{k}" for k in keys))


def with_previous(m: Measurement, value: Column, into: str, every: str = "day") -> DataFrame:
    """m's points with a value of the series' point before; null for a series' first point.

    A window holds one slice of a series, a day of it by default, and not all of it; the last values of slices, one row each, are carried to
    the next slice of the series. Names that start with o_ are used within.
    """
    x = _slices(m, m.source.withColumn("o_now", F.struct(value.alias("v"))), every)
    keys = [*m.tags, "o_slice"]
    ends = x.groupBy(*keys).agg(F.max_by("o_now", m.moment()).alias("o_last"))
    ends = ends.withColumn("o_before", F.lag("o_last").over(Window.partitionBy(*(m.tags or [F.lit(0)])).orderBy("o_slice"))).drop("o_last")
    x = x.withColumn("o_inside", F.lag("o_now").over(Window.partitionBy(*keys).orderBy(*m.order()))).drop("o_now")
    return _back(m, x, ends).withColumn(into, F.coalesce("o_inside", "o_before").getField("v")).drop("o_inside", "o_before")


def with_running_sum(m: Measurement, value: Column, into: str, every: str = "day") -> DataFrame:
    """m's points with the sum of a value up to each, made of sums within slices and of those of the slices before; see with_previous."""
    x = _slices(m, m.source.withColumn("o_now", value), every)
    keys = [*m.tags, "o_slice"]
    ahead = Window.partitionBy(*(m.tags or [F.lit(0)])).orderBy("o_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*keys).agg(F.sum("o_now").alias("o_sum")).withColumn("o_before", F.sum("o_sum").over(ahead)).drop("o_sum")
    inside = Window.partitionBy(*keys).orderBy(*m.order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("o_inside", F.sum("o_now").over(inside)).drop("o_now")
    total = F.when(F.col("o_inside").isNotNull() | F.col("o_before").isNotNull(), F.coalesce("o_inside", F.lit(0)) + F.coalesce("o_before", F.lit(0)))
    return _back(m, x, sums).withColumn(into, total).drop("o_inside", "o_before")
