"""Ad-hoc points: rows of measurement, time, tags and fields."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument
from tidemark.functions.scalar import from_ns, series_id

SCHEMA = T.StructType([
    T.StructField("measurement", T.StringType(), False), T.StructField("ts_ns", T.LongType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("floats", T.MapType(T.StringType(), T.DoubleType()), False), T.StructField("ints", T.MapType(T.StringType(), T.LongType()), False),
    T.StructField("strings", T.MapType(T.StringType(), T.StringType()), False), T.StructField("bools", T.MapType(T.StringType(), T.BooleanType()), False), T.StructField("seq", T.LongType(), False),
])


@dataclass
class Point:
    """A point under construction. Without a time it gets the time of the query that writes it; any whole number is a time, 0 too."""

    measurement: str
    ts_ns: int | None = None
    tags: dict[str, str] = field(default_factory=dict)
    fields: dict[str, float | int | str | bool] = field(default_factory=dict)

    def tag(self, key: str, value: str) -> Point:
        if key in self.tags:
            raise InvalidArgument(f"tag {key!r} is set twice")
        self.tags[key] = value
        return self

    def set(self, name: str, value: float | int | str | bool) -> Point:
        """A field; its Python type is its type."""
        self.fields[name] = value
        return self

    def value(self, value: float) -> Point:
        """The field named value."""
        return self.set("value", float(value))


def points(spark: SparkSession, rows: Iterable[Point], first_seq: int = 0) -> DataFrame:
    """Points as a DataFrame: measurement, ts_ns, ts, tags, maps of fields by type, value (the field of that name, or the first numeric one), seq, series_id."""
    out = []
    for n, p in enumerate(rows):
        by = {k: {f: v for f, v in p.fields.items() if type(v) is k} for k in (float, int, str, bool)}
        ns = int(p.ts_ns.timestamp() * 1e9) if isinstance(p.ts_ns, datetime) else p.ts_ns
        out.append((p.measurement, ns, p.tags, by[float], by[int], by[str], by[bool], first_seq + n))
    df = spark.createDataFrame(out, SCHEMA)
    df = df.withColumn("ts_ns", F.coalesce("ts_ns", F.unix_micros(F.current_timestamp()) * 1000)).withColumn("ts", from_ns(F.col("ts_ns")))
    firsts = [F.element_at(F.map_values("floats"), 1), F.element_at(F.map_values("ints"), 1).cast("double")]
    first = F.coalesce(F.element_at("floats", F.lit("value")), F.element_at("ints", F.lit("value")).cast("double"), *(F.when(F.size(c) > 0, f) for c, f in zip(("floats", "ints"), firsts, strict=True)))
    return df.withColumn("value", first).withColumn("series_id", series_id(F.col("measurement"), F.col("tags")))
