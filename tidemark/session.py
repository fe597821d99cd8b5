"""Sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps buckets and day partitions alike everywhere; adaptive execution splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """A session with SETTINGS, changed or completed by `settings` (dots as double underscores)."""
    given = {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=SETTINGS | given).getOrCreate()
