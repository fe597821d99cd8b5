"""A database of measurements as day-partitioned Parquet under one root."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.config import Config
from tidemark.errors import Closed, NotFound
from tidemark.functions.predicates import Predicate, exact_set
from tidemark.model import Measurement
from tidemark.operators.maintenance import last_write_wins
from tidemark.operators.series import catalog
from tidemark.plans.query import Query
from tidemark.streaming import ingest as streams

DAY = "day"


class Database:
    """Measurements under root/<name>/day=yyyy-mm-dd/. One root per business keeps businesses apart.

    A write is one append of files that appear together when the job commits. Deletes and compaction rewrite
    only the days they touch, and drop the folders of days they empty. Nothing here holds points in memory.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.cache = ResultCache(self.config.cache_entries, self.config.cache_seconds)
        self._open = True
        self.recover()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Drop cached results; files need no flushing."""
        self.cache.clear()
        self._open = False

    def _path(self, name: str) -> str:
        if not self._open:
            raise Closed(self.root)
        return f"{self.root}/{name}"

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def measurements(self) -> list[str]:
        """Names of the measurements."""
        at, fs = self._hadoop(self._path(""))
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and not x.getPath().getName().startswith(".")) if fs.exists(at) else []

    def exists(self, name: str) -> bool:
        at, fs = self._hadoop(self._path(name))
        return fs.exists(at)

    def write(self, name: str, df: DataFrame, time_column: str = "ts", tags: tuple[str, ...] = ()) -> None:
        """Append points. Rows are dealt to days before the write, so each day gets few files; a large day gets more.

        Rebalancing sizes partitions by data, so a hot day is split; within a file rows are sorted by series and
        time, which makes footers' ranges narrow for both.
        """
        dated = df.withColumn(DAY, F.to_date(time_column))
        ordered = dated.hint("rebalance", DAY).sortWithinPartitions(DAY, *tags, time_column)
        ordered.write.mode("append").options(**self.config.writer_options(tags)).partitionBy(DAY).parquet(self._path(name))
        self.cache.clear()

    def read(self, name: str) -> DataFrame:
        """All rows of a measurement, with column day."""
        if not self.exists(name):
            raise NotFound(name)
        return self.spark.read.option("mergeSchema", "false").parquet(self._path(name))

    def measurement(self, name: str, time_column: str = "ts", tags: tuple[str, ...] = (), fields: tuple[str, ...] = (), tiebreak: tuple[str, ...] = ()) -> Measurement:
        """A measurement whose equal (series, time) rows mean what the configuration says; ranges of its queries prune days."""
        m = Measurement(self.read(name), time_column, tags, fields, tiebreak, name, DAY)
        return m if self.config.duplicates == "append" else m.over(last_write_wins(m, second=self.config.duplicates == "lww_second"))

    def query(self, m: Measurement) -> Query:
        return Query(m)

    def result(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        """A query's result from the cache, or made and cached."""
        return self.cache.get(key, make)

    # Rewriting

    def _rewrite(self, name: str, touched: Column, keep: Column | None, arrange: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
        """Rewrite the days that `touched` selects, with the rows that `keep` holds for; drop days left without rows.

        The rows go to a new folder beside the measurement first. Then each old day is moved aside before the new one takes its place, and the
        old days are deleted last, so `recover` can end a rewrite that was broken off anywhere.
        """
        stamp = time.time_ns()
        path, side, aside = self._path(name), f"{self.root}/.rewrite-{stamp}-{name}", f"{self.root}/.old-{stamp}-{name}"
        rows = self.read(name).where(touched)
        days = [str(r[0]) for r in rows.select(DAY).distinct().collect()]  # days, not rows: one value per folder
        if not days:
            return
        left = arrange(rows if keep is None else rows.where(keep))
        left.write.options(**self.config.writer_options()).partitionBy(DAY).parquet(side)
        at, fs = self._hadoop(aside)
        fs.mkdirs(at)
        for day in days:
            old, _ = self._hadoop(f"{path}/{DAY}={day}")
            fs.rename(old, self._hadoop(f"{aside}/{DAY}={day}")[0])
            self._publish(fs, side, path, f"{DAY}={day}")
        self._end(fs, aside, side)
        self.spark.catalog.refreshByPath(path)
        self.cache.clear()

    def _publish(self, fs, side: str, path: str, day: str) -> None:
        """Move a rewritten day to its place; a day without rows left has none."""
        new, _ = self._hadoop(f"{side}/{day}")
        if fs.exists(new):
            fs.rename(new, self._hadoop(f"{path}/{day}")[0])

    def _end(self, fs, aside: str, side: str) -> None:
        """A rewrite is over when its old days are gone; what is left of the new ones goes last."""
        for folder in (aside, side):
            fs.delete(self._hadoop(folder)[0], True)

    def recover(self) -> None:
        """End rewrites that were broken off: days moved aside get their new rows, and a rewrite that had moved none is undone.

        There is one writer at a time, so what is found on opening is left over.
        """
        at, fs = self._hadoop(self.root)
        left = {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()
        for side in sorted(x for x in left if x.startswith(".rewrite-")):
            aside = side.replace(".rewrite-", ".old-", 1)
            if aside in left:
                path = f"{self.root}/{side.split('-', 2)[2]}"
                for x in fs.listStatus(self._hadoop(f"{self.root}/{aside}")[0]):
                    day = x.getPath().getName()
                    if not fs.exists(self._hadoop(f"{path}/{day}")[0]):
                        self._publish(fs, f"{self.root}/{side}", path, day)
            self._end(fs, f"{self.root}/{aside}", f"{self.root}/{side}")

    def ingest(self, name: str, stream: DataFrame, checkpoint: str, time_column: str = "ts", once: bool = False) -> StreamingQuery:
        """Append a stream to a measurement, a batch every flush_ms; once: all there is, then stop."""
        return streams.ingest(stream, self._path(name), checkpoint, None if once else self.config.every(), time_column)

    def delete_range(self, name: str, start: object, end: object, time_column: str = "ts", condition: Predicate | None = None) -> None:
        """Delete points from start to end, both included; with a condition, only those that meet it."""
        low, high = (F.lit(str(x)).cast("timestamp_ntz") for x in (start, end))
        inside = F.coalesce(F.col(time_column).between(low, high), F.lit(False))
        inside = inside if condition is None else inside & condition.column
        self._rewrite(name, F.col(DAY).between(F.to_date(low), F.to_date(high)), ~inside)

    def delete_series(self, name: str, tags: dict[str, object], tag_columns: tuple[str, ...]) -> None:
        """Delete the points of the series with exactly these tags."""
        hit = exact_set(tags, tag_columns).column
        days = [r[0] for r in self.read(name).where(hit).select(DAY).distinct().collect()]
        self._rewrite(name, F.col(DAY).isin(days), ~hit)

    def delete_measurement(self, name: str) -> None:
        at, fs = self._hadoop(self._path(name))
        fs.delete(at, True)
        self.cache.clear()

    def expire(self, name: str, cutoff: object, time_column: str = "ts") -> None:
        """Delete points older than the cutoff. Whole days before it are dropped without being read."""
        limit = F.lit(str(cutoff)).cast("timestamp_ntz")
        last = str(self.spark.range(1).select(F.to_date(limit)).first()[0])
        for day in (d for d in self.days(name) if d < last):
            self.drop_day(name, day)
        if self.days(name):
            self._rewrite(name, F.col(DAY) == F.to_date(limit), F.col(time_column) >= limit)

    def days(self, name: str) -> list[str]:
        """Days that have a folder."""
        at, fs = self._hadoop(self._path(name))
        return sorted(x.getPath().getName().removeprefix(f"{DAY}=") for x in fs.listStatus(at) if x.getPath().getName().startswith(f"{DAY}="))

    def drop_day(self, name: str, day: str) -> None:
        at, fs = self._hadoop(f"{self._path(name)}/{DAY}={day}")
        fs.delete(at, True)
        self.spark.catalog.refreshByPath(self._path(name))
        self.cache.clear()

    def compact(self, name: str, time_column: str = "ts", tags: tuple[str, ...] = ()) -> None:
        """Rewrite days of several files with few files each, sorted by series and time. No row changes; a day of one file stays."""
        if days := [d for d in self.days(name) if self._files(name, d) > 1]:
            self._rewrite(name, F.col(DAY).isin([F.lit(d).cast("date") for d in days]), None, lambda d: d.hint("rebalance", DAY).sortWithinPartitions(DAY, *tags, time_column))

    def _files(self, name: str, day: str) -> int:
        at, fs = self._hadoop(f"{self._path(name)}/{DAY}={day}")
        return sum(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(at))

    def recompress(self, name: str, days: list[str], codec: str, level: int | None = None) -> None:
        """Rewrite some days with another codec, as when they turn warm or cold."""
        was = self.config
        self.config = Config(**{**was.__dict__, "codec": codec, "level": was.level if level is None else level})
        try:
            self._rewrite(name, F.col(DAY).isin([F.lit(d).cast("date") for d in days]), None)
        finally:
            self.config = was

    def recompress_by_age(self, name: str, now: date) -> None:
        """Rewrite days that have turned warm with zstd 4 and cold ones with zstd 9; hot days stay as they were written."""
        age = {d: (now - date.fromisoformat(d)).days for d in self.days(name)}
        for low, high, level in ((self.config.hot_days, self.config.warm_days, 4), (self.config.warm_days, None, 9)):
            if days := [d for d, n in age.items() if n >= low and (high is None or n < high)]:
                self.recompress(name, days, "zstd", level)

    def save_catalog(self, name: str, m: Measurement) -> DataFrame:
        """Write the series catalog beside the data, so that look-ups need not read points; it shows the time it was saved."""
        path = f"{self._path('.catalog')}/{name}"
        catalog(m).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def load_catalog(self, name: str) -> DataFrame:
        path = f"{self._path('.catalog')}/{name}"
        at, fs = self._hadoop(path)
        if not fs.exists(at):
            raise NotFound(f"no catalog of {name}")
        return self.spark.read.parquet(path)

    def stats(self, name: str, tags: tuple[str, ...] = ()) -> dict[str, int]:
        """Points, series, days and bytes of a measurement."""
        df = self.read(name)
        facts = df.groupBy(*(tags or [F.lit(0)])).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        at, fs = self._hadoop(self._path(name))
        return {"points": facts[0], "series": facts[1], "days": len(self.days(name)), "bytes": fs.getContentSummary(at).getLength()}


class ResultCache:
    """Persisted results of queries by key, least recently used ones dropped, each valid for some seconds."""

    def __init__(self, entries: int = 64, seconds: float = 300.0, dropped: Callable[[object], None] | None = None):
        self.entries, self.seconds, self.dropped = entries, seconds, dropped
        self.held: dict[object, tuple[float, DataFrame]] = {}
        self.hits = self.misses = self.evictions = 0

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.held.pop(key, None)
        if found and time.monotonic() - found[0] <= self.seconds:
            self.hits += 1
            self.held[key] = found
            return found[1]
        if found:
            self._drop(key, found[1])
        self.misses += 1
        df = make().persist()
        self.held[key] = (time.monotonic(), df)
        while len(self.held) > self.entries:
            oldest = next(iter(self.held))
            self._drop(oldest, self.held.pop(oldest)[1])
        return df

    def _drop(self, key: object, df: DataFrame) -> None:
        df.unpersist()
        self.evictions += 1
        if self.dropped:
            self.dropped(key)

    def remove(self, key: object) -> bool:
        """Drop one result; whether there was one."""
        found = self.held.pop(key, None)
        if found:
            found[1].unpersist()
        return found is not None

    def __contains__(self, key: object) -> bool:
        return key in self.held

    def clear(self) -> None:
        for _, df in self.held.values():
            df.unpersist()
        self.held.clear()

    def hit_rate(self) -> float:
        """Share of look-ups that hit; 0 before any."""
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0
