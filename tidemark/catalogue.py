"""Named queries over the sample tables and the SQL they are compared with."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions import codecs, scalar
from tidemark.functions.predicates import Predicate, exact_set, tag
from tidemark.model import Measurement
from tidemark.operators import maintenance, rates, rollup, series
from tidemark.plans.query import Query
from tidemark.plans.routing import Router
from tidemark.sources.points import Point, points
from tidemark.sources.store import Database, ResultCache
from tidemark.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
FROM, TO = "2024-01-01 00:00:00", "2024-01-15 12:00:00"
IN_RANGE = f"ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"
POINT = "ts, event_type, user_id, value, event_id"


def _named(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def events(spark: SparkSession, sf_dir: str, *tags: str) -> Measurement:
    """Events with tags event_type and user_id, or those given."""
    return Measurement(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", tags or ("event_type", "user_id"), ("value",), ("event_id",), "events")


def items(spark: SparkSession, sf_dir: str) -> Measurement:
    """Line items by flag and status, at a day's grain, so that many are of equal time."""
    return Measurement(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "lineitem",
    )


def orders(spark: SparkSession, sf_dir: str) -> Measurement:
    return Measurement(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",), ("o_orderkey",), "orders")


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """df with sums and means rounded, since their last digits depend on the order of addition."""
    return df.withColumns({c: F.round(c, to) for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly summary of events by type over the first half of January, errors left out."""
    q = Query(events(spark, sf_dir)).range(FROM, TO).where(tag("event_type") != "error").group_by("event_type").bucket("1 hour")
    for name in ("count", "sum", "avg", "min", "max", "first", "last"):
        q = q.agg(name)
    return rounded(q.df(), "sum", "avg")


_named(f"""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(value) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
  arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, count(*) AS points FROM events WHERE {IN_RANGE} AND event_type <> 'error' GROUP BY 1, 2""")(flagship)


# Scans, predicates, order


@_named(f"SELECT {POINT} FROM events WHERE {IN_RANGE}")
def range_scan(spark, sf_dir):
    return Query(events(spark, sf_dir)).range(FROM, TO).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE {IN_RANGE} ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def range_scan_desc_limit_offset(spark, sf_dir):
    return Query(events(spark, sf_dir)).range(FROM, TO).order(ascending=False).limit(50).offset(20).df()


@_named(f"SELECT {POINT} FROM events WHERE {IN_RANGE} ORDER BY ts, event_id LIMIT 10")
def range_first_ten(spark, sf_dir):
    return Query(events(spark, sf_dir)).range(FROM, TO).limit(10).df()


@_named(f"SELECT {POINT} FROM events")
def range_unbounded(spark, sf_dir):
    return Query(events(spark, sf_dir)).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE ts >= TIMESTAMP '{TO}'")
def range_open_end(spark, sf_dir):
    return Query(events(spark, sf_dir)).range(start=TO).unordered().df()


@_named(f"SELECT {POINT} FROM events LIMIT 0")
def limit_zero(spark, sf_dir):
    return Query(events(spark, sf_dir)).limit(0).df()


def _where(name: str, condition: Callable[[], Predicate], sql: str) -> None:
    def run(spark, sf_dir):
        return Query(events(spark, sf_dir)).where(condition()).unordered().df()

    run.__name__ = name
    _named(f"SELECT {POINT} FROM events WHERE {sql}")(run)


_where("tag_eq", lambda: tag("event_type") == "click", "event_type = 'click'")
_where("tag_ne", lambda: tag("event_type") != "click", "COALESCE(event_type <> 'click', true)")
_where("tag_lt", lambda: tag("event_type") < "error", "event_type < 'error'")
_where("tag_le", lambda: tag("event_type") <= "error", "event_type <= 'error'")
_where("tag_gt", lambda: tag("event_type") > "error", "event_type > 'error'")
_where("tag_ge", lambda: tag("event_type") >= "error", "event_type >= 'error'")
_where("tag_regex", lambda: tag("event_type").matches("^(p|s).*[ep]$"), "regexp_matches(event_type, '^(p|s).*[ep]$')")
_where("tag_and_or_not", lambda: ~(tag("event_type") == "view") & ((tag("user_id") < 20) | (tag("event_type") == "signup")), "NOT (event_type = 'view') AND (user_id < 20 OR event_type = 'signup')")
_where("field_predicate", lambda: Predicate(F.col("value") > 100), "value > 100")


def _sparse(spark, sf_dir) -> Measurement:
    """Events whose type is missing for each third user."""
    m = events(spark, sf_dir)
    return m.over(m.source.withColumn("event_type", F.when(F.col("user_id") % 3 != 0, F.col("event_type"))))


SPARSE = "(SELECT event_id, ts, user_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS event_type, value FROM events)"


@_named(f"SELECT {POINT} FROM {SPARSE} WHERE COALESCE(event_type <> 'click', true)")
def tag_ne_missing(spark, sf_dir):
    return Query(_sparse(spark, sf_dir)).where(tag("event_type") != "click").unordered().df()


@_named(f"SELECT {POINT} FROM {SPARSE} WHERE NOT COALESCE(event_type = 'click' OR event_type < 'd', false)")
def tag_not_missing(spark, sf_dir):
    return Query(_sparse(spark, sf_dir)).where(~((tag("event_type") == "click") | (tag("event_type") < "d"))).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE event_type = 'view' AND user_id = 7")
def tag_conjunction(spark, sf_dir):
    return Query(events(spark, sf_dir)).tagged(event_type="view", user_id=7).unordered().df()


@_named(f"SELECT {POINT} FROM {SPARSE} WHERE event_type IS NULL AND user_id = 9")
def tag_exact_set(spark, sf_dir):
    m = _sparse(spark, sf_dir)
    return Query(m).where(exact_set({"user_id": 9}, m.tags)).unordered().df()


@_named("SELECT event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def field_projection(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return Query(Measurement(source, "ts", ("event_type",), ("value", "k"), ("event_id",))).select("k").unordered().df()


# Aggregates


def _aggregate(name: str, sql: str, time: str = "min(ts)", places: int | None = None) -> None:
    shown = f"round({sql}, {places})" if places else sql

    def whole(spark, sf_dir):
        df = Query(events(spark, sf_dir)).range(FROM, TO).agg(name, into="result").df()
        return rounded(df, "result", to=places) if places else df

    def by_tag(spark, sf_dir):
        df = Query(events(spark, sf_dir)).range(FROM, TO).group_by("event_type").agg(name, into="result").unordered().df()
        return rounded(df, "result", to=places) if places else df

    whole.__name__, by_tag.__name__ = f"agg_{name}", f"group_{name}"
    _named(f"SELECT {shown} AS result, {time} AS time, count(*) AS points FROM events WHERE {IN_RANGE}")(whole)
    _named(f"SELECT event_type, {shown} AS result, {time} AS time, count(*) AS points FROM events WHERE {IN_RANGE} GROUP BY 1")(by_tag)


_aggregate("count", "count(value)")
_aggregate("sum", "sum(value)", places=4)
_aggregate("avg", "avg(value)", places=6)
_aggregate("min", "min(value)")
_aggregate("max", "max(value)")
_aggregate("first", "arg_min(value, (ts, event_id))")
_aggregate("last", "arg_max(value, (ts, event_id))", "max(ts)")
_aggregate("stddev", "stddev_pop(value)", places=6)
_aggregate("median", "quantile_disc(value, 0.5 ORDER BY value DESC)")
_aggregate("p95", "quantile_cont(value, 0.95)", places=6)
_aggregate("p99", "quantile_cont(value, 0.99)", places=6)
_aggregate("rate", "(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0)", places=9)


@_named("SELECT count(value) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high, count(*) AS points FROM events WHERE ts > TIMESTAMP '2030-01-01'")
def agg_empty(spark, sf_dir):
    q = Query(events(spark, sf_dir)).range("2030-01-01 00:00:00.000001")
    return q.agg("count", into="n").agg("sum", into="total").agg("avg", into="mean").agg("min", into="low").agg("max", into="high").df()


@_named("SELECT event_type, round(avg(COALESCE(CASE WHEN value > 50 THEN value END, 0)), 6) AS mean, count(*) AS n, count(*) AS points FROM events GROUP BY 1")
def agg_missing_as_zero(spark, sf_dir):
    m = events(spark, sf_dir)
    m = m.over(m.source.withColumn("value", F.when(F.col("value") > 50, F.col("value"))))
    return rounded(Query(m).missing_as_zero().group_by("event_type").agg("avg", into="mean").agg("count", into="n").unordered().df(), "mean")


@_named("SELECT event_type, user_id, count(value) AS count, max(value) AS max, count(*) AS points FROM events GROUP BY 1, 2")
def group_by_series(spark, sf_dir):
    return Query(events(spark, sf_dir)).group_by("event_type", "user_id").agg("count").agg("max").unordered().df()


@_named("SELECT event_type, count(value) AS result, min(ts) AS time, count(*) AS points FROM " + SPARSE + " GROUP BY 1")
def group_by_missing_tag(spark, sf_dir):
    return Query(_sparse(spark, sf_dir)).group_by("event_type").agg("count", into="result").unordered().df()


# Buckets and rollups


def _bucket(name: str, every: str, sql: str) -> None:
    def run(spark, sf_dir):
        q = Query(events(spark, sf_dir)).group_by("event_type").bucket(every)
        return rounded(q.agg("count").agg("sum").agg("last").unordered().df(), "sum")

    run.__name__ = name
    _named(f"SELECT event_type, {sql} AS bucket, count(value) AS count, round(sum(value), 6) AS sum, arg_max(value, (ts, event_id)) AS last, count(*) AS points FROM events GROUP BY 1, 2")(run)


_bucket("bucket_30s", "30 seconds", "time_bucket(INTERVAL '30 seconds', ts)")
_bucket("bucket_60s", "60 seconds", "time_bucket(INTERVAL '60 seconds', ts)")
_bucket("bucket_hour", "1 hour", "time_bucket(INTERVAL '1 hour', ts)")
_bucket("bucket_day", "1 day", "time_bucket(INTERVAL '1 day', ts)")
_bucket("bucket_week", "week", "CAST(date_trunc('week', ts) AS TIMESTAMP)")
_bucket("bucket_month", "month", "CAST(date_trunc('month', ts) AS TIMESTAMP)")


@_named("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS points, count(*) AS unpacked FROM events GROUP BY 1, 2")
def block_pack(spark, sf_dir):
    packed = rollup.blocks(events(spark, sf_dir, "event_type"), "1 hour")
    return packed.select("event_type", "bucket", "points", F.size("packed").cast("long").alias("unpacked"))


@_named("SELECT event_type, ts, value FROM events")
def block_unpack(spark, sf_dir):
    return rollup.unblocked(rollup.blocks(events(spark, sf_dir, "event_type"), "30 seconds"), ("event_type",))


def _summary_sql(table: str, dims: str, bucket: str, time: str, field: str) -> str:
    return f"SELECT {dims}, {bucket} AS bucket, round(sum({field}), 4) AS sum, min({field}) AS min, max({field}) AS max, round(avg({field}), 6) AS avg, count({field}) AS count, min({time}) AS first_ts, max({time}) AS last_ts FROM {table} GROUP BY ALL"


def _summary(df: DataFrame) -> DataFrame:
    return df.withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@_named(_summary_sql("events", "event_type", "time_bucket(INTERVAL '1 hour', ts)", "ts", "value"))
def rollup_summary_hourly(spark, sf_dir):
    return _summary(rollup.rollup(events(spark, sf_dir), "1 hour", ("event_type",)))


@_named(_summary_sql("events", "event_type", "time_bucket(INTERVAL '1 day', ts)", "ts", "value"))
def rollup_summary_daily(spark, sf_dir):
    return _summary(rollup.rollup(events(spark, sf_dir), "1 day", ("event_type",)))


@_named(_summary_sql("orders", "o_orderstatus", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "o_orderdate", "o_totalprice"))
def rollup_summary_monthly(spark, sf_dir):
    return _summary(rollup.rollup(orders(spark, sf_dir), "month", ("o_orderstatus",)))


@_named(_summary_sql("events", "event_type", "time_bucket(INTERVAL '1 day', ts)", "ts", "value"))
def rollup_reaggregate(spark, sf_dir):
    return _summary(rollup.coarser(rollup.rollup(events(spark, sf_dir), "1 hour", ("event_type",)), "1 day", ("event_type",)))


@_named(_summary_sql("orders", "o_orderpriority", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "o_orderdate", "o_totalprice"))
def rollup_day_to_month(spark, sf_dir):
    return _summary(rollup.coarser(rollup.rollup(orders(spark, sf_dir), "1 day", ("o_orderpriority",)), "month", ("o_orderpriority",)))


@_named(_summary_sql("events", "event_type", "time_bucket(INTERVAL '1 day', ts)", "ts", "value"))
def rollup_merge(spark, sf_dir):
    m = events(spark, sf_dir)
    half = lambda odd: rollup.rollup(m.over(m.source.where(F.col("event_id") % 2 == odd)), "1 day", ("event_type",))
    return _summary(rollup.merged(half(0), half(1), ("event_type",)))


@_named("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, round(sum(l_quantity), 4) AS sum, count(l_quantity) AS count, round(avg(l_quantity), 6) AS avg FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_dimensions(spark, sf_dir):
    return _summary(rollup.by_hierarchy(items(spark, sf_dir), ("l_returnflag", "l_linestatus"), "l_quantity"))


@_named("""WITH r AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, bucket, n, lag(n) OVER w AS previous, n - lag(n) OVER w AS delta FROM r WINDOW w AS (PARTITION BY event_type ORDER BY bucket)""")
def trend_delta(spark, sf_dir):
    daily = rollup.rollup(events(spark, sf_dir), "1 day", ("event_type",)).select("event_type", "bucket", F.col("count").alias("n"))
    return rollup.trend(daily, "n", ("event_type",))


@_named(_summary_sql("orders", "o_orderstatus", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "o_orderdate", "o_totalprice"))
def rollup_routed(spark, sf_dir):
    """Months by status, answered from a rollup of days by status and priority."""
    m = orders(spark, sf_dir)
    both = ("o_orderstatus", "o_orderpriority")
    return _summary(Router(m).keep("1 day", both, rollup.rollup(m, "1 day", both)).summary("month", ("o_orderstatus",)))


# Rates


@_named("""SELECT event_id, round((value - lag(value) OVER w) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0), 9) AS rate FROM events
WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)""")
def rate_series(spark, sf_dir):
    return rounded(rates.rate(events(spark, sf_dir)), "rate", to=9).select("event_id", "rate")


@_named("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - lag(l_quantity) OVER w) / nullif((epoch_us(l_shipdate) - epoch_us(lag(l_shipdate) OVER w)) / 1e6, 0), 9) AS rate FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def rate_with_ties(spark, sf_dir):
    return rounded(rates.rate(items(spark, sf_dir), "l_quantity"), "rate", to=9).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rate")


@_named("SELECT event_id, round(value - COALESCE(lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id), 0), 6) AS delta FROM events")
def delta_encode(spark, sf_dir):
    return rounded(rates.delta(events(spark, sf_dir)), "delta").select("event_id", "delta")


@_named("SELECT event_id, round(value, 4) AS value FROM events")
def delta_decode(spark, sf_dir):
    m = events(spark, sf_dir)
    return rounded(rates.undelta(rates.delta(m), m), "value", to=4).select("event_id", "value")


@_named("""SELECT event_id, step_us, step_us - lag(step_us) OVER w AS dod_us FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)) AS step_us FROM events)
WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)""")
def delta_of_delta(spark, sf_dir):
    return rates.delta_of_delta(events(spark, sf_dir)).select("event_id", "step_us", "dod_us")


# Series

CATALOG = "SELECT event_type, user_id, min(ts) AS min_time, max(ts) AS max_time, count(*) AS point_count FROM events GROUP BY 1, 2"


@_named(CATALOG)
def series_catalog(spark, sf_dir):
    return series.catalog(events(spark, sf_dir))


@_named(CATALOG + " HAVING max(ts) >= TIMESTAMP '2024-01-10' AND min(ts) <= TIMESTAMP '2024-01-11'")
def series_by_time_overlap(spark, sf_dir):
    return series.overlapping(series.catalog(events(spark, sf_dir)), "2024-01-10 00:00:00", "2024-01-11 00:00:00")


@_named(CATALOG + " HAVING event_type = 'view' AND user_id = 7")
def series_by_exact_tags(spark, sf_dir):
    m = events(spark, sf_dir)
    return series.with_exact_tags(m, series.catalog(m), {"event_type": "view", "user_id": 7})


@_named("SELECT count(*) AS points, count(DISTINCT (event_type, user_id)) AS series, count(DISTINCT event_type) AS measurements, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def series_count(spark, sf_dir):
    return series.counts(events(spark, sf_dir), "event_type")


@_named("SELECT DISTINCT event_type AS measurement FROM events")
def measurement_list(spark, sf_dir):
    return series.measurements(events(spark, sf_dir).source, "event_type")


@_named()
def series_id_fnv(spark, sf_dir):
    """Numbers of series, and FNV-1a of their types."""
    m = events(spark, sf_dir)
    return series.catalog(m).select("event_type", "user_id", m.series_id().alias("series_id"), scalar.fnv1a64(F.col("event_type")).alias("fnv"))


@_named("""SELECT event_type, CAST(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END AS BIGINT) AS fnv FROM (
  SELECT event_type, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, length(event_type) + 1), lambda i: ascii(substr(event_type, i, 1))::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM (SELECT DISTINCT event_type FROM events))""")
def fnv_hash(spark, sf_dir):
    return events(spark, sf_dir).source.select("event_type").distinct().withColumn("fnv", scalar.fnv1a64(F.col("event_type")))


_BUILT = "(VALUES (0, 'cpu', 'a', 1.5, 7, NULL, true), (1, 'cpu', 'b', NULL, 3, 'warm', NULL), (2, 'mem', 'a', 2.0, NULL, NULL, NULL), (3, 'cpu', NULL, -1.0, NULL, NULL, false)) AS p(seq, measurement, host, v, i, s, b)"


@_named(f"SELECT seq::BIGINT AS seq, measurement, host, make_timestamp(1704067200000000 + seq * 1000000) AS ts, v::DOUBLE AS v, i::BIGINT AS i, s, b, coalesce(v::DOUBLE, i::DOUBLE) AS value FROM {_BUILT}")
def points_built(spark, sf_dir):
    """Points made one by one, with tags and typed fields."""
    rows = [("cpu", "a", {"v": 1.5, "i": 7, "b": True}), ("cpu", "b", {"i": 3, "s": "warm"}), ("mem", "a", {"v": 2.0}), ("cpu", None, {"v": -1.0, "b": False})]
    made = []
    for n, (measurement, host, fields) in enumerate(rows):
        p = Point(measurement, (1_704_067_200 + n) * 1_000_000_000)
        p = p if host is None else p.tag("host", host)
        for k, v in fields.items():
            p.set(k, v)
        made.append(p)
    df = points(spark, made)
    get = lambda kind, k: F.element_at(kind, F.lit(k)).alias(k)
    return df.select("seq", "measurement", get("tags", "host"), "ts", get("floats", "v"), get("ints", "i"), get("strings", "s"), get("bools", "b"), "value")


@_named("SELECT value, dense_rank() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT event_type AS value FROM events)")
def tag_dictionary(spark, sf_dir):
    return series.dictionary(events(spark, sf_dir).source, "event_type")


@_named("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) AS BIGINT) AS event_type_id FROM events")
def tag_encode(spark, sf_dir):
    df = events(spark, sf_dir).source.select("event_id", "event_type")
    return series.encoded(df, "event_type", series.dictionary(df, "event_type"))


@_named("SELECT event_id, event_type FROM events")
def tag_decode(spark, sf_dir):
    df = events(spark, sf_dir).source.select("event_id", "event_type")
    ids = series.dictionary(df, "event_type")
    return series.decoded(series.encoded(df, "event_type", ids), "event_type", ids)


@_named("SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) // 1000000 AS seconds, strftime(ts, '%Y%m%d') AS day_key, 'H:events:hourly:' || strftime(ts, '%Y%m%d%H') AS hour_key, ts AS back FROM events")
def time_keys(spark, sf_dir):
    ns = scalar.to_ns(F.col("ts"))
    return events(spark, sf_dir).source.select("event_id", ns.alias("ts_ns"), scalar.second_of_ns(ns).alias("seconds"), scalar.date_key(F.col("ts")).alias("day_key"), scalar.rollup_key(F.lit("events"), "hourly", F.col("ts")).alias("hour_key"), scalar.from_ns(ns).alias("back"))


# Duplicates, deletes, retention



@_named("SELECT l_returnflag, l_linestatus, l_shipdate, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS l_quantity FROM lineitem GROUP BY 1, 2, 3")
def lww_dedup(spark, sf_dir):
    return maintenance.last_write_wins(items(spark, sf_dir)).select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")


@_named("SELECT event_type, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def lww_second(spark, sf_dir):
    return maintenance.last_write_wins(events(spark, sf_dir, "event_type"), second=True).select("event_type", "ts", "value")


@_named(f"SELECT {POINT} FROM events WHERE NOT ({IN_RANGE})")
def delete_range(spark, sf_dir):
    m = events(spark, sf_dir)
    return Query(m.over(maintenance.without_range(m, FROM, TO))).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE NOT ({IN_RANGE} AND event_type = 'click')")
def delete_range_of_tag(spark, sf_dir):
    m = events(spark, sf_dir)
    return Query(m.over(maintenance.without_range(m, FROM, TO, tag("event_type") == "click"))).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE NOT (event_type = 'view' AND user_id = 7)")
def delete_series(spark, sf_dir):
    m = events(spark, sf_dir)
    return Query(m.over(maintenance.without_series(m, {"event_type": "view", "user_id": 7}))).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE event_type <> 'view'")
def delete_measurement(spark, sf_dir):
    m = events(spark, sf_dir)
    return Query(m.over(maintenance.without_measurement(m.source, "event_type", "view"))).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def retention_ttl(spark, sf_dir):
    m = events(spark, sf_dir)
    return Query(m.over(maintenance.retained(m, "2024-01-20 00:00:00"))).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-05'")
def drop_day(spark, sf_dir):
    m = events(spark, sf_dir)
    return Query(m.over(maintenance.without_day(m, "2024-01-05"))).unordered().df()


@_named("""SELECT tier, count(*) AS points FROM (SELECT CASE WHEN TIMESTAMP '2024-02-08' - ts < INTERVAL '7 days' THEN 'hot' WHEN TIMESTAMP '2024-02-08' - ts < INTERVAL '30 days' THEN 'warm' ELSE 'cold' END AS tier FROM events) GROUP BY 1""")
def tier_classify(spark, sf_dir):
    return events(spark, sf_dir).source.groupBy(maintenance.tier(F.col("ts"), "2024-02-08 00:00:00").alias("tier")).agg(F.count("*").alias("points"))


@_named("SELECT count(*) AS points, count(DISTINCT (event_type, user_id)) AS series, CAST(1 AS BIGINT) AS measurements, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def stats(spark, sf_dir):
    return series.counts(events(spark, sf_dir))


@_named("SELECT event_type, bucket, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS bucket FROM events) GROUP BY 1, 2")
def codec_round_trip(spark, sf_dir):
    """Values of daily blocks that come back equal from the packed form."""
    packed = rollup.blocks(events(spark, sf_dir, "event_type"), "1 day").withColumn("values", F.col("packed.value"))
    coded = packed.withColumn("back", codecs.unpacked(codecs.packed(F.col("values"))))
    return coded.select("event_type", "bucket", F.aggregate(F.zip_with("values", "back", lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))


# Stores and streams; these write to a temporary folder beside the checkpoints


def _folder(spark: SparkSession) -> str:
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/tidemark-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidArgument("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def _stored(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, _folder(spark))
    db.write("events", events(spark, sf_dir).source, "ts", ("event_type", "user_id"))
    return db


def _of(db: Database) -> Measurement:
    return db.measurement("events", "ts", ("event_type", "user_id"), ("value",), ("event_id",))


@_named(f"SELECT {POINT} FROM events WHERE {IN_RANGE}")
def store_range(spark, sf_dir):
    return Query(_of(_stored(spark, sf_dir))).range(FROM, TO).unordered().df()


@_named(f"SELECT {POINT} FROM events")
def compact_layout(spark, sf_dir):
    db = _stored(spark, sf_dir)
    db.compact("events", "ts", ("event_type", "user_id"))
    return Query(_of(db)).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06 12:00:00') AND ts >= TIMESTAMP '2024-01-02 06:00:00' AND NOT (event_type = 'view' AND user_id = 7)")
def store_deletes(spark, sf_dir):
    db = _stored(spark, sf_dir)
    db.delete_range("events", "2024-01-03 00:00:00", "2024-01-06 12:00:00")
    db.expire("events", "2024-01-02 06:00:00")
    db.delete_series("events", {"event_type": "view", "user_id": 7}, ("event_type", "user_id"))
    return Query(_of(db)).unordered().df()


@_named("SELECT event_type, user_id, min(ts) AS min_time, max(ts) AS max_time, count(*) AS point_count FROM events GROUP BY 1, 2")
def catalog_saved(spark, sf_dir):
    db = _stored(spark, sf_dir)
    db.save_catalog("events", _of(db))
    return db.load_catalog("events")


@_named(f"SELECT {POINT} FROM events")
def codec_by_age(spark, sf_dir):
    db = _stored(spark, sf_dir)
    db.recompress_by_age("events", date(2024, 2, 5))
    return Query(_of(db)).unordered().df()


@_named(f"SELECT {POINT} FROM events WHERE {IN_RANGE}")
def cached_result(spark, sf_dir):
    cache = ResultCache(4)
    make = lambda: Query(events(spark, sf_dir)).range(FROM, TO).unordered().df()
    cache.get("range", make)
    return cache.get("range", make)


@_named("SELECT l_returnflag, count(*) AS points FROM lineitem GROUP BY 1")
def databases_apart(spark, sf_dir):
    """Two databases with a measurement of one name; deleting it in one leaves the other's."""
    one, two = (Database(spark, _folder(spark)) for _ in range(2))
    one.write("m", events(spark, sf_dir).source, "ts", ("event_type",))
    two.write("m", items(spark, sf_dir).source, "l_shipdate", ("l_returnflag",))
    one.delete_measurement("m")
    return two.read("m").groupBy("l_returnflag").agg(F.count("*").alias("points"))


def _event_files(spark: SparkSession, sf_dir: str, folder: str, parts: int = 4) -> DataFrame:
    df = events(spark, sf_dir).source
    df.repartitionByRange(parts, "event_id").write.parquet(f"{folder}/in")
    return ingest.files(spark, f"{folder}/in", df.schema)


@_named(f"SELECT {POINT} FROM events")
def stream_ingest(spark, sf_dir):
    folder = _folder(spark)
    ingest.ingest(_event_files(spark, sf_dir, folder), f"{folder}/out", f"{folder}/log", day="ts").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("ts", "event_type", "user_id", "value", "event_id")


@_named("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last,
  min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS avg FROM events GROUP BY 1, 2""")
def stream_rollup_hourly(spark, sf_dir):
    folder = _folder(spark)
    rolled = ingest.rollup(_event_files(spark, sf_dir, folder), "ts", "1 hour", ("event_type",), "value", ("event_id",), late="40 days")
    ingest.keep_latest(rolled, f"{folder}/rolled", f"{folder}/log").awaitTermination()
    return _summary(ingest.latest(spark, f"{folder}/rolled", ("event_type",)))


LATE = "2024-01-10 00:00:00"


@_named(f"SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(sum(value), 4) AS sum, count(value) AS count FROM events WHERE ts >= TIMESTAMP '{LATE}' GROUP BY 1, 2")
def stream_late_points(spark, sf_dir):
    """Points that come when their bucket is behind the watermark are dropped."""
    folder, df = _folder(spark), events(spark, sf_dir).source
    for late in (False, True):
        df.where((F.col("ts") < F.lit(LATE).cast("timestamp_ntz")) == F.lit(late)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rolled = ingest.rollup(ingest.files(spark, f"{folder}/in", df.schema), "ts", "1 hour", ("event_type",), "value", ("event_id",), late="1 hour")
        ingest.keep_latest(rolled, f"{folder}/rolled", f"{folder}/log").awaitTermination()  # the second run goes on from the first one's watermark
    return rounded(ingest.latest(spark, f"{folder}/rolled", ("event_type",)), "sum", to=4).select("event_type", "bucket", "sum", "count")


@_named("SELECT event_type, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_last_write_wins(spark, sf_dir):
    folder = _folder(spark)
    df = events(spark, sf_dir).source.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    df.repartitionByRange(3, "event_id").write.parquet(f"{folder}/in")
    roles = {"time": "ts", "tags": ("event_type",), "fields": ("value",), "tiebreak": ("event_id",)}
    ingest.ingest_last_write_wins(ingest.files(spark, f"{folder}/in", df.schema), f"{folder}/out", f"{folder}/log", roles).awaitTermination()
    out = spark.read.parquet(f"{folder}/out").drop("batch")
    return maintenance.last_write_wins(Measurement(out, **roles)).select("event_type", "ts", "value")
