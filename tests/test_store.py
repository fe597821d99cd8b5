"""Databases, streams and plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.config import Config
from tidemark.errors import Closed, NotFound
from tidemark.functions.predicates import tag
from tidemark.model import Measurement
from tidemark.operators import rollup
from tidemark.operators.series import catalog
from tidemark.plans.query import Query
from tidemark.plans.routing import Router, makes
from tidemark.sources.store import Database, ResultCache
from tidemark.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, host string, value double, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def points(spark, days=5):
    return frame(spark, [(T0 + dt.timedelta(hours=6 * i), "ab"[i % 2], float(i), i) for i in range(4 * days)])


@pytest.fixture
def db(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as d:
        d.write("cpu", points(spark), "ts", ("host",))
        yield d


def seqs(db):
    return sorted(r.seq for r in db.read("cpu").collect())


def test_write_read_list(db, spark):
    assert db.measurements() == ["cpu"] and len(db.days("cpu")) == 5
    db.write("cpu", frame(spark, [(T0, "a", 9.0, 99)]), "ts")
    assert seqs(db) == [*range(20), 99]
    s = db.stats("cpu", ("host",))
    assert (s["points"], s["series"], s["days"]) == (21, 2, 5) and s["bytes"] > 0
    with pytest.raises(NotFound):
        db.read("nothing")


def test_range_prunes_days(db):
    m = db.measurement("cpu", "ts", ("host",), ("value",), ("seq",))
    df = Query(m).range(T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2)).df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts" in plan
    assert [r.seq for r in df.collect()] == [4, 5, 6, 7, 8]


def test_delete_range_series_day(db):
    db.delete_range("cpu", T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2))
    assert seqs(db) == [0, 1, 2, 3, *range(9, 20)] and len(db.days("cpu")) == 4
    db.delete_series("cpu", {"host": "a"}, ("host",))
    assert seqs(db) == [1, 3, 9, 11, 13, 15, 17, 19]
    db.drop_day("cpu", "2024-01-01")
    assert seqs(db) == [9, 11, 13, 15, 17, 19]
    db.delete_range("cpu", T0, T0 + dt.timedelta(days=9), condition=tag("host") == "nobody")
    assert len(seqs(db)) == 6
    db.delete_measurement("cpu")
    assert db.measurements() == []


def test_expire_keeps_the_cutoff(db):
    db.expire("cpu", T0 + dt.timedelta(days=1, hours=6))
    assert seqs(db) == list(range(5, 20))


def test_compact_and_recompress_keep_rows(db):
    before = seqs(db)
    db.compact("cpu", "ts", ("host",))
    db.recompress("cpu", ["2024-01-02"], "gzip")
    assert seqs(db) == before


def test_recompress_by_age(db):
    before = seqs(db)
    db.recompress_by_age("cpu", dt.date(2024, 1, 10))
    assert seqs(db) == before and len(db.days("cpu")) == 5


def test_saved_catalog(db):
    m = db.measurement("cpu", "ts", ("host",), ("value",), ("seq",))
    saved = db.save_catalog("cpu", m)
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, db.load_catalog("cpu").collect())) == sorted(map(tuple, catalog(m).collect()))
    assert db.measurements() == ["cpu"]
    with pytest.raises(NotFound):
        db.load_catalog("mem")


def test_routing(spark):
    m = Measurement(points(spark), "ts", ("host",), ("value",), ("seq",))
    r = Router(m).keep("1 hour", ("host",), rollup.rollup(m, "1 hour", ("host",))).keep("1 day", (), rollup.rollup(m, "1 day"))
    assert r.source("1 day", ())[0] == "1 day" and r.source("month", ("host",))[0] == "1 hour" and r.source("30 seconds", ()) is None
    rows = lambda df, *c: sorted(tuple(x[k] for k in (*c, "bucket", "sum", "count", "avg", "last_ts")) for x in df.collect())
    for grain in ("1 hour", "1 day", "month", "10 minutes"):
        assert rows(r.summary(grain), ) == rows(rollup.rollup(m, grain))
        assert rows(r.summary(grain, ("host",), {"host": "a"}), "host") == [x for x in rows(rollup.rollup(m, grain, ("host",)), "host") if x[0] == "a"]
    assert not makes("week", "month") and makes("1 day", "week") and not makes("month", "1 day")


def test_last_write_wins_on_read(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"), Config(duplicates="lww"))
    d.write("cpu", frame(spark, [(T0, "a", 1.0, 0)]), "ts")
    d.write("cpu", frame(spark, [(T0, "a", 2.0, 1)]), "ts")
    m = d.measurement("cpu", "ts", ("host",), ("value",), ("seq",))
    assert [r.value for r in Query(m).df().collect()] == [2.0]
    d.close()
    with pytest.raises(Closed):
        d.read("cpu")


def test_tenants_are_apart(spark, tmp_path):
    one, two = Database(spark, str(tmp_path / "one")), Database(spark, str(tmp_path / "two"))
    one.write("cpu", points(spark), "ts")
    assert two.measurements() == []


def test_result_cache(spark):
    dropped = []
    c = ResultCache(entries=2, dropped=dropped.append)
    assert c.hit_rate() == 0.0
    for key in (1, 2, 1, 3):
        c.get(key, lambda: spark.range(1))
    assert (c.hits, c.misses, c.evictions, dropped) == (1, 3, 1, [2]) and 1 in c and 2 not in c
    assert c.remove(1) and not c.remove(1) and c.hit_rate() == 0.25
    old = ResultCache(seconds=-1)
    old.get(1, lambda: spark.range(1))
    old.get(1, lambda: spark.range(1))
    assert old.misses == 2
    c.clear()


def arrive(spark, folder, *batches):
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def test_stream_restart_adds_nothing(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    arrive(spark, src, [(T0, "a", 1.0, 0)])
    run = lambda: ingest.ingest(ingest.files(spark, src, frame(spark, []).schema), out, log).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 1
    arrive(spark, src, [(T0, "b", 1.0, 1)])
    run()
    assert spark.read.parquet(out).count() == 2


def test_late_data(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    h = lambda x: T0 + dt.timedelta(hours=x)
    rolled = lambda: ingest.rollup(ingest.files(spark, src, frame(spark, []).schema), "ts", "1 hour", ("host",), "value", ("seq",), late="2 hours")
    for rows in ([(h(10), "a", 1.0, 0)], [(h(9.5), "a", 2.0, 1)], [(h(20), "a", 3.0, 2)], [(h(9.5), "a", 4.0, 3)]):
        arrive(spark, src, rows)
        ingest.keep_latest(rolled(), out, log).awaitTermination()
    got = {r.bucket: r["count"] for r in ingest.latest(spark, out, ("host",)).collect()}
    assert got == {h(10): 1, h(9): 1, h(20): 1}


def test_core_plans_have_no_python(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("flagship", "bucket_hour", "rate_series", "lww_dedup", "rollup_reaggregate", "series_id_fnv", "agg_median"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_flagship_plan(spark):
    plan = catalogue.flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan and "partial_sum" in plan and "WindowExec" not in plan


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_broken_rewrites_are_ended(spark, tmp_path, moved):
    """A driver lost while it puts rewritten days in their place: with none moved the old rows stay, else the new ones come."""
    root = str(tmp_path / "db")
    d = Database(spark, root)
    df = spark.createDataFrame([(f"2024-01-0{k} 01:00:00", float(k)) for k in (1, 2)], "t string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    d.write("m", df)
    df.withColumn("value", F.col("value") * 10).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{root}/.rewrite-1-m")
    days = d.days("m")
    if moved:
        (tmp_path / "db/.old-1-m").mkdir()
    for k, day in enumerate(days[:moved]):
        (tmp_path / f"db/m/day={day}").rename(tmp_path / f"db/.old-1-m/day={day}")
        if k == 0 and moved == 2:
            (tmp_path / f"db/.rewrite-1-m/day={day}").rename(tmp_path / f"db/m/day={day}")
    d = Database(spark, root)
    want = {0: [1.0, 2.0], 1: [2.0, 10.0], 2: [10.0, 20.0]}[moved]
    assert sorted(r.value for r in d.read("m").collect()) == want and not [p for p in (tmp_path / "db").iterdir() if p.name.startswith(".")]


def test_rollup_on_streams_leaves_nan_out(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:02", "a", float("nan"))], "t string, host string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "host", "value")
    df.write.parquet(str(tmp_path / "in"))
    rolled = ingest.rollup(ingest.files(spark, str(tmp_path / "in"), df.schema), "ts", "1 hour", ("host",), "value")
    ingest.keep_latest(rolled, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    r = ingest.latest(spark, str(tmp_path / "out"), ("host",)).first()
    assert (r["min"], r["max"], r["count"]) == (1.0, 1.0, 2)


def test_ingest_into_a_database(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:01", 1.0), ("2024-01-02 00:00:02", 2.0)], "t string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    d = Database(spark, str(tmp_path / "db"))
    d.ingest("m", ingest.files(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "log"), once=True).awaitTermination()
    assert d.read("m").count() == 2 and d.days("m") == ["2024-01-01", "2024-01-02"]
