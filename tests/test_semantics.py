"""Small inputs that pin down what results mean."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.errors import InvalidArgument, NotFound
from tidemark.functions import codecs, scalar
from tidemark.functions.predicates import exact_set, tag
from tidemark.model import Measurement
from tidemark.operators import maintenance, rates, rollup, series
from tidemark.plans.query import Query
from tidemark.sources.points import Point, points

T0 = dt.datetime(2024, 1, 1)


def made(spark, rows, schema="ts timestamp_ntz, host string, value double, seq long"):
    return Measurement(spark.createDataFrame(rows, schema), "ts", ("host",), ("value",), ("seq",), "cpu")


def values(spark, vs):
    return made(spark, [(T0 + dt.timedelta(seconds=i), "a", v, i) for i, v in enumerate(vs)])


def one(q):
    rows = q.df().collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(("vs", "name", "want"), [
    ([1.0, 2.0, 3.0, 4.0], "median", 3.0),
    ([1e9, 1e9 + 1, 1e9 + 2], "stddev", 0.81649658),
    ([math.nan, 1.0], "min", 1.0),
    ([math.nan, 1.0], "max", 1.0),
    ([5.0, 1.0, 9.0], "first", 5.0),
    ([5.0, 1.0, 9.0], "last", 9.0),
    ([1.0, None, 3.0], "avg", 2.0),
    ([1.0, None, 3.0], "count", 2),
    ([10.0, 20.0, 40.0], "rate", 15.0),
])
def test_aggregates(spark, vs, name, want):
    assert one(Query(values(spark, vs)).agg(name, into="x")).x == pytest.approx(want)


def test_uniform_fixture(spark):
    m = Measurement(spark.range(1000).select(F.timestamp_seconds(F.col("id") + 1).cast("timestamp_ntz").alias("ts"), (60 + (F.col("id") % 100) / 10).alias("value"), "id"), "ts", (), ("value",), ("id",))
    q = Query(m)
    for n in ("count", "sum", "avg", "min", "max", "first", "last", "stddev", "median", "p95", "p99"):
        q = q.agg(n)
    r = one(q)
    assert (r["count"], r.min, r.max, r["first"], r.last) == (1000, 60.0, 69.9, 60.0, 69.9)
    for n, want in (("sum", 64950.0), ("avg", 64.95), ("stddev", 2.886607), ("median", 65.0), ("p95", 69.405), ("p99", 69.801)):
        assert r[n] == pytest.approx(want)


def test_empty_selection(spark):
    r = one(Query(values(spark, [1.0])).range("2030-01-01").agg("count", into="n").agg("sum", into="s").agg("median", into="m").agg("first", into="f"))
    assert (r.n, r.s, r.m, r.f, r.points) == (0, None, None, None, 0)


def test_range_includes_both_ends(spark):
    m = made(spark, [(T0, "a", 1.0, 0), (T0 + dt.timedelta(seconds=1), "a", 2.0, 1), (T0 + dt.timedelta(seconds=1, microseconds=1), "a", 3.0, 2)])
    assert [r.value for r in Query(m).range(T0, T0 + dt.timedelta(seconds=1)).df().collect()] == [1.0, 2.0]


@pytest.mark.parametrize(("condition", "want"), [
    (lambda: tag("host") != "x", [1, 2]), (lambda: tag("host") == "x", [0]), (lambda: tag("host") < "x", [1]), (lambda: tag("host") <= "x", [0, 1]), (lambda: tag("host") > "w", [0]),
    (lambda: tag("host") >= "x", [0]), (lambda: tag("host").matches("x"), [0]), (lambda: ~(tag("host") == "x"), [1, 2]), (lambda: ~(tag("host") < "x"), [0, 2]),
    (lambda: (tag("host") == "x") | (tag("host") == "b"), [0, 1]), (lambda: (tag("host") == "x") & (tag("host") == "b"), []), (lambda: exact_set({}, ("host",)), [2]),
])
def test_predicates_on_a_missing_tag(spark, condition, want):
    m = made(spark, [(T0, "x", 1.0, 0), (T0, "b", 1.0, 1), (T0, None, 1.0, 2)])
    assert [r.seq for r in Query(m).where(condition()).df().collect()] == want


def test_sort_before_limit_and_paging(spark):
    m = made(spark, [(T0 + dt.timedelta(seconds=s), "a", float(s), s) for s in (3, 1, 2)])
    got = lambda q: [r.value for r in q.df().collect()]
    assert got(Query(m).order(ascending=False).limit(2)) == [3.0, 2.0]
    assert got(Query(m).limit(0)) == []
    assert got(Query(m).limit(2).offset(1)) == [2.0, 3.0]
    assert got(Query(m).limit(None)) == [1.0, 2.0, 3.0]
    with pytest.raises(InvalidArgument):
        Query(m).limit(-1)


def test_unknown_names(spark):
    m = values(spark, [1.0])
    with pytest.raises(NotFound):
        Query(m).group_by("nothing")
    with pytest.raises(NotFound):
        Query(m).agg("sum", "nothing").df()
    with pytest.raises(InvalidArgument):
        Query(m).agg("nothing").df()
    with pytest.raises(InvalidArgument):
        Query(m).group_by("host").df()
    with pytest.raises(NotFound):
        Measurement(m.source, "when")


def test_typed_fields(spark):
    df = spark.createDataFrame([(T0, 1, "s", True, 0)], "ts timestamp_ntz, i int, s string, b boolean, seq long")
    m = Measurement(df, "ts", (), ("i", "s", "b"), ("seq",))
    q = Query(m).agg("sum", "i", "i").agg("sum", "s", "s").agg("sum", "b", "b")
    assert tuple(one(q))[:3] == (1.0, None, None)
    assert tuple(one(q.missing_as_zero()))[:3] == (1.0, 0.0, 0.0)


def test_duplicates(spark):
    rows = [(T0, "a", 1.0, 0), (T0, "a", 2.0, 1), (T0 + dt.timedelta(milliseconds=900), "a", 3.0, 2), (T0, "b", 4.0, 3), (T0, None, 5.0, 4)]
    m = made(spark, rows)
    got = lambda df: sorted((r.host or "", r.value) for r in df.collect())
    assert m.source.count() == 5
    assert got(maintenance.last_write_wins(m)) == [("", 5.0), ("a", 2.0), ("a", 3.0), ("b", 4.0)]
    assert got(maintenance.last_write_wins(m, second=True)) == [("", 5.0), ("a", 3.0), ("b", 4.0)]
    assert maintenance.last_write_wins(m).columns == m.source.columns


def test_series_identity(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({"a": "b"},), ({"b": "a"},), ({"a": "a"},), ({},)], "tags map<string,string>")
    ids = [r[0] for r in df.select(scalar.series_id(F.lit("m"), F.col("tags"))).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 5
    wide = spark.createDataFrame([("1", "2", None)], "b string, a string, c string").select(scalar.series_id(F.lit("m"), {k: F.col(k) for k in "cba"})).first()[0]
    assert wide == spark.createDataFrame([({"b": "1", "a": "2"},)], "tags map<string,string>").select(scalar.series_id(F.lit("m"), F.col("tags"))).first()[0]


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def test_fnv(spark):
    texts = ["a", "cpu_usage", "", "é中", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(scalar.fnv1a64(F.col("t"))).collect()]
    assert got == [*(fnv(t.encode()) for t in texts), None]
    assert got[:2] == [-5808556873153909620, 5213631833443516957]


def test_rates(spark):
    m = made(spark, [(T0, "a", 1.0, 0), (T0, "a", 5.0, 1), (T0 + dt.timedelta(seconds=2), "a", 9.0, 2), (T0, "b", 7.0, 3)])
    assert {r.seq: r.rate for r in rates.rate(m).collect()} == {0: None, 1: None, 2: 2.0, 3: None}
    coded = rates.delta(m)
    assert {r.seq: r.delta for r in coded.collect()} == {0: 1.0, 1: 4.0, 2: 4.0, 3: 7.0}
    assert {r.seq: r.value for r in rates.undelta(coded.drop("value"), m).collect()} == {0: 1.0, 1: 5.0, 2: 9.0, 3: 7.0}
    assert {r.seq: r.dod_us for r in rates.delta_of_delta(m).collect()}[2] == 2_000_000


def test_names_are_compared_whole(spark):
    df = points(spark, [Point("cpu", 1).value(1), Point("cpu_usage", 1).value(2)])
    assert [r.value for r in Measurement.of_points(df, "cpu", ()).source.collect()] == [1.0]
    assert [r.measurement for r in maintenance.without_measurement(df, "measurement", "cpu").collect()] == ["cpu_usage"]


def test_points(spark):
    p = [Point("m", 0).tag("host", "a").set("n", 7), Point("m", -1).set("s", "x").set("ok", True), Point("m").value(2.5)]
    rows = points(spark, p).orderBy("seq").collect()
    assert rows[0].ts == dt.datetime(1970, 1, 1) and rows[0].value == 7.0
    assert rows[1].ts == dt.datetime(1969, 12, 31, 23, 59, 59, 999999) and rows[1].value is None and rows[1].strings == {"s": "x"} and rows[1].bools == {"ok": True}
    assert rows[2].value == 2.5 and rows[2].ts.year >= 2024
    with pytest.raises(InvalidArgument):
        p[0].tag("host", "b")


def test_tiers_and_retention(spark):
    days = [6, 7, 29, 30]
    m = made(spark, [(T0 - dt.timedelta(days=d), "a", float(d), d) for d in days])
    got = {r.seq: r.t for r in m.source.withColumn("t", maintenance.tier(F.col("ts"), T0)).collect()}
    assert got == {6: "hot", 7: "warm", 29: "warm", 30: "cold"}
    assert sorted(r.seq for r in maintenance.retained(m, T0 - dt.timedelta(days=29)).collect()) == [6, 7, 29]


def test_delete_and_complement(spark):
    m = values(spark, [float(i) for i in range(20)])
    low, high = T0 + dt.timedelta(seconds=3), T0 + dt.timedelta(seconds=7)
    left = {r.seq for r in maintenance.without_range(m, low, high).collect()}
    assert left == set(range(20)) - set(range(3, 8))
    assert left | {r.seq for r in Query(m).range(low, high).df().collect()} == set(range(20))


def test_rollups_again(spark):
    rows = [(T0 + dt.timedelta(minutes=37 * i), "ab"[i % 2], float(i % 7) if i % 5 else None, i) for i in range(200)]
    m = made(spark, rows)
    hourly = rollup.rollup(m, "1 hour", ("host",))
    key = lambda df: sorted((r.host, r.bucket, r.sum, r.min, r.max, r.avg, r["count"], r.first_ts, r.last_ts) for r in df.collect())
    assert key(rollup.coarser(hourly, "1 day", ("host",))) == key(rollup.rollup(m, "1 day", ("host",)))
    assert sum(r["count"] for r in hourly.collect()) == sum(v is not None for _, _, v, _ in rows)


def test_series_catalog(spark):
    m = made(spark, [(T0, "a", 1.0, 0), (T0 + dt.timedelta(days=3), "a", 1.0, 1), (T0 + dt.timedelta(days=5), "b", 1.0, 2)])
    cat = series.catalog(m)
    found = lambda a, b: sorted(r.host for r in series.overlapping(cat, T0 + dt.timedelta(days=a), T0 + dt.timedelta(days=b)).collect())
    assert found(1, 2) == ["a"] and found(3, 5) == ["a", "b"] and found(4, 4) == []
    assert [r.host for r in series.with_exact_tags(m, cat, {"host": "b"}).collect()] == ["b"]
    c = series.counts(m).first()
    assert (c.points, c.series, c.measurements) == (3, 2, 1)


def test_dictionary_keeps_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "host string")
    ids = series.dictionary(df, "host")
    coded = series.encoded(df, "host", ids)
    assert sorted(str(r.host_id) for r in coded.collect()) == ["1", "2", "2", "None"]
    assert sorted(str(r.host) for r in series.decoded(coded, "host", ids).collect()) == ["None", "a", "b", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(width=64)))
def test_codec(vs):
    back = codecs.unpack_values(codecs.pack_values(vs))
    assert [str(x) for x in back] == [str(x) for x in vs]


def test_config():
    assert Config().codec == "zstd"
    for bad in ({"block_size": 10}, {"level": 10}, {"codec": "x"}, {"cache_entries": 0}, {"duplicates": "x"}, {"hot_days": 40}, {"batch_points": 0}):
        with pytest.raises(InvalidArgument):
            Config(**bad)


def test_last_write_of_a_second_is_the_last_written(spark):
    """Not the one with the latest time in it."""
    m = made(spark, [(T0 + dt.timedelta(milliseconds=900), "a", 1.0, 1), (T0 + dt.timedelta(milliseconds=100), "a", 2.0, 2), (T0 + dt.timedelta(seconds=1), "a", 3.0, 0)])
    assert sorted(r.value for r in maintenance.last_write_wins(m, second=True).collect()) == [2.0, 3.0]
    with pytest.raises(InvalidArgument):
        maintenance.last_write_wins(Measurement(m.source, "ts", ("host",), ("value",)))


def test_changes_across_days(spark):
    """Windows hold days; values are carried over days without points, and nulls are a series too."""
    rows = [(T0 + dt.timedelta(hours=7 * k + (48 if k > 9 else 0)), h, float(k * k), 100 * n + k) for n, h in enumerate(("a", None)) for k in range(20)]
    m = made(spark, rows)
    assert {r.seq: r.value for r in rates.undelta(rates.delta(m).drop("value"), m).collect()} == {s: v for _, _, v, s in rows}
    got = {r.seq: r.rate for r in rates.rate(m).collect()}
    for n in (0, 1):
        for a, b in zip(rows[20 * n :], rows[20 * n + 1 : 20 * n + 20]):
            assert got[b[3]] == pytest.approx((b[2] - a[2]) / (b[0] - a[0]).total_seconds())
    dod = {r.seq: r.dod_us for r in rates.delta_of_delta(m).collect()}
    assert dod[0] is None and dod[1] is None and dod[5] == 0 and dod[10] == 48 * 3_600_000_000 and dod[11] == -48 * 3_600_000_000


def test_dictionary_numbers_without_gaps(spark):
    df = spark.range(1000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("host")).repartition(5)
    ids = sorted((r.id, r.value) for r in series.dictionary(df, "host").collect())
    assert ids == [(k + 1, f"v{k:04}") for k in range(1000)]


def test_bloom_filters_are_on_tags():
    assert "parquet.bloom.filter.enabled#host" in Config().writer_options(("host",)) and not any("bloom" in k for k in Config(bloom=()).writer_options(("host",)))
    assert Config(flush_ms=250).every() == "250 milliseconds" and Config(batch_points=7).reader_options()["maxOffsetsPerTrigger"] == "7"


@pytest.mark.parametrize("name", ["median", "p95", "p99"])
def test_quantiles_equal_those_of_sorted_values(spark, name):
    """Large and small groups, ties, NaN, nulls, a null key and a group without values, each against Spark's exact aggregate."""
    from tidemark.functions.aggregates import AGGREGATES

    i = F.col("id")
    host = F.when(i % 7 == 0, None).when(i < 400_000, "big").when(i < 400_003, "few").when(i < 400_009, "ties").when(i < 400_050, "none").otherwise("nan")
    v = (F.xxhash64("id") % 1_000_003).cast("double")
    v = F.when(host == "ties", 4.0).when((host == "none") | (i % 11 == 0), None).when((host == "nan") & (i % 4 == 0), math.nan).otherwise(v)
    m = Measurement(spark.range(400_500).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), host.alias("host"), v.alias("value"), i.alias("seq")), "ts", ("host",), ("value",), ("seq",))
    shown = lambda rows: {r[0]: repr(None if r.x is None else round(r.x, 6)) for r in rows}
    assert shown(Query(m).group_by("host").agg(name, into="x").df().collect()) == shown(m.source.groupBy("host").agg(AGGREGATES[name](m, "value").alias("x")).collect())
    assert repr(one(Query(m).range("1970-01-02").agg(name, into="x")).x) == repr(m.source.where("ts >= '1970-01-02'").select(AGGREGATES[name](m, "value").alias("x")).first().x)


def test_quantiles_keep_their_place_among_aggregates(spark):
    df = Query(values(spark, [1.0, 2.0, 3.0, 4.0])).group_by("host").bucket("1 hour").agg("p95").agg("sum").agg("median").df()
    assert df.columns == ["host", "bucket", "p95", "sum", "median", "points"]
    r = df.first()
    assert (round(r.p95, 6), r["sum"], r.median, r.points) == (3.85, 10.0, 3.0, 4)
