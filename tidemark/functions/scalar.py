"""Scalar functions: hashes, series numbers, time units, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits; fixed values.
FNV_OFFSET = -3750763034362895579
FNV_LOW_PRIME = 435
LOW32 = (1 << 32) - 1


def fnv1a64(text: Column) -> Column:
    """FNV-1a hash of a string's UTF-8 bytes as a signed long; null for null.

    The prime is 2^40 + 435. The product is put together from 32-bit halves, since a plain product overflows.
    """
    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(F.hex(text), 2 * i + 1, F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, octet: Column) -> Column:
        mixed = h.bitwiseXOR(octet)
        low, high = mixed.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(mixed, 32)
        carried = high * FNV_LOW_PRIME + F.shiftrightunsigned(low * FNV_LOW_PRIME, 32) + low * 256
        return F.shiftleft(carried.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR((low * FNV_LOW_PRIME).bitwiseAND(F.lit(LOW32)))

    return F.when(text.isNotNull(), F.aggregate(octets, F.lit(FNV_OFFSET), step))


def series_id(measurement: Column, tags: dict[str, Column] | Column) -> Column:
    """Number of a series: a hash of the measurement and the set of (tag, value) pairs whose value isn't null."""
    if isinstance(tags, Column):
        pairs = F.transform(F.map_entries(tags), lambda e: F.struct(e.key.alias("k"), e.value.cast("string").alias("v")))
    else:
        pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in sorted(tags.items())))
    present = F.array_sort(F.filter(pairs, lambda e: e.v.isNotNull()))
    return F.xxhash64(measurement, F.to_json(present))


def from_ns(ns: Column) -> Column:
    """Time (without zone) of nanoseconds since the epoch, to the microsecond below."""
    return F.timestamp_micros(_down(ns, 1000)).cast("timestamp_ntz")


def _down(n: Column, by: int) -> Column:
    """Whole-number division that rounds down."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def to_ns(time: Column) -> Column:
    """Nanoseconds since the epoch of a time."""
    return F.unix_micros(time.cast("timestamp")) * 1000


def second_of_ns(ns: Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return _down(ns, 1_000_000_000)


def date_key(time: Column) -> Column:
    """Day as yyyyMMdd (UTC)."""
    return F.date_format(time, "yyyyMMdd")


#: Grain of a rollup key: its tag and the pattern of its time; fixed values.
ROLLUP_KEYS = {"hourly": "yyyyMMddHH", "daily": "yyyyMMdd", "monthly": "yyyyMM"}


def rollup_key(measurement: Column, grain: str, bucket: Column) -> Column:
    """Key of a rollup row, as H:measurement:grain:time."""
    return F.concat_ws(":", F.lit("H"), measurement, F.lit(grain), F.date_format(bucket, ROLLUP_KEYS[grain]))


def now_ns() -> Column:
    """The query's time in nanoseconds since the epoch."""
    return F.unix_micros(F.current_timestamp()) * 1000


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())
