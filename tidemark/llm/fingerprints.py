"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text's paragraphs are its \\n-split lines. Each is hashed to a wide vector, and the fingerprint is the sum of the
vectors, lane by lane modulo a power of two, so the order of paragraphs doesn't matter and a paragraph is
inserted or deleted by adding or subtracting its vector:
- STRONG lanes modulo 2^32 hold hashes of the whole paragraph: equal fingerprints mean equal paragraphs;
- the paragraph's items are dealt over GROUPS by hash. A group has a lane modulo 2^32 that counts its items, and 33 lanes modulo 2^20
  that count those whose hash has a certain bit set, 264 in all. Twice such a lane less the number of the group's items is a random-sign
  projection, so the inner product of two fingerprints estimates that of the texts' item counts, and from that their likeness.
Items are a paragraph's sentences, without blanks at their ends; a sentence of over LONG code points gives its three-word runs instead, so
that a text without marks has more than one item.

All of it is Spark's own expressions. Sign lanes are kept three to a long, each with a bit of room above it: one addition serves
three lanes, and a mask after each addition takes the carry, so no lane touches another and no sum overflows.

Edge cases: a null text counts as empty, and an empty text is one empty paragraph without items; repeated rows have equal fingerprints and
the same next document, as they take one place in the order; ties in doc_id are ordered by a hash of the text; a null doc_id
comes first and stays null (the least long stands for it and so comes out as null too); very long texts take time and memory in
proportion to their length, and beyond 2^20 items with one bit set likeness becomes rough while equality still holds; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, cut

STRONG = 8
MOD32 = (1 << 32) - 1
#: Groups of items, longs of sign lanes for each group, and lanes in a long.
GROUPS, LONGS, IN_LONG, LANE_BITS = 8, 11, 3, 20
HEAD = STRONG + GROUPS
SHIFTS = tuple(i * (LANE_BITS + 1) for i in range(IN_LONG))
#: The lowest bit of each lane of a long, all bits of the lanes, and the bits of room above them.
LOW_BITS = sum(1 << s for s in SHIFTS)
LANE_MASK = LOW_BITS * ((1 << LANE_BITS) - 1)
ROOM = LOW_BITS << LANE_BITS
MARKS = r"[.!?\n。！？؟।]+"
BLANKS = " \t\x0b\x0c\r"
LONG = 400


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _strong(paragraphs: Column, j: int) -> Column:
    """One lane of the paragraphs' own hashes."""
    return _sum(F.transform(paragraphs, lambda p: F.xxhash64(p, F.lit(j)).bitwiseAND(F.lit(MOD32)))).bitwiseAND(F.lit(MOD32))


def _in_group(hashes: Column, g: int) -> Column:
    return F.filter(hashes, lambda h: F.shiftrightunsigned(h, 61) == F.lit(g).cast("long"))


def _lanes(hashes: Column, shift: int) -> Column:
    """How many hashes have the lowest bit of each lane set, after a shift."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(LOW_BITS))).bitwiseAND(F.lit(LANE_MASK)))


def _runs(sentence: Column) -> Column:
    """The three-word runs of a long sentence."""
    words = F.array(F.split(sentence, f"[{BLANKS}]+"))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))))


def add_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the lanes (array of long) of a text column. Columns with names that start with f_ are used within."""
    clean = F.coalesce(F.col(text), F.lit(""))
    x = df.withColumn("f_paragraphs", F.split(clean, "\n"))
    x = x.withColumn("f_sentences", F.array_remove(F.transform(F.split(clean, MARKS), lambda s: F.trim(s, F.lit(BLANKS))), ""))
    x = x.withColumn("f_items", F.flatten(F.transform("f_sentences", lambda s: F.when(F.char_length(s) > LONG, _runs(s)).otherwise(F.array(s)))))
    x = x.withColumn("f_hashes", F.transform("f_items", lambda s: F.xxhash64(s)))
    groups = [f"f_group{g}" for g in range(GROUPS)]
    x = x.withColumns({c: _in_group(F.col("f_hashes"), g) for g, c in enumerate(groups)})
    counts = [F.size(c).cast("long").bitwiseAND(F.lit(MOD32)) for c in groups]
    lanes = F.array(*(_strong(F.col("f_paragraphs"), j) for j in range(STRONG)), *counts, *(_lanes(F.col(c), j) for c in groups for j in range(LONGS)))
    return x.withColumn(into, lanes).drop("f_paragraphs", "f_sentences", "f_items", "f_hashes", *groups)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both (sign 1), or of a without those of b (sign -1)."""
    head = F.zip_with(F.slice(a, 1, HEAD), F.slice(b, 1, HEAD), lambda x, y: (x + sign * y).bitwiseAND(F.lit(MOD32)))
    add = lambda x, y: (x + y).bitwiseAND(F.lit(LANE_MASK))
    subtract = lambda x, y: (x + (F.lit(ROOM) - y)).bitwiseAND(F.lit(LANE_MASK))  # noqa: E731 - each lane borrows from the bit above it
    return F.concat(head, F.zip_with(F.slice(a, HEAD + 1, GROUPS * LONGS), F.slice(b, HEAD + 1, GROUPS * LONGS), add if sign == 1 else subtract))


def add_signs(df: DataFrame, lanes: str, into: str) -> DataFrame:
    """df with the random-sign projections (array of double) of a fingerprint."""
    mask = F.lit((1 << LANE_BITS) - 1)
    groups = [F.transform(F.slice(lanes, HEAD + 1 + g * LONGS, LONGS), lambda x: F.array(*(F.shiftrightunsigned(x, k).bitwiseAND(mask) for k in SHIFTS))) for g in range(GROUPS)]
    counted = F.transform(F.array(*(F.struct(F.get(F.col(lanes), F.lit(STRONG + g)).alias("n"), F.flatten(x).alias("set")) for g, x in enumerate(groups))), lambda g: F.transform(g["set"], lambda c: (c + c - g["n"]).cast("double")))
    return df.withColumn(into, F.flatten(counted))


def add_dot(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """df with the inner product of two columns of signs."""
    return df.withColumn(into, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))


def likeness(ab: Column, aa: Column, bb: Column, same: Column) -> Column:
    """Estimate of ab / (aa + bb - ab) from inner products of signs, which estimate those of two texts' item counts; 1 where `same` holds."""
    shared = F.greatest(ab, F.lit(0.0))
    return F.when(same, 1.0).when(aa + bb - shared <= 0, 0.0).otherwise(F.round(F.least(shared / (aa + bb - shared), F.lit(1.0)), 6))


def as_text(lanes: Column) -> Column:
    """Lanes in base 64: four bytes each for the first HEAD, eight for the others."""
    return F.base64(F.unhex(F.array_join(F.transform(lanes, lambda x, i: F.lpad(F.hex(x), F.when(i < HEAD, 8).otherwise(16), F.lit("0"))), "")))


def _next_places(keys: DataFrame) -> DataFrame:
    """Keys (doc_id, h) in ascending order, each with the next one (next_id, next_h); after the last, the first.

    A range-partitioned sort gives each row a number that counts on within its partition, so the next row is found
    by an equi-join on the number; only the partitions' ends, one row each, are put in order by a window.
    """
    placed = cut(keys.orderBy("doc_id", "h").withColumn("place", F.monotonically_increasing_id()))
    ends = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("low"), F.max("place").alias("high"))
    every = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("high").alias("place"), F.coalesce(F.lead("low").over(Window.partitionBy(F.lit(0)).orderBy("part")), F.first("low").over(every)).alias("jump"))
    ahead = placed.join(ends, "place", "left").select("doc_id", "h", "n_chars", F.coalesce("jump", F.col("place") + 1).alias("next_place"))
    other = placed.select(F.col("place").alias("next_place"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    return ahead.join(other, "next_place").drop("next_place")


def digest(df: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts, and likenesses.

    The edited text has its last quarter replaced by as many code points from the next document's start. Rows
    equal in doc_id and text take one place in the order, so they have the same next document.
    """
    clean = F.coalesce("text", F.lit(""))
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), clean.alias("text"), F.xxhash64(clean).alias("h"), F.char_length(clean).cast("long").alias("n_chars"))
    order = _next_places(docs.select("doc_id", "h", "n_chars").distinct())
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("prev_id"), F.col("h").alias("prev_h"), F.floor(F.col("n_chars") / 4).cast("int").alias("k"))
    # Both uses of `printed` read the same columns, so the shuffle of the texts by key is made once and read twice.
    printed = add_fingerprint(docs, "text", "lanes").repartition("doc_id", "h")
    heads = printed.join(wanted, ["doc_id", "h"]).select(F.col("prev_id").alias("doc_id"), F.col("prev_h").alias("h"), F.col("lanes").alias("next_lanes"), F.expr("substring(text, 1, least(k, cast(n_chars as int)))").alias("head"))
    heads = heads.dropDuplicates(["doc_id", "h"])
    x = printed.join(heads, ["doc_id", "h"]).select("doc_id", "text", "n_chars", "lanes", "next_lanes", "head")
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    x = x.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "head")).drop("text", "head")
    x = add_fingerprint(x, "edited", "edited_lanes").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    for lanes in ("lanes", "edited_lanes", "next_lanes"):
        x = add_signs(x, lanes, f"{lanes}_signs")
        x = add_dot(x, f"{lanes}_signs", f"{lanes}_signs", f"{lanes}_square")
    for other in ("edited_lanes", "next_lanes"):
        x = add_dot(x, "lanes_signs", f"{other}_signs", f"{other}_dot")
    near = lambda other: likeness(F.col(f"{other}_dot"), F.col("lanes_square"), F.col(f"{other}_square"), F.col("lanes") == F.col(other))
    return x.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"), near("edited_lanes").alias("near_edited"), near("next_lanes").alias("near_next"))
