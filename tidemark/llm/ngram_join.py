"""Near-duplicate join on word n-grams: all pairs of documents with a Jaccard similarity of at least THRESHOLD.

1. Each text becomes the set of hashes of its SHINGLE-word runs. Documents with equal sets form a class, found by an
   aggregate; from here on one row stands for a class, so any number of copies is one row.
2. LSH forest: TREES tries over minhash signatures of DEPTH values. The prefix asked for is shortened, at the time of the call, from DEPTH until a
   pair at the threshold asked for shares it in some tree with the target probability. Classes that share it form a bucket.
3. Every two classes of a bucket are compared by signature, in blocks as in 4, so that even a bucket that holds most rows
   is spread. Those with an estimated similarity of at least LOOSE are tied; components of ties are candidate groups.
4. Exact verification: the sets of a group's members meet, in blocks of about BLOCK members or SHINGLES shingles at most, and every pair
   of a group is measured exactly once. A block returns, per member, how many documents it is linked with, and for each
   member one edge of the links' spanning forest, never the pairs.
5. Classes joined by links form the final groups; a group's number is its least doc_id.

Edge cases: a text of one to SHINGLE - 1 words has one shingle, all its words; a null or blank text has none and no links;
rows equal in doc_id and text are copies of each other; a similarity of just the threshold is a link; null ids count as the least
long and come out as null; a very long text is one set in memory proportional to it; an empty table gives no rows; other columns are ignored, or kept
by one_of_each, whatever their names (but j_id and j_h).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import gram_hashes, mix
from tidemark.llm.common import NO_ID, cut
from tidemark.llm.components import components
from tidemark.llm.substrings import hashes

SHINGLE, THRESHOLD, TARGET = 5, 0.8, 0.999
TREES, DEPTH = 20, 8
#: One byte of each of so many minhashes estimates the similarity; ties estimated lower are dropped.
BYTES, LOOSE = 64, 0.55
BLOCK, SHINGLES = 1024, 1 << 19
#: Classes of a bucket up to which its pairs are listed one by one.
FEW = 8
U32 = np.uint32
_random = np.random.default_rng(5)
FLIP = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(U32)
TIMES = (_random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(U32)) | U32(1)


def stop_depth(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(text: str) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    words = hashes(text)
    if not len(words):
        return words
    return np.unique(mix(gram_hashes(words, min(SHINGLE, len(words)))[0]))


def signature(x: np.ndarray) -> np.ndarray:
    """Minhashes of a set."""
    low, least = (x >> np.uint64(32)).astype(U32), None
    for i in range(0, len(low), 512):
        part = ((low[i : i + 512, None] ^ FLIP) * TIMES).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def _sets(batches: Iterator[pd.DataFrame], stop: int) -> Iterator[pd.DataFrame]:
    """Each document's set: two hashes of it, its size, a small signature, and for each tree a hash of the prefix of `stop` values."""
    shift = np.arange(TREES, dtype=np.uint64)
    for batch in batches:
        out = []
        for i, h, text in zip(batch["id"].tolist(), batch["h"].tolist(), batch["text"], strict=True):
            x = shingles(text)
            if not len(x):
                out.append((i, h, None, None, 0, b"", b""))
                continue
            s = signature(x)
            tries = s.reshape(TREES, DEPTH).astype(np.uint64)
            key = shift
            for k in range(stop):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + tries[:, k])
            d1, d2 = (np.bitwise_xor.reduce(mix(x * np.uint64(m))) + np.uint64(len(x)) for m in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
            small = (s[:: TREES * DEPTH // BYTES][:BYTES] & U32(255)).astype(np.uint8)
            out.append((i, h, int(d1.view(np.int64)), int(d2.view(np.int64)), len(x), small.tobytes(), key.tobytes()))
        yield pd.DataFrame(out, columns=["id", "h", "d1", "d2", "n", "small", "tries"]).astype({"d1": "Int64", "d2": "Int64"})


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"key": np.frombuffer(b"".join(batch["tries"]), np.int64), "ref": np.repeat(batch["ref"].to_numpy(), TREES)})


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole blocks, and where each block begins, with the end; rows come in order of keys."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(rows):
            k = rows[keys].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))))
            if len(starts) > 1:
                yield rows.iloc[: starts[-1]], starts
            held = rows.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _alike(match: np.ndarray) -> np.ndarray:
    """Whether signatures that agree in so many bytes estimate a similarity of at least LOOSE."""
    return (match / BYTES - 1 / 256) / (1 - 1 / 256) >= LOOSE


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many bytes each signature of one agrees with each of two."""
    match, rows, columns = np.zeros((len(one), len(two)), np.uint8), np.ascontiguousarray(one.T), np.ascontiguousarray(two.T)
    for k in range(BYTES):
        match += rows[k][:, None] == columns[k][None, :]
    return match


def _ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Alike classes of each block: every pair where there are FEW, else each class with the least one connected with it."""
    for rows, edges in _blocks(batches, ["key", "pair_low", "pair_high"]):
        ref, side = rows["ref"].to_numpy(), rows["side"].to_numpy()
        small = np.frombuffer(b"".join(rows["small"]), np.uint8).reshape(-1, BYTES)
        sizes = np.diff(edges)
        at, few = np.arange(len(ref)) - np.repeat(edges[:-1], sizes), np.repeat(sizes <= FEW, sizes)
        for gap in range(1, FEW):
            b = np.flatnonzero(few & (at >= gap))
            b = b[_alike((small[b] == small[b - gap]).sum(axis=1))]
            yield pd.DataFrame({"a": ref[b], "b": ref[b - gap]})
        for low, high in zip(edges[:-1][sizes > FEW], edges[1:][sizes > FEW], strict=True):
            s, r, x = side[low:high], ref[low:high], small[low:high]
            one = np.flatnonzero(s == s.min())
            two = np.flatnonzero(s == s.max())
            links = np.zeros((len(r), len(r)), bool)
            links[np.ix_(one, two)] = part = _alike(_agreeing(x[one], x[two]))
            links[np.ix_(two, one)] = part.T
            root = _forest(links)
            yield pd.DataFrame({"a": r, "b": r[root]})


def paired(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows (columns, side, parts) once for each pair of parts that theirs is in, with pair_low and pair_high."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return rows.select("*", other).select(*columns, "side", F.least("side", "other").alias("pair_low"), F.greatest("side", "other").alias("pair_high"))


def candidate_ties(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that share a bucket and look alike. Every two classes of a bucket meet, in blocks as the members of a group do."""
    rows = classes.select("ref", "tries").mapInPandas(_labels, "key long, ref long")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts"))
    held = rows.join(buckets, "key").join(classes.select("ref", "small"), "ref").withColumn("side", F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int"))
    keys = ("key", "pair_low", "pair_high")
    return paired(held, "key", "ref", "small").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_ties, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of each two of some sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    common = np.zeros((m, m), np.float32)
    for k in range(2, 9):  # few owners: count their pairs one by one
        own = owner[held[column] == k].reshape(-1, k)
        for i in range(k):
            for j in range(k):
                if i != j and len(own):
                    common += np.bincount(own[:, i] * m + own[:, j], minlength=m * m).reshape(m, m).astype(np.float32)
    many = np.flatnonzero(held > 8)
    step = max(1, (1 << 22) // m)
    for i in range(0, len(many), step):
        part = many[i : i + step]
        at = np.searchsorted(part, column)
        hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == column)
        dense = np.zeros((m, len(part)), np.float32)
        dense[owner[hit], at[hit]] = 1
        common += dense @ dense.T
    return common


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two different sets have at least the threshold's similarity."""
    common, sizes = overlaps(sets).astype(np.float64), np.array([len(s) for s in sets], np.float64)
    links = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(links, False)
    return links


def _forest(links: np.ndarray) -> np.ndarray:
    """For each member the least one connected with it."""
    root = np.arange(len(links))
    while True:
        near = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """One block after the other, each with its members' sets, in order of block."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("ref")
        links = linked([np.frombuffer(x, np.uint64) for x in rows["items"]], threshold)
        side, ref = rows["side"].to_numpy(), rows["ref"].to_numpy()
        if rows["pair_low"].iloc[0] != rows["pair_high"].iloc[0]:
            links &= side[:, None] != side[None, :]
        return pd.DataFrame({"ref": ref, "links": links @ rows["copies"].to_numpy(np.int64), "root": ref[_forest(links)]})

    for rows, edges in _blocks(batches, ["root", "pair_low", "pair_high"]):
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield block(rows.iloc[low:high])


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="text").assign(items=[shingles(t).tobytes() for t in batch["text"]])


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h (hash of the text), text."""
    clean = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(clean).alias("h"), clean.alias("text"))


def join(df: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Per row of documents (doc_id, text): id, h, class_id, class_h (least id of its group and that row's h), n_links."""
    docs, stop = keyed(df), stop_depth(threshold, target)
    sets = cut(docs.mapInPandas(lambda batches: _sets(batches, stop), "id long, h long, d1 long, d2 long, n int, small binary, tries binary"))
    classes = sets.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("tries").alias("tries"))
    classes = cut(classes.select("d1", "d2", "n", "first", "copies", "small", "tries")).withColumn("ref", F.monotonically_increasing_id())  # of what is written, so numbers stay
    groups = components(candidate_ties(classes))
    members = groups.join(classes.select("ref", "n", "first", "copies"), F.col("node") == F.col("ref"))
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(SHINGLES))).cast("int").alias("parts"))
    members = members.join(sizes, "root")
    members = members.select("root", "ref", "copies", "parts", F.col("first.id").alias("id"), F.col("first.h").alias("h"), F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int").alias("side"))
    held = docs.join(members, ["id", "h"]).select("root", "ref", "copies", "parts", "side", "text").mapInPandas(_items, "root long, ref long, copies long, parts int, side int, items binary")
    keys = ("root", "pair_low", "pair_high")
    checked = cut(paired(held, "root", "ref", "copies", "items").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda batches: _verify(batches, threshold), "ref long, links long, root long"))
    links = checked.groupBy("ref").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("ref").alias("a"), F.col("root").alias("b")))
    known = classes.select("ref", "d1", "d2", "first", "copies").join(links, "ref", "left").join(roots.select(F.col("node").alias("ref"), "root"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(least, "root").select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    every = sets.select("id", "h", "d1", "d2").join(known, ["d1", "d2"], "left")
    return every.select("id", "h", F.coalesce("least.id", "id").alias("class_id"), F.coalesce("least.h", "h").alias("class_h"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of documents (doc_id, text)."""
    return join(df.select("doc_id", "text")).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif("class_id", F.lit(NO_ID)).alias("class_id"), "n_links")


def one_of_each(df: DataFrame) -> DataFrame:
    """Documents (doc_id, text and any columns) without near duplicates: the least doc_id of each group, one row of it."""
    kept = join(df).where("id = class_id and h = class_h").select(F.col("id").alias("j_id"), F.col("h").alias("j_h")).distinct()
    clean = F.coalesce(F.col("text"), F.lit(""))
    marked = df.withColumns({"j_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "j_h": F.xxhash64(clean)})
    return marked.join(kept, ["j_id", "j_h"]).dropDuplicates(["j_id", "j_h"]).select(*df.columns)
