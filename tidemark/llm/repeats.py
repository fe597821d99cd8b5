"""Groups in which repeated windows of a corpus meet. Both substring operators get their candidates here, and each judges them by its own index.

1. Each text's windows are stood for by anchors (see anchors.py): the suffix at an anchor begins with a gram g, and its context, the
   stretch of all windows that share the anchor, has a hash c. Equal windows lie at equal places around equal grams.
2. A counting pass drops grams that occur once. Where one occurs again, contexts that are equal are one string with several
   places, known from its first one.
3. These strings, a part of the text, are cut from it and meet in the partition of their gram, where the operator's index
   tells which of their windows repeat. A gram whose strings are over BUDGET symbols would not fit in memory: there, the prefix is lengthened, to
   a longer gram, and where that occurs again, to the whole window, so windows meet one by one in an aggregate.
4. What holds of a string holds at each of its places. Marks meet their document, and what they cover is removed.

Texts are shuffled once, by document. Nothing is collected on the driver. A row is known by doc_id and a 64-bit hash of its text.
Of rows of one batch with equal contexts only one goes to the gram's partition, so a passage that a third of the documents hold sends one row a batch
there and not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.anchors import anchors_of, gram_hashes, mix
from tidemark.llm.common import cut, known_id, stored

ROWS = "g long, c long, id long, h long, place long, kind int"
CONTEXTS = "g long, c long, id long, place long, many boolean, symbols binary"
#: Of a string (g, c) with its first place: a stretch from low to high, counted in symbols from the string's start.
STRETCHES = "g long, c long, id long, place long, low int, high int"
WINDOWS = "g long, c long, id long, place long, many boolean, low int, w1 long, w2 long"
#: Kinds of rows: the only one of its batch with this context; stands for others of its batch too; from SPREAD on, one of those others.
ALONE, STANDS, SPREAD = 0, 1, 2
#: Symbols indexed at once; most of them in one group; characters of text whose anchors are made at once; partitions over which one batch's others are spread.
CHUNK, BUDGET, TEXTS, SALTS = 1 << 19, 1 << 20, 8 << 20, 1 << 10
#: Grams over BUDGET, of 8 bytes each, up to which their list is sent to all workers rather than joined by a shuffle.
BROADCAST_GRAMS = 1 << 18
WIDTH_BITS = 8


def first_of(place: Column) -> Column:
    return F.shiftright(place, WIDTH_BITS)


def width_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << WIDTH_BITS) - 1))


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h, text of each row; a null id becomes the least long, a null text is empty."""
    clean = F.coalesce(F.col(text), F.lit(""))
    return df.select(known_id(F.col(doc_id)).alias("id"), F.xxhash64(clean).alias("h"), clean.alias("text"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of about TEXTS characters, or one longer text."""
    part = batch["text"].str.len().cumsum() // TEXTS
    for _, rows in batch.groupby(part.to_numpy(), sort=False):
        yield rows


def anchor_rows(docs: DataFrame, hashes: Callable[[str], np.ndarray], length: int, gram: int) -> DataFrame:
    """Rows of all anchors. place: the first window, and in the last WIDTH_BITS how many more share the anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in chain.from_iterable(map(portions, batches)):
            got = [(a, i, h) for i, h, t in zip(batch["id"].tolist(), batch["h"].tolist(), batch["text"], strict=True) if len((a := anchors_of(hashes(t), length, gram)).g)]
            if not got:
                continue
            sizes = [len(a.g) for a, _, _ in got]
            g, c = (np.concatenate([getattr(a, k) for a, _, _ in got]).view(np.int64) for k in ("g", "c"))
            first, last = (np.concatenate([getattr(a, k) for a, _, _ in got]) for k in ("first", "last"))
            ids, hs = (np.repeat(np.array([x[k] for x in got], np.int64), sizes) for k in (1, 2))
            place = (first << WIDTH_BITS) | (last - first)
            order = np.lexsort((place, ids, c, g))
            g, c, ids, hs, place = (x[order] for x in (g, c, ids, hs, place))
            new = _starts(g, c)
            more = np.append(~new[1:], False)
            kind = np.where(new, np.where(more, STANDS, ALONE), SPREAD + np.arange(len(g)) % SALTS).astype(np.int32)
            yield pd.DataFrame({"g": g, "c": c, "id": ids, "h": hs, "place": place, "kind": kind})

    return docs.mapInPandas(run, ROWS)


def places_of_repeats(rows: DataFrame) -> DataFrame:
    """The rows whose gram occurs again, with `rep` at the first place of each string (g, c), and there with `many` if it has more places."""
    other = F.col("kind") >= SPREAD
    order = Window.partitionBy("g", "salt").orderBy("c", "id", "place")
    x = rows.withColumn("salt", F.when(other, F.col("kind")).otherwise(0))
    x = x.withColumns({"before": F.lag("c").over(order), "after": F.lead("c").over(order)})
    x = x.where((F.col("kind") != ALONE) | F.col("before").isNotNull() | F.col("after").isNotNull())
    rep = ~other & (F.col("before").isNull() | (F.col("before") != F.col("c")))
    many = (F.col("kind") == STANDS) | F.coalesce(F.col("after") == F.col("c"), F.lit(False))
    return x.select("g", "c", "id", "h", "place", rep.alias("rep"), (rep & many).alias("many"))


def contexts(docs: DataFrame, reps: DataFrame, symbols: Callable[[str], np.ndarray], length: int) -> DataFrame:
    """The symbols of each string, cut from the document of its first place; `docs` is partitioned by (id, h)."""
    columns = ["g", "c", "id", "place", "many", "symbols"]
    wanted = reps.groupBy("id", "h").agg(F.collect_list(F.struct("g", "c", "place", "many")).alias("asked"))  # at most the document's own anchors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for i, text, asked in zip(batch["id"], batch["text"], batch["asked"], strict=True):
                all_symbols = symbols(text)
                for a in asked:
                    first, width = a["place"] >> WIDTH_BITS, a["place"] & ((1 << WIDTH_BITS) - 1)
                    out.append((a["g"], a["c"], i, a["place"], a["many"], all_symbols[first : first + width + length].tobytes()))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return docs.join(wanted, ["id", "h"]).select("id", "text", "asked").mapInPandas(run, CONTEXTS)


def stretches(cov: np.ndarray, owner: np.ndarray, begins: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
    """Covered stretches of joined strings as rows of STRETCHES; begins: where each string starts."""
    edge = np.diff(np.concatenate(([0], cov.view(np.int8), [0])))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a string's end is never covered, so stretches stay in theirs
    who = owner[low]
    found = rows.iloc[who][["g", "c", "id", "place"]]
    return found.assign(low=(low - begins[who]).astype(np.int32), high=(high - begins[who]).astype(np.int32))


def judged_in_groups(rows: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], dtype: type) -> DataFrame:
    """Stretches by `judge`, which gets whole groups (rows of CONTEXTS in order of g, c), of CHUNK + BUDGET symbols at most."""

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row that is repeated in the corpus sends its strings as often; they come one after the other, and the first stays."""
        g = c = None
        for batch in batches:
            if len(batch):
                new = _starts(batch["g"].to_numpy(), batch["c"].to_numpy())
                new[0] = (batch["g"].iloc[0], batch["c"].iloc[0]) != (g, c)
                g, c = batch["g"].iloc[-1], batch["c"].iloc[-1]
                if new.any():
                    yield batch[new].reset_index(drop=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in once(batches):
            held.append(batch)
            size += int(batch["symbols"].map(len).sum()) // np.dtype(dtype).itemsize
            if size < CHUNK:
                continue
            every = pd.concat(held, ignore_index=True)
            part = (every["symbols"].map(len).cumsum() // (CHUNK * np.dtype(dtype).itemsize)).to_numpy()
            g = every["g"].to_numpy()
            heads = np.flatnonzero(_starts(g))
            cuts = [h for h, before in zip(heads[1:], heads[:-1], strict=True) if part[h] != part[before]]
            if len(heads) > 1 and (not cuts or cuts[-1] != heads[-1]):
                cuts.append(heads[-1])
            for low, high in zip([0, *cuts[:-1]], cuts, strict=False):
                yield judge(every.iloc[low:high].reset_index(drop=True))
            held = [every.iloc[cuts[-1] if cuts else 0 :]]  # the last group may go on
            size = int(held[0]["symbols"].map(len).sum()) // np.dtype(dtype).itemsize
        if held:
            yield judge(pd.concat(held, ignore_index=True))

    return rows.repartition("g").sortWithinPartitions("g", "c").mapInPandas(run, STRETCHES)


def _flat(held: pd.Series, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings as one array, and where each begins and ends (its last symbol)."""
    sizes = held.map(len).to_numpy() // np.dtype(dtype).itemsize
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(held), dtype).astype(np.uint64), ends - sizes, ends - 1


def wanted_windows(strings: DataFrame, length: int, gram: int, dtype: type) -> DataFrame:
    """g, c, asked (list of first and last window) of the strings with windows that may repeat: those that share an anchor of three quarters
    of the way from `gram` to the window, which occurs again. All windows of a string with other places are asked for."""
    longer = gram + (length - gram) * 3 // 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, begins, ends = _flat(batch["symbols"], dtype)
            a, last = anchors_of(mix(x + np.uint64(1)), length, longer), ends - length + 1
            own = np.searchsorted(begins, a.first, side="right") - 1
            own += a.first > last[own]  # the first of these windows cross into the next string; an anchor's other windows are all in one string
            low, high = np.maximum(a.first, begins[own]), np.minimum(a.last, last[own])
            own, low, high, k = (v[low <= high] for v in (own, low, high, a.g.view(np.int64)))
            yield pd.DataFrame({"k": k, "g": batch["g"].to_numpy()[own], "c": batch["c"].to_numpy()[own], "many": batch["many"].to_numpy()[own], "low": (low - begins[own]).astype(np.int32), "high": (high - begins[own]).astype(np.int32)})

    order = Window.partitionBy("k").orderBy("c", "low")
    rows = strings.mapInPandas(run, "k long, g long, c long, many boolean, low int, high int")
    rows = rows.withColumns({"before": F.lag("c").over(order), "after": F.lead("c").over(order)})
    rows = rows.where(F.col("before").isNotNull() | F.col("after").isNotNull() | F.col("many"))
    return rows.groupBy("g", "c").agg(F.collect_list(F.struct("low", "high")).alias("asked"))


def judged_by_window(rows: DataFrame, length: int, gram: int, dtype: type, first_stays: bool) -> DataFrame:
    """Stretches in groups over BUDGET: their prefix is lengthened, first to a longer gram, of which those that occur once are dropped, and then to the whole
    window (two hashes of 64 bits). Each such group is a single node whose leaves are counted, with partial results before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                x, begins, _ = _flat(part["symbols"], dtype)
                low, high, own = np.array([(m["low"], m["high"], k) for k, asked in enumerate(part["asked"]) for m in asked], np.int64).T
                n = high - low + 1
                own, low = np.repeat(own, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = begins[own] + low
                out = part[["g", "c", "id", "place", "many"]].iloc[own].assign(low=low.astype(np.int32))
                yield out.assign(**{w: mix(gram_hashes(mix(x + np.uint64(seed)), length)[0][at]).view(np.int64) for w, seed in (("w1", 1), ("w2", 1 << 40))})

    # Read three times from the one shuffle of the strings, in parts that don't depend on their bytes: windows, numbers made from them, are many times as large.
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = rows.repartition(n_parts, "g", "c").dropDuplicates(["g", "c"]).select("g", "c", "id", "place", "many", "symbols")
    asked = wanted_windows(strings, length, gram, dtype)
    windows = strings.join(asked, ["g", "c"]).select("g", "c", "id", "place", "many", "symbols", "asked").mapInPandas(run, WINDOWS)
    at = F.struct("id", (first_of(F.col("place")) + F.col("low")).alias("at"))
    facts = windows.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.max("many").alias("often"))
    facts = facts.where("n > 1" if first_stays else "n > 1 or often")
    both = windows.join(facts, ["w1", "w2"])
    both = both.where(at > F.col("first")) if first_stays else both
    # windows of a string share its anchor, so what they cover is one stretch
    return both.groupBy("g", "c", "id", "place").agg(F.min("low").alias("low"), (F.max("low") + length).cast("int").alias("high"))


def marked_documents(df: DataFrame, hashes: Callable[[str], np.ndarray], symbols: Callable[[str], np.ndarray], length: int, gram: int, dtype: type, judge: Callable[[pd.DataFrame], pd.DataFrame], first_stays: bool) -> DataFrame:
    """id, text, marks (list of low, high) of each document.

    hashes: a text's symbols as 64-bit hashes; symbols: the same as the index compares them (dtype); judge: see judged_in_groups.
    first_stays: the first place of a string has the stretches that judge gives, all others are marked whole; else all have them.
    """
    docs = keyed(df)
    places = stored(places_of_repeats(anchor_rows(docs, hashes, length, gram)))  # sorted by gram, so files are a fraction of a checkpoint's rows
    reps = places.where("rep")
    placed = docs.repartition("id", "h")  # the one shuffle of the texts, read by both joins
    large = cut(reps.groupBy("g").agg(F.sum(width_of(F.col("place")) + length).alias("n")).where(F.col("n") > BUDGET).select("g"))
    strings = lambda asked: contexts(placed, asked, symbols, length)
    n_large = large.count()
    if n_large <= BROADCAST_GRAMS:
        large = F.broadcast(large)
    if not n_large:
        found = judged_in_groups(strings(reps), judge, dtype)
    else:  # the groups are told apart before their strings are cut, so these and the texts are shuffled in one job and not written besides
        found = judged_in_groups(strings(reps.join(large, "g", "anti")), judge, dtype).unionByName(judged_by_window(strings(reps.join(large, "g", "semi")), length, gram, dtype, first_stays))
    if first_stays:  # strings of which nothing is marked still have other places
        found = found.unionByName(reps.where("many").select("g", "c", "id", "place", F.lit(0).alias("low"), F.lit(0).alias("high")))
    found = found.withColumnsRenamed({"id": "rep_id", "place": "rep_place"})
    first, whole = first_of(F.col("place")), width_of(F.col("place")) + length
    is_first = (F.col("id") == F.col("rep_id")) & (first == first_of(F.col("rep_place"))) if first_stays else F.lit(True)
    marks = places.join(found, ["g", "c"]).select("id", "h", (first + F.when(is_first, F.col("low")).otherwise(0)).alias("low"), (first + F.when(is_first, F.col("high")).otherwise(whole)).alias("high"))
    marks = marks.where("high > low").groupBy("id", "h").agg(F.collect_set(F.struct("low", "high")).alias("marks"))  # a set: rows that are repeated send the same marks
    return placed.join(marks, ["id", "h"], "left").select("id", "text", "marks")


def covered(n: int, marks: list | None) -> np.ndarray:
    """Which of n symbols the marks cover."""
    edges = np.zeros(n + 1, np.int64)
    for m in marks if marks is not None else ():
        edges[m["low"]] += 1
        edges[m["high"]] -= 1
    return np.cumsum(edges[:-1]) > 0
