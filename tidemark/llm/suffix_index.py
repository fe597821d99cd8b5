"""Suffix-array dedup by a run-length index: bytes that stand in a string of LENGTH bytes which starts earlier too.

Strings that may match meet in groups (see repeats.py). A group's strings get one index: the Burrows-Wheeler transform of their sorted
suffixes as runs of equal bytes, and samples at the run ends, which are, for the first suffix of each run, the place of its neighbour before it in
order and how many bytes they share. The sorted suffixes themselves are given up. Inside a run both neighbours are
preceded by the same byte, so neighbour and match of any place follow from the nearest sample before it: the matching statistics of
the text against itself are streamed over it in slices, from as many numbers as there are runs. Repetitive corpora have few runs.
Places whose match with their neighbour reaches LENGTH are chained to it; chains are the classes of equal strings, and all but the
earliest of a class are marked.

Earlier means a smaller doc_id, or the same and an earlier start, in bytes. Matches never cross documents, and
all strings are judged on the input.

Edge cases: a null text counts as empty; texts shorter than LENGTH bytes are kept whole; rows equal in doc_id and
text are each other's ties, of which none is earlier, and so are equal starts of different texts under one doc_id; null doc_ids come before
all others and stay null (the least long stands for them and so comes out as null too); very long texts are handled in slices of their windows, in memory
proportional to one text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID
from tidemark.llm.repeats import WIDTH_BITS, covered, marked_documents, stretches
from tidemark.llm.suffixes import Suffixes, joined

LENGTH, GRAM = 100, 24
TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Places streamed at once.
SLICE = 1 << 17


def hashes(text: str) -> np.ndarray:
    return TABLE[np.frombuffer(text.encode(), np.uint8)]


def raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


class RunIndex:
    """Run-length index of strings, each ended by a 0 in `symbols`; see the module.

    runs: the transform's runs as (symbol, length); a 0, before a string's start, is always a run of its own. sampled, neighbour, match: for each run,
    in order of place, the place of its first suffix, the place of the suffix before that in order (-1 for none), and how much they share
    (exact from `least` on).
    """

    def __init__(self, symbols: np.ndarray, least: int):
        n, x = len(symbols), Suffixes(symbols)
        before = np.concatenate(([0], symbols[:-1]))[x.sa] if n else symbols
        heads = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))) if n else np.empty(0, np.int64)
        self.n, self.runs = n, (before[heads], np.diff(np.append(heads, n)))
        one, two = x.sa[heads], np.where(heads > 0, x.sa[heads - 1], -1)
        match = np.zeros(len(heads), np.int64)
        alike = np.flatnonzero((two >= 0) & x.begin_alike(one, two, least))
        match[alike] = x.shared(one[alike], two[alike])
        order = np.argsort(one)
        self.sampled, self.neighbour, self.match = one[order], two[order], match[order]

    def statistics(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places from low to high: the place of the neighbour before in order, and how much is shared with it."""
        places = np.arange(low, min(high, self.n))
        at = np.searchsorted(self.sampled, places, side="right") - 1
        step = places - self.sampled[at]
        return self.neighbour[at] + step, np.maximum(self.match[at] - step, 0)

    def chains(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose first `length` symbols stand elsewhere too, and for each a place that is the same for all of its class."""
        found = [(low + np.flatnonzero(m >= length), p[m >= length]) for low in range(0, self.n, SLICE) for p, m in [self.statistics(low, low + SLICE)]]
        tied, to = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        places = np.union1d(tied, to)
        root = np.arange(len(places))
        root[np.searchsorted(places, tied)] = np.searchsorted(places, to)
        while (root != (further := root[root])).any():
            root = further
        return places, places[root]


def judge(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Stretches of strings that also start earlier, by the index of all of them."""
    symbols, owner = joined([np.frombuffer(x, np.uint8) for x in rows["symbols"]])
    begins = np.flatnonzero(np.concatenate(([True], symbols[:-1] == 0)))
    places, classes = RunIndex(symbols, length).chains(length)
    ids = rows["id"].to_numpy()[owner[places]]
    start = (rows["place"].to_numpy() >> WIDTH_BITS)[owner[places]] + places - begins[owner[places]]
    order = np.lexsort((start, ids, classes))
    head = np.maximum.accumulate(np.where(np.concatenate(([True], classes[order][1:] != classes[order][:-1]))[: len(order)], np.arange(len(order)), 0))
    earliest = order[head]
    later = places[order[(ids[earliest] != ids[order]) | (start[earliest] != start[order])]]
    edges = np.bincount(later, minlength=len(symbols) + 1) - np.bincount(later + length, minlength=len(symbols) + 1)
    return stretches(np.cumsum(edges[:-1]) > 0, owner, begins, rows)


def deduplicated(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, marks in zip(batch["id"], batch["text"], batch["marks"], strict=True):
                data = raw(text)
                gone = covered(len(data), marks)
                spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).view(np.int8)) == 1))
                rows.append((i, len(data), int(gone.sum()), spans, data[~gone].tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    marked = marked_documents(df, hashes, raw, length, GRAM, np.uint8, lambda rows: judge(rows, length), first_stays=True)
    out = marked.mapInPandas(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digest(df: DataFrame) -> DataFrame:
    """Counts and digest of what is kept of documents (doc_id, text)."""
    return deduplicated(df.select("doc_id", "text")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
