"""Substring dedup on words: every word under a window of LENGTH words that also stands elsewhere is removed.

Suffixes are dealt by variable-length prefixes into groups that fit in memory: content-chosen suffixes stand for all (repeats.py), their prefix is a
gram of GRAM words, grams that occur once are dropped, and the prefix of a group over the budget is lengthened to the whole
window. Each group's suffix tree is built in array form: suffixes in order, and the depths of the nodes between neighbours. A leaf
whose parent node is at least LENGTH words deep is a place of a repeat as long as that node is deep, the longest one that starts there;
a string that stands at several places is a leaf for each of them, so its parent is as deep as the string is long.

Words are told apart by 64-bit hashes.

Edge cases: a null text has no words; texts of fewer than LENGTH words are kept whole; rows equal in doc_id and text
are two documents, so both lose their windows; different texts under one doc_id, null or not, are different documents; a text that repeats
itself loses every occurrence; a null doc_id stays null (the least long stands for it and so comes out as null too); very long texts are handled in slices
of their windows, in memory proportional to one text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, SPACE_CLASS, words_of
from tidemark.llm.repeats import covered, marked_documents, stretches
from tidemark.llm.suffixes import Suffixes, joined

LENGTH, GRAM = 35, 12
#: Words whose hashes a worker keeps, at some 200 bytes each; frequent ones are mostly among the first.
KNOWN = 150_000


class Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN:
            self[word] = h
        return h


_hashes = Hashes()


def hashes(text: str) -> np.ndarray:
    """Hashes of a text's words."""
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


class SuffixTree:
    """The suffix tree of some strings in array form, down to `least`: leaves (places) in order, and for each place the depth of its
    leaf's parent node, which is exact from `least` on and less than it otherwise."""

    def __init__(self, symbols: np.ndarray, least: int):
        x = Suffixes(symbols)
        self.leaves = x.sa
        one, two = x.sa[1:], x.sa[:-1]
        deep = np.flatnonzero(x.begin_alike(one, two, least))
        between = np.zeros(len(one), np.int64)
        between[deep] = x.shared(one[deep], two[deep])
        self.depth = np.zeros(len(symbols), np.int64)
        self.depth[x.sa] = np.maximum(np.append(between, 0), np.insert(between, 0, 0))
        self.room = x.room


def judge(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Stretches of strings that repeat, by the tree of all of them."""
    symbols, owner = joined([np.frombuffer(x, np.uint64) for x in rows["symbols"]])
    tree = SuffixTree(symbols, length)
    depth = np.where(rows["many"].to_numpy(bool)[owner], tree.room, tree.depth)
    at = np.flatnonzero(depth >= length)
    edges = np.bincount(at, minlength=len(symbols) + 1) - np.bincount(at + depth[at], minlength=len(symbols) + 1)
    begins = np.flatnonzero(np.concatenate(([True], symbols[:-1] == 0)))
    return stretches(np.cumsum(edges[:-1]) > 0, owner, begins, rows)


def deduplicated(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_words, n_removed, kept (words joined by a space)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, marks in zip(batch["id"], batch["text"], batch["marks"], strict=True):
                words = words_of(text)
                gone = covered(len(words), marks)
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((i, len(words), int(gone.sum()), " ".join(kept)))
            yield pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept"])

    marked = marked_documents(df, hashes, hashes, length, GRAM, np.uint64, lambda rows: judge(rows, length), first_stays=False)
    out = marked.mapInPandas(run, "id long, n_words long, n_removed long, kept string")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")


def digest(df: DataFrame) -> DataFrame:
    """Counts and digest of what is kept of documents (doc_id, text)."""
    return deduplicated(df.select("doc_id", "text")).withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def sql(length: int = LENGTH) -> str:
    """digest in SQL: every window of every document is counted."""
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE_CLASS}+'), lambda w: w <> '') AS w FROM documents
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d
), windows AS (
  SELECT r, k, count(*) OVER (PARTITION BY s) > 1 AS again FROM (SELECT r, k, array_to_string(w[k : k + {length - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {length - 2})) AS k FROM d))
), judged AS (
  SELECT r, k, word, coalesce(bool_or(again) OVER (PARTITION BY r ORDER BY k ROWS {length - 1} PRECEDING), false) AS gone FROM words LEFT JOIN windows USING (r, k)
), counted AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM judged GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN counted USING (r)"""
