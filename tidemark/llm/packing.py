"""Best-fit packing of token pieces into sequences of a fixed length.

1. Tokenise (mapInArrow): texts are split at blanks, column by column, and each different chunk of a lot of texts is encoded once. Each
   document becomes pieces of at most `size` tokens; only pieces' lengths and checksums go on. Whole texts stay in their partition. A
   piece of `size` tokens is a sequence of its own.
2. Supersteps, from long pieces to short ones, by classes of lengths whose ends are in the ratio RATIO. In a superstep the class's pieces and the gaps of
   the open sequences are range-sorted together, longest first. Then every range sweeps at once: each piece, in order, goes to its
   successor among the range's gaps, the smallest that holds it, and the gap is updated. A piece without one looks in the ranges
   of larger gaps, nearest first; where several ranges want the same gaps, ranks decide: as many of the first pieces go to a range as it
   has gaps, the others go further. Gaps are sorted again and the superstep is repeated. When it finds few places, as many empty sequences as the pieces left
   would fill are added to the gaps, and the longest pieces come first to them.
   Rows that fit in one range are packed by best-fit decreasing. A range has about ROWS rows however the lengths are distributed, since rows of
   equal length are ordered by a number of their own. The driver sees two counts per range, no pieces.
3. Placements join their pieces on that number.

Edge cases: a null text counts as empty and is one token (the end mark); a document whose length is a multiple
of `size` has no empty last piece; ties in length are packed in any order; repeated rows are packed as often as they come; null doc_ids
stay null; a very long text is one row of many pieces, tokenised in memory proportional to it; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SIZE, END = 4096, 1
#: Ratio of the ends of a class of lengths; rows of a range, on average; supersteps of a class after which each range opens sequences for what is left.
#: A superstep finds few places when it places less than this share.
RATIO, ROWS, STEPS, FEW = 4, 200_000, 16, 0.1
#: Bytes of text that a worker splits at once, whole texts. Words whose ids it keeps from one lot to the next, at some 50 bytes each, and
#: other chunks, twice, at some 200.
LOT, WORDS, CACHE = 8 << 20, 1_000_000, 400_000
#: Punctuation that may stand behind a word: a run of it is split from the letters. Apostrophes and the signs of special tokens are not.
BEHIND = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: A word and the punctuation behind it. These letters, up to U+00FF, have the same lower case everywhere, and are composed.
WORD = "^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<behind>[" + re.escape(BEHIND) + "]*)$"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: What a sweep gives. GAP: the room `key` of sequence `row`; LEFT: piece `row` of length `key`, the `rank`-th of those left in range `part`; PLACED: piece `row` at `at` of sequence `sequence_id`.
SWEPT = "kind int, key int, row long, part int, rank long, sequence_id long, at int"
GAP, LEFT, PLACED = 0, 1, 2


def vocabulary() -> str:
    """Path of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _binary(ids: list[np.ndarray], lengths: list[np.ndarray]) -> pa.LargeBinaryArray:
    """Ids one after the other as values of so many ids each."""
    offsets = np.cumsum(np.concatenate([[0], *lengths]), dtype="<i8") * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.zeros(0, "<u4"), *ids]))])


class Ids:
    """Ids (little-endian bytes) of chunks of text between blanks; the vocabulary's splits never cross a blank.

    Chunks that only differ in case or in the punctuation behind a word share the work: such a chunk is a word of letters, encoded in
    lower case, and a run of punctuation. New words are encoded many at a time, and told apart by the tokens that end words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends, self.known, self.before = ends, {"": b""}, {}
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has."""
        ids = self.encode([" ".join(words)])[0]
        highs = np.flatnonzero(self.ends[ids]) + 1
        if len(highs) == len(words):
            return ids, np.diff(highs, prepend=0)
        each = self.encode(words)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _each(self, chunks: list[str]) -> None:
        """Learn any chunks."""
        for i in range(0, len(chunks), 256):
            part = chunks[i : i + 256]
            self.known.update(zip(part, (ids.tobytes() for ids in self.encode(part)), strict=True))

    def _fresh(self, chunks: set[str]) -> list[str]:
        """Those of the chunks that aren't known, now or from before."""
        fresh, before = chunks.difference(self.known), self.before
        if again := [c for c in fresh if c in before]:
            self.known.update(zip(again, map(before.__getitem__, again)))
            fresh.difference_update(again)
        return list(fresh)

    def learn(self, chunks: set[str]) -> None:
        """Learn chunks that aren't of the form WORD; those that are known take no time."""
        fresh = self._fresh(chunks)
        words = [c.rstrip(BEHIND) for c in fresh]
        plain = [w.isalpha() and w == w.lower() for w in words]
        self._each([c for c, p in zip(fresh, plain, strict=True) if not p])
        built = [(c, w, c[len(w) :]) for c, w in compress(zip(fresh, words, strict=True), plain) if c != w]
        self._each(self._fresh({behind for _, _, behind in built}))
        new = self._fresh(set(compress(words, plain)))
        for i in range(0, len(new), 256):
            ids, lengths = self._joined(part := new[i : i + 256])
            self.known.update(zip(part, (x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])), strict=True))
        for c, word, behind in built:
            self.known[c] = self.known[word] + self.known[behind]

    def _of_known(self, chunks: list[str]) -> pa.LargeBinaryArray:
        self.learn(set(chunks))
        return pa.array(list(map(self.known.__getitem__, chunks)), pa.large_binary())

    def _of_words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of different words of WORD in lower case."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        encoded = [self._joined(new[i : i + 256].to_pylist()) for i in range(0, len(new), 256)]
        rows = at.fill_null(0).to_numpy().copy()
        rows[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.words), len(self.words) + len(new))
        self.words, self.word_ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.word_ids, _binary([x for x, _ in encoded], [n for _, n in encoded])])
        found = self.word_ids.take(pa.array(rows))
        if len(self.words) > WORDS:
            self.words, self.word_ids = words, found
        return found

    def of(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of different chunks."""
        split = pc.extract_regex(chunks, WORD)  # null where a chunk isn't of that form
        word, behind = (x.dictionary_encode() for x in (pc.utf8_lower(pc.struct_field(split, "word")), pc.struct_field(split, "behind")))
        word_ids, behind_ids = self._of_words(word.dictionary), self._of_known(behind.dictionary.to_pylist())
        found = pc.binary_join_element_wise(word_ids.take(word.indices), behind_ids.take(behind.indices), pa.scalar(b"", pa.large_binary()))
        odd = split.is_null()
        found = pc.replace_with_mask(found, odd, self._of_known(chunks.filter(odd).to_pylist()))
        if len(self.known) > CACHE:  # keep memory bounded: what has not been met since the last time goes
            self.known, self.before = {"": b""}, self.known
        return found


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(path)


def _lots(texts: pa.LargeStringArray) -> Iterator[pa.LargeStringArray]:
    """The texts, in lots of some LOT bytes each."""
    highs = np.cumsum(pc.binary_length(texts).to_numpy())
    total = int(highs[-1]) if len(highs) else 0
    n = max(1, -(-total // LOT))
    bounds = np.searchsorted(highs, [total * k // n for k in range(1, n)])
    return (texts[low:high] for low, high in pairwise([0, *bounds.tolist(), len(texts)]) if low < high)


def ids_of(texts: list[str | None] | pa.Array, path: str) -> Iterator[bytes]:
    """Token ids of documents, end mark included, as little-endian 32-bit numbers."""
    ids, end = _ids(path), pa.array([END.to_bytes(4, "little")], pa.large_binary())
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
    for lot in _lots(texts):
        split = pc.ascii_split_whitespace(lot)
        chunks = split.flatten().dictionary_encode()
        values = pa.concat_arrays([ids.of(chunks.dictionary), end])
        highs = split.offsets.to_numpy()[1:]
        found = values.take(pa.array(np.insert(chunks.indices.to_numpy(), highs, len(values) - 1)))
        _, offsets, raw = found.buffers()
        marks = highs + np.arange(1, len(lot) + 1)  # behind each text's end mark
        for low, high in pairwise([0, *np.frombuffer(offsets, "<i8")[marks].tolist()]):
            yield raw[low:high].to_pybytes()


def _cut_rows(doc_ids: list, texts: list[str | None] | pa.Array, path: str, size: int) -> Iterator[tuple]:
    for doc_id, raw in zip(doc_ids, ids_of(texts, path), strict=True):
        for piece, start in enumerate(range(0, len(raw), 4 * size)):
            part = raw[start : start + 4 * size]
            yield doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        for batch in batches:
            columns = list(zip(*_cut_rows(batch["doc_id"].to_pylist(), batch["text"], path, size), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def best_fit(pieces: Iterable[tuple[int, int]], gaps: Iterable[tuple[int, int]], size: int, open_new: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Pieces (length, row), longest first, put where they fit best among gaps (room, sequence).

    Returns placements (row, sequence, offset), pieces left, and gaps. A new sequence has the number of its first piece.
    """
    by_room: dict[int, list[int]] = {}
    for room, sequence in gaps:
        by_room.setdefault(room, []).append(sequence)
    rooms, placed, left = sorted(by_room), [], []
    for length, row in pieces:
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            sequence = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        elif open_new:
            room, sequence = size, row
        else:
            left.append((length, row))
            continue
        placed.append((row, sequence, size - room))
        if room > length:
            if room - length not in by_room:
                insort(rooms, room - length)
            by_room.setdefault(room - length, []).append(sequence)
    return placed, left, [(room, x) for room in rooms for x in by_room[room]]


def _sweep(size: int, open_new: bool) -> Callable[[pd.DataFrame, int], pd.DataFrame]:
    """Best fit within a range of rows (kind, key, row)."""

    def run(rows: pd.DataFrame, part: int) -> pd.DataFrame:
        rows = rows.sort_values(["key", "row"], ascending=[False, True], kind="stable")
        pieces, gaps = (rows[rows["kind"] == k] for k in (LEFT, GAP))
        placed, left, gaps = best_fit(zip(pieces["key"].tolist(), pieces["row"].tolist(), strict=True), zip(gaps["key"].tolist(), gaps["row"].tolist(), strict=True), size, open_new)
        out = [(PLACED, 0, row, part, 0, sequence, at) for row, sequence, at in placed]
        out += [(LEFT, length, row, part, rank, 0, 0) for rank, (length, row) in enumerate(left)]
        out += [(GAP, room, row, part, rank, 0, 0) for rank, (room, row) in enumerate(gaps)]
        return pd.DataFrame(out, columns=["kind", "key", "row", "part", "rank", "sequence_id", "at"])

    return run


def _swept(rows: DataFrame, n: int, size: int, open_new: bool) -> DataFrame:
    """n rows (kind, key, row), range-sorted, after a sweep of each range."""
    sweep, ranges = _sweep(size, open_new), -(-n // ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield sweep(pd.concat(held, ignore_index=True), TaskContext.get().partitionId())

    rows = rows.select("kind", "key", "row")
    return cut((rows.coalesce(1) if ranges <= 1 else rows.repartitionByRange(ranges, F.desc("key"), "kind", "row")).mapInPandas(run, SWEPT))


def _shares(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(range, from rank, to rank, other range) of the pieces left in ranges that may look in another one, given gaps and pieces left in each.

    Ranges come in order, largest keys first, so gaps of any earlier range hold pieces of a later one.
    """
    shares, open_ranges = [], []
    for part in sorted(counts):
        gaps, left = counts[part]
        rank = 0
        while open_ranges and rank < left:
            other, free = open_ranges.pop()
            n = min(free, left - rank)
            shares.append((part, rank, rank + n, other))
            rank += n
            if free > n:
                open_ranges.append((other, free - n))
        if gaps:
            open_ranges.append((part, gaps))
    return shares


def _asked(swept: DataFrame, shares: list[tuple[int, int, int, int]]) -> DataFrame:
    """Pieces left and gaps with `target`, the range where they meet. shares: two rows per range at most."""
    table = swept.sparkSession.createDataFrame(shares, "s_part int, s_low long, s_high long, s_other int")
    wanted = swept.where(F.col("kind") == LEFT).join(F.broadcast(table), (F.col("part") == F.col("s_part")) & (F.col("rank") >= F.col("s_low")) & (F.col("rank") < F.col("s_high")), "left")
    wanted = wanted.select("kind", "key", "row", F.coalesce("s_other", F.lit(-1)).alias("target"))
    return wanted.unionByName(swept.where(F.col("kind") == GAP).select("kind", "key", "row", F.col("part").alias("target")))


def _met(asked: DataFrame, size: int) -> DataFrame:
    """Pieces and gaps of each target after a sweep there. A target has its range's gaps and no more pieces than those; pieces without one pass."""
    sweep = _sweep(size, False)
    met = asked.where("target >= 0").groupBy("target").applyInPandas(lambda rows: sweep(rows, 0), SWEPT)
    rest = asked.where("target < 0").select("kind", "key", "row", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).alias("at"))
    return cut(met.unionByName(rest))


def _counted(swept: DataFrame) -> tuple[dict[int, tuple[int, int]], int, int, int]:
    """Gaps and pieces left in each range, and in all: pieces left, their tokens, gaps."""
    is_gap, is_left = F.col("kind") == GAP, F.col("kind") == LEFT
    found = swept.groupBy("part").agg(F.count(F.when(is_gap, 1)).alias("gaps"), F.count(F.when(is_left, 1)).alias("left"), F.coalesce(F.sum(F.when(is_left, F.col("key"))), F.lit(0)).alias("tokens")).collect()
    return {r.part: (r.gaps, r.left) for r in found}, sum(r.left for r in found), sum(r.tokens for r in found), sum(r.gaps for r in found)


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset. Pieces must be stable under recomputation: written, or checkpointed."""
    spark, pieces = cut_pieces.sparkSession, cut_pieces.withColumn("p_row", F.monotonically_increasing_id())
    small = pieces.where(F.col("length") < size).select(F.lit(LEFT).alias("kind"), F.col("length").cast("int").alias("key"), F.col("p_row").alias("row"))
    placed = [pieces.where(F.col("length") == size).select(F.col("p_row").alias("row"), F.col("p_row").alias("sequence_id"), F.lit(0).alias("at"))]
    ends = [size]
    while ends[-1] > 0:
        ends.append(ends[-1] // RATIO)
    in_class = sum((F.when(F.col("key") <= e, 1).otherwise(0) for e in ends[1:]), F.lit(0))
    classes = small.groupBy(in_class.alias("k")).agg(F.count("*").alias("n"), F.sum("key").alias("tokens")).collect()  # a few rows
    gaps, n_gaps, opened = spark.createDataFrame([], "kind int, key int, row long"), 0, 0
    for k, n, tokens in sorted((r.k, r.n, r.tokens) for r in classes):
        left, step, few = small.where((F.col("key") <= ends[k]) & (F.col("key") > ends[k + 1])), 0, n_gaps == 0
        while n:
            alone = step == STEPS or n + n_gaps <= ROWS
            if few and not alone:
                fresh = -(-tokens // size)
                gaps = gaps.unionByName(spark.range(opened, opened + fresh).select(F.lit(GAP).alias("kind"), F.lit(size).alias("key"), (-1 - F.col("id")).alias("row")))
                opened, n_gaps = opened + fresh, n_gaps + fresh
            before, swept = n, _swept(left.unionByName(gaps), n + n_gaps, size, alone)
            placed.append(swept.where(F.col("kind") == PLACED))
            by_part, n, tokens, n_gaps = _counted(swept)
            if n and (shares := _shares(by_part)):
                swept = _met(_asked(swept, shares), size)
                placed.append(swept.where(F.col("kind") == PLACED))
                _, n, tokens, n_gaps = _counted(swept)
            gaps, left = (swept.where(F.col("kind") == kind).select("kind", "key", "row") for kind in (GAP, LEFT))
            few, step = before - n < FEW * before, step + 1
    places = reduce(DataFrame.unionByName, (p.select(F.col("row").alias("p_row"), "sequence_id", F.col("at").cast("long").alias("offset")) for p in placed))
    return pieces.join(places, "p_row").drop("p_row")


def packed(df: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Places of all documents (doc_id, text) in sequences of `size` tokens."""
    return pack(cut(pieces(df, path=path, size=size)), size)
