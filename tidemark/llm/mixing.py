"""Mixing sources to target weights: temperature, then budgeted block permutations.

1. Each source's share of tokens is raised to an exponent alpha in [0, 1] and normalised. alpha is found by
   bisection: the entropy of the weights falls and the largest repetition falls as alpha grows, so the exponent
   that meets a target entropy is bracketed, and so is the least exponent that keeps within a repetition limit.
   Each pass over the table of sources is one aggregate that probes PROBES exponents, four halvings at once.
2. A budget of tokens gives each source a quota. A source is passed over as often as its quota needs, each pass a
   pseudo-random permutation of its documents (order of a seeded hash), cut where the quota is reached.
3. The sequence of each source is dealt over blocks in equal token shares, so that every block has the
   sources at their weights; documents of a source without tokens are dealt by hash. Within a block a second hash gives the order.

Running token sums are made in two levels: a source's hash range is split into buckets of about BUCKET rows, whose
totals are summed first. No window holds a whole source, and a hot source only has more buckets.

Edge cases: a null source is the source of empty name; a null text has no tokens; rows equal in doc_id, source
and text move together as one unit; ties in a hash are ordered by doc_id and text hash; null doc_ids stay null; very long texts count by their tokens and
may make a block longer; other columns are ignored, whatever their names, and mixed_documents keeps them (but m_id, m_source, m_h, m_key, m_times and
m_copy); a source without tokens has weight 0 and is passed over once; with an
infeasible target the nearest end of [0, 1] is taken; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, word_array

PROBES, ROUNDS = 15, 5
BUCKET = 20_000
#: Tokens of a block, and most rows of one on average.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 20, 100_000
#: Up to so many sources (about 100 bytes each) are sent to every task; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def units_of(df: DataFrame) -> DataFrame:
    """One row for equal rows (doc_id, source, text): doc_id, source, h, n_copies, n_tokens of all copies."""
    x = df.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("h"), F.size(word_array(F.col("text"))).cast("long").alias("n"))
    return x.groupBy("doc_id", "source", "h").agg(F.count("*").alias("n_copies"), F.sum("n").alias("n_tokens"))


def sources_of(units: DataFrame) -> DataFrame:
    """Tokens and units of each source."""
    return units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_units"))


def _bisect(sources: DataFrame, total: int, low_enough: Callable[[float, float, float], bool]) -> float:
    """The exponent in [0, 1] from which low_enough(exponent, sum of raised shares, their sum with logarithms) holds, to 16^-ROUNDS."""
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(ROUNDS):
        probes = [low + (high - low) * i / (PROBES + 1) for i in range(1, PROBES + 1)]
        sums = [f for i, a in enumerate(probes) for f in (F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * F.ln(share)).alias(f"l{i}"))]
        row = sources.where("tokens > 0").agg(*sums).first()
        fits = [low_enough(a, row[f"z{i}"], row[f"l{i}"]) for i, a in enumerate(probes)]
        first = fits.index(True) if True in fits else PROBES
        low, high = ([low, *probes][first], [*probes, high][first])
    return round(high, 6)


def exponent(sources: DataFrame, entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None) -> float:
    """Exponent for a target entropy (share of the largest possible) and a limit on repetitions.

    Without a budget, repetitions are those of the budget that passes over every source at least once.
    """
    facts = sources.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count("*").alias("n")).first()
    if not facts.n or facts.n == 1:
        return 1.0
    total, least, most = facts.total, facts.least / facts.total, facts.most / facts.total
    alpha = 0.0
    if entropy is not None:
        alpha = max(alpha, _bisect(sources, total, lambda a, z, lz: math.log(z) - a * lz / z <= entropy * math.log(facts.n)))
    if max_repetition is not None:
        repeats = (lambda a, z: (least / most) ** (a - 1)) if budget is None else (lambda a, z: least ** (a - 1) / z * budget / total)
        alpha = max(alpha, _bisect(sources, total, lambda a, z, _: repeats(a, z) <= max_repetition))
    return alpha


def weigh(sources: DataFrame, alpha: float, budget: float | None) -> DataFrame:
    """Sources with weight, quota (tokens) and full (whole passes); budget None: each source is passed over at least once."""
    raised = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha))).otherwise(0.0)
    facts = sources.agg(F.sum(raised).alias("z"), F.max(F.col("tokens") / F.when(raised > 0, raised)).alias("worst")).first()
    if not facts.z:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).cast("long").alias("full"))
    size = facts.worst * facts.z if budget is None else float(budget)
    quota = F.ceil(F.round(raised / facts.z * size, 3)).cast("long")
    return sources.select("*", (raised / facts.z).alias("weight"), quota.alias("quota"), F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(1).cast("long").alias("full"))


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def schedule(units: DataFrame, weights: DataFrame, n_sources: int, block_tokens: int = BLOCK_TOKENS, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows doc_id, source, h, n_copies, n_tokens, pass, block, position of the mix."""
    passes = F.greatest(F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(1), F.lit(1)).cast("int")
    size, rows = (x or 0 for x in weights.agg(F.sum("quota"), F.sum(F.col("n_units") * passes)).first())
    n_blocks = max(1, -(-size // block_tokens), -(-rows // block_rows))
    table = F.broadcast(weights) if n_sources <= BROADCAST_SOURCES else weights
    x = units.join(table, "source")
    x = x.withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    x = x.withColumn("r", F.xxhash64(F.lit(seed), "doc_id", "h", "pass"))
    x = x.withColumn("bucket", F.floor(_unit(F.col("r")) * F.ceil(F.col("n_units") / F.lit(BUCKET))).cast("long"))
    totals = x.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("source", "pass", "bucket", F.coalesce(F.sum("t").over(Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy("r", "doc_id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "pass", "bucket"])
    x = x.withColumn("start", F.col("pass") * F.col("tokens") + F.col("before") + F.col("upto") - F.col("n_tokens"))
    x = x.where((F.col("pass") < F.col("full")) | (F.col("start") < F.col("quota")))
    share = F.when(F.col("tokens") > 0, F.col("start") / F.greatest(F.col("quota"), F.lit(1))).otherwise(_unit(F.xxhash64(F.lit(seed + 2), "doc_id", "h")))
    x = x.withColumn("block", F.least(F.floor(share * n_blocks), F.lit(n_blocks - 1)).cast("long"))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "h", "pass"), "doc_id", "h", "pass", "source")
    return x.select("doc_id", "source", "h", "n_copies", "n_tokens", F.col("pass").cast("int"), "block", (F.row_number().over(order) - 1).cast("long").alias("position"))


def mix(df: DataFrame, entropy: float | None = None, max_repetition: float | None = None, budget_share: float | None = 1.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix of documents (doc_id, source, text) as a schedule.

    entropy: target, as a share of the largest possible; max_repetition: limit on passes over any source;
    budget_share: budget in tokens as a share of the corpus; None: the least that drops no document.
    """
    units = cut(units_of(df))
    sources = cut(sources_of(units))
    facts = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    budget = None if budget_share is None else budget_share * (facts.tokens or 0)
    alpha = exponent(sources, entropy, max_repetition, budget)
    return schedule(units, weigh(sources, alpha, budget), facts.n, block_tokens)


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """Documents as often as the mix has them, with df's columns. Rows join on (doc_id, source, text hash)."""
    taken = mix(df, **how).groupBy("doc_id", "source", "h").agg(F.count("*").alias("m_times"))
    taken = taken.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("h").alias("m_h"), "m_times")
    keyed = df.withColumn("m_key", F.xxhash64("text"))
    joined = keyed.join(taken, keyed.doc_id.eqNullSafe(taken.m_id) & (F.coalesce(keyed.source, F.lit("")) == taken.m_source) & (keyed.m_key == taken.m_h))
    return joined.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_times").cast("int")))).select(*(keyed[c] for c in df.columns))


def digest(df: DataFrame) -> DataFrame:
    """The mix of documents at 95 % of the largest entropy, at most four passes over a source, and the corpus's tokens as budget."""
    return mix(df, entropy=0.95, max_repetition=4.0).select("doc_id", "source", "n_copies", "n_tokens", "pass", "block", "position")
