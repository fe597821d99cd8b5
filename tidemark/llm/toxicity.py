"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on the words a text has; each model also gets the
probabilities of the categories before it. For training these are out-of-fold predictions, so that a later model
doesn't learn to trust probabilities that the earlier one fitted on the same rows. The verdict's threshold is the
lowest one at which out-of-fold verdicts are precise enough.

The models are fitted on at most SAMPLE labelled rows (those with the smallest hashes of doc_id); what goes to
the driver are the sampled rows' sets of hashed words. All documents are scored, in one pass over the table.

Edge cases: a null or empty text has no words and gets the models' base rates; labels without a document and
null labels are left out, null doc_ids stay null, and documents with several labels count once (the largest); repeated documents are
scored one by one, and of different texts under a labelled doc_id the least one is learnt from; probabilities at the threshold count as toxic;
without any label of a kind, its probability is the base rate (0 without rows); very long texts are sets of words like others; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, known_id

#: Labelled rows used at most, hashed words, words chosen for each model, folds, ridge.
SAMPLE, DIMENSIONS, WORDS, FOLDS, RIDGE = 12_000, 1 << 18, 192, 4, 1.0
CATEGORIES = ("low_quality", "toxic")
#: Share of right verdicts, out of fold, that the threshold keeps to.
PRECISION = 0.9
MARKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r.,;:!?\"()[]{}#*$%&|<>'"})


class Places(dict):
    """Place of a word among the hashed ones."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = place = zlib.crc32(word.encode()) % DIMENSIONS
        return place


_places = Places()


def places_of(text: str | None) -> list[int]:
    """Places of the different words of a text, lower case, without marks."""
    words = set((text or "").lower().translate(MARKS).split(" "))
    words.discard("")
    return sorted({_places[w] for w in words})


@dataclass(frozen=True)
class Model:
    """A linear model: intercept, weights of places and of earlier categories' log-odds, and the probability from which it says yes."""

    intercept: float
    places: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    threshold: float = 0.5


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _matrix(rows: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Which of the places each row has."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    at = np.searchsorted(places, flat) if len(places) else np.zeros(len(flat), np.int64)
    hit = (at < len(places)) & (places[np.minimum(at, max(len(places) - 1, 0))] == flat) if len(places) else np.zeros(len(flat), bool)
    out = np.zeros((len(rows), len(places)))
    out[np.repeat(np.arange(len(rows)), lengths)[hit], at[hit]] = 1
    return out


def _choose(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Places that tell the classes apart best, by a two-proportion z score."""
    count = lambda keep: np.bincount(np.concatenate([r for r, k in zip(rows, keep, strict=True) if k] or [np.empty(0, np.int64)]).astype(np.int64), minlength=DIMENSIONS)
    yes, no, n1, n0 = count(y == 1), count(y == 0), max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    both = (yes + no) / (n1 + n0)
    z = np.abs(yes / n1 - no / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    z[yes + no < 5] = 0
    best = np.argsort(-z, kind="stable")[:WORDS]
    return np.sort(best[z[best] > 3])


def fit_model(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps."""
    places = _choose(rows, y)
    x = np.hstack([np.ones((len(y), 1)), _matrix(rows, places), _logit(earlier)])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    k = len(places)
    return Model(float(beta[0]), places, beta[1 : k + 1], beta[k + 1 :])


def predict(model: Model, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    score = model.intercept + _matrix(rows, model.places) @ model.weights + _logit(earlier) @ model.earlier
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest probability from which at least PRECISION of out-of-fold verdicts are right, half-way to the next lower one; 0.5 if there is none."""
    order = np.argsort(-p, kind="stable")
    precise = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= PRECISION
    precise[:-1] &= p[order][:-1] != p[order][1:]  # equal probabilities are taken together
    if not precise.any():
        return 0.5
    last = int(np.flatnonzero(precise)[-1])
    lower = p[order[last + 1]] if last + 1 < len(y) else 0.0
    return float((p[order[last]] + lower) / 2)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray) -> list[Model]:
    """Models of the categories (columns of labels, 0 or 1) in order."""
    if not len(rows):
        return [Model(-30.0, np.empty(0, np.int64), np.empty(0), np.zeros(j)) for j in range(labels.shape[1])]
    fold = np.arange(len(rows)) % FOLDS
    earlier, models = np.empty((len(rows), 0)), []
    for j in range(labels.shape[1]):
        y = labels[:, j]
        models.append(fit_model(rows, earlier, y))
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            inside, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(held) and len(inside):
                out[held] = predict(fit_model([rows[i] for i in inside], earlier[inside], y[inside]), [rows[i] for i in held], earlier[held])
        models[-1] = replace(models[-1], threshold=best_threshold(out, y))
        earlier = np.hstack([earlier, out[:, None]])
    return models


def _with_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "places": [places_of(t) for t in b["text"]], "low_quality": b["low_quality"], "toxic": b["toxic"]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Model]:
    """The chain fitted on documents (doc_id, text) that labels (doc_id, quality, toxic) covers."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size is bounded, so it may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *CATEGORIES).agg(F.min("text").alias("text"))
    got = joined.mapInPandas(_with_places, "doc_id long, places array<int>, low_quality int, toxic int").toPandas().sort_values("doc_id")
    return fit_chain([np.asarray(r, dtype=np.int64) for r in got["places"]], got[list(CATEGORIES)].to_numpy(dtype=float).reshape(-1, len(CATEGORIES)))


def score(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, a probability for each category and the verdict, for documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [np.asarray(places_of(t), dtype=np.int64) for t in b["text"]]
            earlier = np.empty((len(rows), 0))
            for m in models:
                earlier = np.hstack([earlier, predict(m, rows, earlier)[:, None]])
            out = pd.DataFrame(np.round(earlier, 6), columns=[f"p_{c}" for c in CATEGORIES], index=b.index)
            yield pd.DataFrame({"doc_id": b["doc_id"], **out, "toxic": earlier[:, -1] >= models[-1].threshold})

    scored = docs.select(known_id(F.col("doc_id")).alias("doc_id"), "text").mapInPandas(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a chain fitted on the labelled ones."""
    return score(docs, fit(docs, labels))
