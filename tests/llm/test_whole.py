"""Registered queries over the sample tables, and the pipeline stage by stage."""

import os

import pytest

from tests.compare import connect, same
from tests.llm import brute
from tests.llm.test_small import check_packing
from tidemark.llm import packing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect())


def test_substrings(spark, texts):
    assert rows(spark, "op5_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(texts))


def test_suffixes(spark, texts):
    assert rows(spark, "op10_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(texts))


def test_near_groups(spark, texts):
    assert rows(spark, "op8_ngram_jaccard_join", "doc_id", "class_id", "n_links") == sorted(brute.near_groups(texts))


def test_pii(spark, texts):
    want = sorted((i, brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(t or "")))) for i, t in texts)
    assert rows(spark, "op2_pii", "doc_id", "base_sha256") == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_held_out(spark):
    """Fitted on one half of some 4,000 labels and held to the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    models = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    out = {r.doc_id: r.toxic for r in toxicity.score(docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "semi"), models).collect()}
    toxic = {r.doc_id: r.toxic == 1 for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in out}
    hits = sum(out[i] and t for i, t in toxic.items())
    precision, recall = hits / max(1, sum(out[i] for i in toxic)), hits / max(1, sum(toxic.values()))
    assert precision > 0.85 and recall > 0.85


def test_pipeline(spark, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.STAGES[0][1](spark, docs, SF).cache()
    verdict = {r.doc_id for r in queries.queries()["op3_quality_rules"](spark, SF).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == verdict
    single = p.STAGES[1][1](spark, kept, SF).cache()
    groups = brute.near_groups([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in groups})
    clean = p.STAGES[2][1](spark, single, SF).cache()
    before = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == pii.redact(before[r.doc_id]) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = p.STAGES[3][1](spark, clean, SF).cache()
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    for df in (kept, single, clean, mixed):
        assert tuple(df.columns) == p.COLUMNS
    out = p.STAGES[4][1](spark, mixed, SF).collect()
    plain = packing._ids(packing.vocabulary()).tokenizer
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    one = [(r.doc_id, plain.encode(r.text, add_special_tokens=False).ids + [1]) for r in clean.collect() if times[r.doc_id] == 1]
    check_packing(out, one, packing.SIZE)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) == sum(-(-len(plain.encode(r.text, add_special_tokens=False).ids + [1]) // packing.SIZE) for r in mixed.collect())
    assert sorted(map(str, p.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(f"Row(doc_id={r.doc_id}, piece={r.piece}, ids_crc32={r.ids_crc32})" for r in out)
