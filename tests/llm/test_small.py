"""Operators against brute force on small, awkward inputs."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import fingerprints, mixing, ngram_join, packing, pii, quality, repeats, substrings, suffix_index, toxicity, urls

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    return brute.hard_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def want(rows):
    return sorted(rows, key=str)


def test_substring_dedup(docs, rows):
    assert got(substrings.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring_dedup(rows))


def test_suffix_dedup(docs, rows):
    assert got(suffix_index.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.suffix_dedup(rows))


SUBSTRINGS = ("doc_id", "n_words", "n_removed", "kept_sha256")
SUFFIXES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("budget", [1 << 30, 900, 0])
def test_large_groups(docs, rows, monkeypatch, budget):
    """Groups indexed in many parts, and groups whose prefix is lengthened to the whole window: some of them, or all."""
    for name, value in (("CHUNK", 300), ("BUDGET", budget), ("TEXTS", 2000)):
        monkeypatch.setattr(repeats, name, value)
    assert got(substrings.digest(docs), *SUBSTRINGS) == want(brute.substring_dedup(rows))
    assert got(suffix_index.digest(docs), *SUFFIXES) == want(brute.suffix_dedup(rows))


def words_of_six(rng):
    return lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("budget", [1 << 20, 400])
def test_large_groups_of_repeated_rows(spark, monkeypatch, budget):
    """A row that is repeated sends its strings as often."""
    some = words_of_six(random.Random(31))
    passage = some(45)
    rows = [(1, " ".join(some(40) + passage + some(40)))] * 60
    rows += [(i, " ".join(some(40) + passage + some(40))) for i in range(2, 6)]
    for name, value in (("CHUNK", 300), ("BUDGET", budget)):
        monkeypatch.setattr(repeats, name, value)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(substrings.digest(df), *SUBSTRINGS) == want(brute.substring_dedup(rows))
    assert got(suffix_index.digest(df), *SUFFIXES) == want(brute.suffix_dedup(rows))


@pytest.mark.parametrize("same_id", [7, None])
def test_different_texts_under_one_id(spark, same_id):
    """They are different documents: one that repeats nothing keeps all its text."""
    rng = random.Random(37)
    some = words_of_six(rng)
    passage = some(60)
    rows = [(same_id, " ".join(some(rng.choice([30, 80])) + (passage if k % 3 == 0 else some(60)))) for k in range(1000 if same_id is None else 40)]
    rows += [(1, " ".join(passage) + " zz yy"), (same_id, "one two"), rows[0]]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert got(substrings.digest(df), *SUBSTRINGS) == want(brute.substring_dedup(rows))
    assert got(suffix_index.digest(df), *SUFFIXES) == want(brute.suffix_dedup(rows))


def some_strings(seed):
    rng = random.Random(seed)
    for _ in range(30):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) * rng.randint(1, 3) for _ in range(rng.randint(1, 12))]
        text = "".join(s + "$" for s in strings)
        yield strings, text, np.array([ord(c) - 96 if c != "$" else 0 for c in text], np.int32), lambda p, text=text: text[p : text.index("$", p)]


def test_suffix_tree():
    for _, text, symbols, tail in some_strings(9):
        tree = substrings.SuffixTree(symbols, 5)
        order = sorted(range(len(text)), key=lambda p: (tail(p), p))
        assert list(tree.leaves) == order
        for k, p in enumerate(order):
            n = max(len(os.path.commonprefix([tail(q), tail(p)])) for q in order[max(0, k - 1) : k + 2] if q != p) if len(order) > 1 else 0
            assert tree.depth[p] == n if n >= 5 else tree.depth[p] < 5


def test_run_index():
    for _, text, symbols, tail in some_strings(10):
        x = suffix_index.RunIndex(symbols, 5)
        order = sorted(range(len(text)), key=lambda p: (tail(p), p))
        transform = [symbols[p - 1] if p else 0 for p in order]
        assert list(np.repeat(*x.runs)) == transform and len(x.sampled) == len(x.runs[0]) <= len(text)
        neighbour, match = x.statistics(0, len(text))
        for before, p in zip(order, order[1:]):
            n = len(os.path.commonprefix([tail(before), tail(p)]))
            assert neighbour[p] == before and (match[p] == n if n >= 5 else match[p] < 5)
        places, classes = x.chains(6)
        by_string = {}
        for p in range(len(text)):
            if len(tail(p)) >= 6:
                by_string.setdefault(tail(p)[:6], []).append(p)
        assert sorted(map(sorted, (places[classes == c].tolist() for c in set(classes.tolist())))) == sorted(v for v in by_string.values() if len(v) > 1)


def test_ngram_join_of_awkward_texts(docs, rows):
    assert got(ngram_join.digest(docs), "doc_id", "class_id", "n_links") == want(brute.near_groups(rows))


def near_copies(n=60, size=90, changes=4):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(size)] = rng.choice(vocabulary)
        out.append((i, " ".join(w)))
    return out + [(n + i, " ".join(rng.choice(vocabulary) for _ in range(size))) for i in range(40)]


def test_ngram_join_of_near_copies(spark):
    rows = near_copies()
    assert got(ngram_join.digest(spark.createDataFrame(rows, DOCS).repartition(4)), "doc_id", "class_id", "n_links") == want(brute.near_groups(rows))


def test_ngram_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = near_copies()
    assert got(ngram_join.digest(spark.createDataFrame(rows, DOCS)), "doc_id", "class_id", "n_links") == want(brute.near_groups(rows))


def texts_with_a_passage(pairs=1500):
    """Near copies at similarity 0.805, two by two, whose texts all hold one passage that is two thirds of them."""
    rng = random.Random(23)
    passage, rows = [f"p{i}" for i in range(120)], []
    for i in range(pairs):
        own = [f"o{rng.randrange(1 << 40)}" for _ in range(60)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:20] + [f"x{rng.randrange(1 << 40)}" for _ in range(15)] + own[35:]))]
    return rows


def test_ngram_join_of_texts_with_a_passage(spark):
    rows = texts_with_a_passage()
    one, two, other = (brute.shingles(rows[i][1]) for i in (0, 1, 2))
    assert 0.8 < len(one & two) / len(one | two) < 0.81 and len(one & other) / len(one | other) < 0.5
    out = got(ngram_join.digest(spark.createDataFrame(rows, DOCS).repartition(4)), "doc_id", "class_id", "n_links")
    apart = {i for i, c, n in out if (c, n) != (i - i % 2, 1)}
    assert len(out) == len(rows) and not apart


def test_one_of_each(spark):
    rows = [(*r, "x") for r in near_copies()] + [(0, near_copies()[0][1], "x"), (500, None, "y"), (501, None, "y")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, DOCS + ", source string"))
    groups = {c for _, c, _ in brute.near_groups([r[:2] for r in rows])}
    assert kept.columns == ["doc_id", "text", "source"] and sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_pii_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@ +-0(9é\n") for _ in range(rng.randint(0, 30)))
        assert [x[:3] for x in pii.spans_of(t) if x[0] in pii.BASE_KINDS] == brute.base_spans(t)


def test_pii_long_runs_are_linear():
    for unit in ("1", "a", "@a", "1.", "+1", "a.", "@"):
        pii.spans_of(unit * 200_000)


def test_pii_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [x[0] for x in pii.spans_of(t)]
    assert kinds("my account GB82 WEST 1234 5698 7654 32.") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("card 378282246310005") == ["short_card"] and kinds("the 378282246310005 thing") == [] and kinds("card order 378282246310005") == []
    assert kinds("call (212) 555-0100 now") == ["local_phone"] and kinds("in (212) 555-0100 there") == []
    plain, near = pii.spans_of("a 10.0.0.1 b")[0][3], pii.spans_of("ip 10.0.0.1 b")[0][3]
    assert near > plain >= pii.THRESHOLD


@pytest.mark.parametrize("after", [" BIC COBADEFF today", " EUR 25", " 2024-01-15", " US", " BIC COBADEFFXXX EUR 12 A B C", ", BIC", ""])
@pytest.mark.parametrize("number", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"])
def test_pii_account_number_before_capitals_or_digits(number, after):
    for before in ("IBAN ", "AB12 CDEF GHIJ ", "GB82 WEST 1234 5698 7654 32 "):
        found = [x[1:3] for x in pii.spans_of(before + number + after) if x[0] == "iban"]
        assert found[-1] == (len(before), len(before) + len(number)) and len(found) == 1 + before.startswith("GB")
    assert pii.redact(number + after) == "[IBAN]" + after


def test_pii_account_number_of_unknown_country():
    rest = "12345678901234567"
    number = next(n for n in (f"ZZ{k:02}{rest}" for k in range(2, 99)) if pii.mod97(n))
    assert [x[:3] for x in pii.spans_of(number + " BIC COBADEFF")] == [("iban", 0, len(number))]
    assert pii.spans_of(number[:-1] + "0 BIC COBADEFF") == []
    pii.spans_of("AB12 " * 50_000)


def test_pii_digest_and_redaction(docs, rows, spark):
    out = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert len(out) == len({i for i, _ in rows})
    text = "é mail a.b@x.org, card 4111 1111 1111 1111 at 1.2.3.4 or +1 (212) 555-0100"
    r = pii.digest(spark.createDataFrame([(1, text), (2, None)], DOCS)).orderBy("doc_id").collect()
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(text))
    assert (r[0].n_email, r[0].n_ip, r[0].n_card, r[0].n_phone, r[0].base_sha256, r[0].spans) == (1, 1, 1, 1, brute.sha(base), base)
    assert (r[1].n_email, r[1].base_sha256, r[1].spans) == (0, brute.sha(""), "")
    assert pii.redact(text) == "é mail [EMAIL], card [CARD] at [IP] or [PHONE]"


def test_quality(spark):
    good = " ".join(f"word{i} goes here." for i in range(40))
    texts = {0: good, 1: None, 2: "", 3: good + "\nHome | About | Contact | Login", 4: "a b c " * 40, 5: "\n".join(["x### y$$$ z%%%"] * 30 + [good]), 6: good + "\nall rights reserved", 7: "### $$$ " * 200, 8: good + "\n" + good}
    out = {r.doc_id: r for r in quality.digest(spark.createDataFrame(list(texts.items()), DOCS)).collect()}
    for i, t in texts.items():
        w = brute.words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeated = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        full = [x for x in (t or "").split("\n") if brute.words(x)]
        assert (out[i].n_words, out[i].word_chars, out[i].n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert out[i].n_dup_lines == len(full) - len(set(full)) and out[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert out[i].base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    assert [out[i].kept for i in range(9)] == [True, False, False, True, False, True, True, False, False]
    assert out[3].n_lines_removed == 1 and out[6].n_lines_removed == 1 and out[5].n_lines_removed == 30
    clean = {r.doc_id: r for r in quality.cleaned(spark.createDataFrame([(i, t, "s") for i, t in texts.items()], DOCS + ", source string")).collect()}
    assert set(clean) == {0, 3, 5, 6} and clean[3].text == good and clean[3].source == "s"


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "http://A.Example.COM/en/712#x": ("a.example.com", "/en/712", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"), "x://b.net/de/1?q": ("b.net", "/de/1", "net/de/", "allow"), "x://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "x://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"), "x://free-bets.io/": ("free-bets.io", "/", None, "block"), "x://free.io/win": ("free.io", "/win", None, "block"),
        "x://free.io/window": ("free.io", "/window", None, "allow"), "x://io/free/free": ("io", "/free/free", None, "allow"), "x://É.org?en": ("É.org", "", None, "allow"), "x://": ("", "", None, "allow"), "x://q/xxx": ("q", "/xxx", None, "block"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.digest(df).orderBy("page_id").collect()] == list(cases.values())


def test_url_vocabulary_from_a_table(spark):
    terms = urls.vocabulary(spark.createDataFrame([("Bad", 1.0), ("so", 0.4), ("and", 0.35), ("then", 0.3), (None, 1.0), ("so", 0.1)], "term string, weight double"))
    df = spark.createDataFrame([(0, "x://bad.io/"), (1, "x://so.io/and/then"), (2, "x://so.io/and"), (3, "x://badly.io/so/so/so"), (4, "x://porn.io/"), (5, "x://a.com/en/bad")], "id int, url string")
    out = {r.id: r.judged.verdict for r in urls.judge_urls(df, terms=terms, rules=(("com", "/en/", "allow"),)).collect()}
    assert out == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}


def test_clashing_columns_of_urls_and_labels(spark):
    pages = spark.createDataFrame([(1, "x://porn.io/", "a", "b", "c")], "page_id long, url string, host string, verdict string, judged string")
    assert [(r.host, r.verdict) for r in urls.digest(pages).collect()] == [("porn.io", "block")]
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a a", "x", "y"), (None, None, "x", "y")], "doc_id long, text string, places string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0, "t"), (None, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    assert toxicity.digest(docs, labels).count() == 3


def check_packing(out, ids_by_doc, size):
    """Pieces are whole, in order, checked by sum; sequences are gapless and not too long."""
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in ids_by_doc:
        pieces = sorted((r for r in by_doc[doc]), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in pieces] == [(k, len(ids[k : k + size]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k : k + size]))) for k in range(0, len(ids), size)]
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


def test_packing(spark):
    rng = random.Random(5)
    tricky = ["Hello World's!! DON'T <|endoftext|>x", "é̀ ΑΣ ΑΣ. a\u2003b c\x0bd\x1ce İ. K", "Σ.'s 's. X's, 'll. _a_. 12.5, ", "", None, " . "]
    texts = tricky + [" ".join(rng.choice(["the", "Cat.", "sat", "ünder", "a", "tree,"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts))
    plain = packing._ids(packing.vocabulary()).tokenizer
    ids = [(i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    out = packing.packed(spark.createDataFrame(rows, DOCS).repartition(3), size=32).collect()
    check_packing(out, ids, 32)
    total = sum(len(x) for _, x in ids)
    assert len({r.sequence_id for r in out}) <= -(-total // 32) + 2


@pytest.mark.parametrize("rows", [5, 1000])
def test_packing_repeated_rows_and_hot_lengths(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "ROWS", rows)
    out = packing.packed(spark.createDataFrame([(1, "a b c")] * 50 + [(2, "a")] * 7, DOCS), size=16).collect()
    assert len(out) == 57 and len({(r.sequence_id, r.offset) for r in out}) == 57
    assert len({r.sequence_id for r in out}) == 14 if rows == 1000 else len({r.sequence_id for r in out}) <= 14 + 57 // rows  # one more for each range


def test_ids_survive_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a"), (None, "b")], DOCS)
    labels = spark.createDataFrame([(big, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (packing.packed(df), toxicity.digest(df, labels), substrings.digest(df), suffix_index.digest(df), ngram_join.digest(df), fingerprints.digest(df), pii.digest(df), quality.digest(df), mixing.digest(df.withColumn("source", F.lit("s")))):
        assert {r.doc_id for r in out.collect()} == {big, None}


def first_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= n]
        if fits:
            best = min(fits, key=lambda i: bins[i])
            bins[best] -= n
        else:
            bins.append(size - n)
    return len(bins)


def test_best_fit_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.randint(4, 60)
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 200))), reverse=True)
        placed, left, gaps = packing.best_fit([(n, row) for row, n in enumerate(lengths)], [], size, True)
        used = {}
        for row, sequence, offset in placed:
            used.setdefault(sequence, []).append((offset, lengths[row]))
        assert len(placed) == len(lengths) and not left and len(used) == first_fit(lengths, size)
        for items in used.values():
            items.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[0][0] == 0 and sum(items[-1]) <= size
        assert sorted(gaps) == sorted((size - sum(max(items)), q) for q, items in used.items() if sum(max(items)) < size)


def test_packing_in_supersteps(spark, monkeypatch):
    """Many ranges: gapless, and hardly more sequences than best fit one by one."""
    monkeypatch.setattr(packing, "ROWS", 60)
    rng = random.Random(8)
    for size, lengths in ((64, [min(64, int(rng.expovariate(0.08)) + 1) for _ in range(900)]), (64, [22] * 500 + [20] * 300 + [1] * 100), (64, [64] * 50)):
        df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES).repartition(3).cache()
        df.count()
        out = packing.pack(df, size).collect()
        by_sequence = {}
        for r in out:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(r.doc_id for r in out) == list(range(len(lengths)))
        for items in by_sequence.values():
            items.sort()
            assert items[0][0] == 0 and sum(items[-1]) <= size and all(a + n == b for (a, n), (b, _) in zip(items, items[1:]))
        assert len(by_sequence) <= first_fit(lengths, size) + len(lengths) // 60, (len(by_sequence), first_fit(lengths, size))


def test_fingerprints(docs, rows):
    out = fingerprints.digest(docs).collect()
    assert len(out) == len(rows)
    key = lambda i: -(1 << 63) if i is None else i
    order = sorted({(key(i), t or "") for i, t in rows})
    by_text = {}
    for r in out:
        mine = [k for k, (i, _) in enumerate(order) if i == key(r.doc_id)]
        assert len(mine) == 1
        text, following = order[mine[0]][1], order[(mine[0] + 1) % len(order)][1]
        n = len(text) // 4
        assert r.n_chars == len(text) and r.edited_sha256 == brute.sha(text[: len(text) - n] + following[:n])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_fingerprints_add_up(spark):
    one, two, three = "a b. c d.\n e f!", "g. h\n", " e f!\na b. c d."
    df = spark.createDataFrame([(one, two, one + "\n" + two, three)], "a string, b string, c string, d string")
    for c in "abcd":
        df = fingerprints.add_fingerprint(df, c, f"f{c}")
    r = df.select((fingerprints.combine(F.col("fa"), F.col("fb")) == F.col("fc")).alias("x"), (fingerprints.combine(F.col("fc"), F.col("fb"), -1) == F.col("fa")).alias("y"), (F.col("fa") == F.col("fd")).alias("z"), (F.col("fa") == F.col("fb")).alias("w")).first()
    assert tuple(r) == (True, True, True, False)


def test_fingerprints_of_long_texts(spark):
    """Lanes neither overflow nor reach into each other."""
    df = spark.createDataFrame([(1, "x\n" * 1_100_000), (2, "x\n" * 1_050_000), (3, "x\n" * 50_000), (4, "".join(f"s{i}. " for i in range(70_000)))], DOCS)
    f = {r.doc_id: r.f for r in fingerprints.add_fingerprint(df, "text", "f").select("doc_id", "f").collect()}
    counts = slice(fingerprints.STRONG, fingerprints.HEAD)
    assert [sum(f[i][counts]) for i in (1, 2, 3, 4)] == [1_100_000, 1_050_000, 50_000, 70_000]
    three = spark.createDataFrame([(f[1], f[2], f[3])], "a array<long>, b array<long>, c array<long>")
    r = three.select(fingerprints.combine(F.col("a"), F.col("b"), -1).alias("x"), fingerprints.combine(F.col("b"), F.col("c")).alias("y"), "a", "c").first()
    assert r.x[fingerprints.HEAD :] == r.c[fingerprints.HEAD :] and r.y[fingerprints.HEAD :] == r.a[fingerprints.HEAD :]


def test_likeness_is_near_the_exact_share(spark):
    """Against inner products of the texts' exact item counts."""
    rng = random.Random(12)
    rows = []
    for k in range(120):
        base = [f"sentence {rng.randrange(10**9)} is here" for _ in range(rng.randint(1, 60))]
        rows += [(2 * k, ". ".join(base)), (2 * k + 1, ". ".join(base[: int(len(base) * rng.random())] + [f"other {rng.randrange(10**9)}" for _ in range(rng.randint(0, 30))]))]
    rows += [(500, " ".join(f"w{i}" for i in range(900))), (501, " ".join(f"w{i}" for i in range(300, 1200)))]  # without marks
    out = {r.doc_id: r.near_next for r in fingerprints.digest(spark.createDataFrame(rows, DOCS)).collect()}

    def items(text):
        s = text.split(". ")
        w = text.split(" ")
        return Counter(s if len(s) > 1 or len(text) <= fingerprints.LONG else zip(w, w[1:], w[2:]))

    for (i, one), (_, two) in list(zip(rows, rows[1:]))[::2]:
        a, b = items(one), items(two)
        ab, aa, bb = (sum(x[k] * y[k] for k in x) for x, y in ((a, b), (a, a), (b, b)))
        assert abs(out[i] - ab / (aa + bb - ab)) < 0.15
    gaps = [abs(out[i]) for i, _ in rows[1:240:2]]
    assert max(gaps) < 0.2 and sum(gaps) / len(gaps) < 0.05


def test_likeness_follows_shared_sentences(spark):
    sentences = [f"sentence number {i} says {i * i}" for i in range(60)]
    text = lambda low, high: ". ".join(sentences[low:high])
    df = spark.createDataFrame([(1, text(0, 40)), (2, text(0, 40)), (3, text(20, 60))], DOCS)
    r = {x.doc_id: x for x in fingerprints.digest(df).collect()}
    assert r[1].near_next == 1.0 and 0.5 < r[1].near_edited < 0.95 and 0.1 < r[2].near_next < 0.6


def mixing_input(spark):
    rows = [(i, ["big", "mid", "small", None][min(3, k)], "w " * (5 + i % 7)) for k, n in enumerate((600, 90, 20, 10)) for i in range(1000 * k, 1000 * k + n)]
    return spark.createDataFrame([*rows, (9000, "empty", None), (9001, "empty", "")], "doc_id long, source string, text string")


def test_mixing_meets_entropy(spark):
    import math

    units = mixing.units_of(mixing_input(spark)).cache()
    sources = mixing.sources_of(units).cache()
    alpha = mixing.exponent(sources, entropy=0.8)
    w = [r.weight for r in mixing.weigh(sources, alpha, 1000.0).collect() if r.weight > 0]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) / math.log(len(w)) == pytest.approx(0.8, abs=1e-3)
    assert mixing.exponent(sources, entropy=1.0) <= 1e-5 and mixing.exponent(sources, entropy=0.0) == 1.0


def test_mixing_weights_against_brute_force(spark):
    """The exponent by trying many, and weights, quotas and passes from it."""
    import math

    sources = mixing.sources_of(mixing.units_of(mixing_input(spark))).cache()
    tokens = {r.source: r.tokens for r in sources.collect()}
    held = {s: n for s, n in tokens.items() if n}
    total = sum(held.values())
    for entropy, most, budget in ((0.8, None, 5000.0), (None, 3.0, 4000.0), (0.9, 2.0, 9000.0)):

        def weights(a):
            z = sum((n / total) ** a for n in held.values())
            return {s: (n / total) ** a / z for s, n in held.items()}

        def fits(a):
            w = weights(a)
            flat = entropy is None or -sum(x * math.log(x) for x in w.values()) <= entropy * math.log(len(w))
            return flat and (most is None or max(w[s] * budget / held[s] for s in held) <= most)

        best = next((k / 20_000 for k in range(20_001) if fits(k / 20_000)), 1.0)
        alpha = mixing.exponent(sources, entropy, most, budget)
        assert alpha == pytest.approx(best, abs=1e-4)
        for r in mixing.weigh(sources, alpha, budget).collect():
            w = weights(alpha).get(r.source, 0.0)
            assert r.weight == pytest.approx(w) and abs(r.quota - w * budget) <= 1 and r.full == (r.quota // tokens[r.source] if w else 1)


def test_mixing_spreads_documents_without_tokens(spark):
    rows = [(i, "none", "") for i in range(3000)] + [(10_000 + i, "some", "w " * 20) for i in range(500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_tokens=1000).groupBy("block").count().collect()
    assert sum(r["count"] for r in out) == 3500 and len(out) >= 10 and max(r["count"] for r in out) < 500


def test_mixing_schedule(spark):
    df = mixing_input(spark)
    tokens = {}
    for r in mixing.units_of(df).collect():
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    out = mixing.mix(df, max_repetition=3.0, block_tokens=500).collect()
    total = sum(tokens.values())
    drawn, per_block = {}, {}
    for r in out:
        drawn[r.source] = drawn.get(r.source, 0) + r.n_tokens
        per_block.setdefault(r.block, []).append(r)
    assert abs(sum(drawn.values()) - total) < 5 * 12 and len({(r.doc_id, r["pass"]) for r in out}) == len(out)
    assert max(drawn[s] / tokens[s] for s in tokens if tokens[s]) < 3.2
    for s in ("big", "mid", "small"):
        shares = [sum(r.n_tokens for r in rs if r.source == s) for b, rs in per_block.items() if b < max(per_block)]
        assert max(shares) - min(shares) <= 2 * 12
    for rs in per_block.values():
        assert sorted(r.position for r in rs) == list(range(len(rs)))
    for s in ("big", "mid"):  # a pass is a permutation, cut by the budget only in the last one
        passes = {}
        for r in out:
            if r.source == s:
                passes.setdefault(r["pass"], set()).add(r.doc_id)
        assert all(len(passes[p]) == len(passes[0]) for p in passes if p < max(passes))


def test_mixing_keeps_every_document(spark):
    df = mixing_input(spark).withColumn("extra", F.lit("m_h"))
    out = mixing.mixed_documents(df, max_repetition=2.0, budget_share=None)
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == df.columns and set(times) == {r.doc_id for r in df.collect()} and max(times.values()) == 2


def test_toxicity_held_out():
    rng = random.Random(4)
    vocabulary = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for _ in range(900):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.15
        t = [rng.choice(vocabulary) for _ in range(60)] + ["junk"] * bad + [rng.choice(["vile", "awful"])] * toxic
        rng.shuffle(t)
        rows.append(np.array(toxicity.places_of(" ".join(t))))
        labels.append((float(bad), float(toxic)))
    y = np.array(labels)
    models = toxicity.fit_chain(rows[:600], y[:600])
    first = toxicity.predict(models[0], rows[600:], np.empty((300, 0)))
    second = toxicity.predict(models[1], rows[600:], first[:, None])
    assert (((second >= models[1].threshold) == (y[600:, 1] == 1)).mean()) > 0.97 and len(models[1].earlier) == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    for rows in ([], [(7, 1, 1)], [(1, None, 1)], [(1, 1, 1), (1, 1, 0), (2, 0, 0)]):
        out = toxicity.digest(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (mixing.digest(docs), pii.digest(docs), quality.digest(docs), packing.packed(docs), substrings.digest(docs), urls.digest(spark.createDataFrame([], "page_id long, url string")), toxicity.digest(docs, labels), ngram_join.digest(docs), fingerprints.digest(docs), suffix_index.digest(docs)):
        assert df.collect() == []
    assert ngram_join.one_of_each(docs).collect() == [] and mixing.mixed_documents(docs, max_repetition=2.0, budget_share=None).collect() == [] and quality.cleaned(docs).collect() == []


def test_clashing_columns(spark):
    """Columns named as the operators' own, and all null."""
    names = ["words", "h", "id", "marks", "n_words", "kept", "lanes", "bucket", "pii_spans", "salt", "length", "rank", "piece"]
    df = spark.createDataFrame([(1, "a text of some words", "s"), (2, None, None)], "doc_id long, text string, source string").select("*", *(F.lit(None).cast("string").alias(n) for n in names))
    for out in (mixing.digest(df), pii.digest(df), quality.digest(df), packing.packed(df), substrings.digest(df), ngram_join.digest(df), fingerprints.digest(df), suffix_index.digest(df)):
        assert {r.doc_id for r in out.collect()} == {1, 2}
    assert ngram_join.one_of_each(df).columns == df.columns


def test_windows_around_a_common_phrase(spark, monkeypatch):
    """Windows of a large group are made only where a longer gram than the group's occurs again, in whole batches, and give a stretch a string."""
    rng = random.Random(41)
    some = words_of_six(rng)
    phrase, passage = some(6), some(40)
    rows = [(i, " ".join(some(30) + phrase + some(30))) for i in range(300)]
    rows += [(i, " ".join(some(20) + phrase + passage[: rng.randint(8, 40)] + some(20))) for i in range(300, 330)]
    asked, wanted = [], repeats.wanted_windows

    def seen(strings, *args):
        asked.append((strings.count(), wanted(strings, *args).count()))
        return wanted(strings, *args)

    for name, value in (("BUDGET", 2000), ("wanted_windows", seen)):
        monkeypatch.setattr(repeats, name, value)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(suffix_index.digest(df), *SUFFIXES) == want(brute.suffix_dedup(rows))
    assert got(substrings.digest(df), *SUBSTRINGS) == want(brute.substring_dedup(rows))
    strings, found = asked[0]
    assert strings > 200 and found < strings / 2


def test_chunks_share_words(monkeypatch):
    """Punctuation behind a word and capitals beyond ASCII cost no encoding of their own, and ids are those of whole texts."""
    path = packing.vocabulary()
    monkeypatch.setattr(packing, "CACHE", 40)
    texts = ["Éclair!! ÉCLAIR. éclair?? eclair.%%% (eclair) eclair's eclair're it's!! x_y __ $$$ a$$$ ÄÖÜß*** µ º. a.b a1b 1, 1!! ١ ŒUVRE œuvre, İstanbul ΣΊΣΥΦΟΣ ΣΑΣ. ǅ été!! ﬁn K. K", None, "", " a  b\n\tc\r", "x<|endoftext|> <|endoftext|>!! end|> a b c d.", "中文。字 日本!! ですよ... naïve-- ÿ~ 'tis 're!!"]
    ids = packing.Ids(path)
    calls, each = [], packing.Ids._each
    monkeypatch.setattr(packing.Ids, "_each", lambda self, chunks: (calls.extend(chunks), each(self, chunks))[1])
    want_ids = [np.array(ids.tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END], "<u4").tobytes() for t in texts]
    packing._ids.cache_clear()
    for _ in range(3):
        assert list(packing.ids_of(texts, path)) == want_ids
        assert [x for t in texts[::-1] for x in packing.ids_of([t], path)] == want_ids[::-1]
    assert not {"Éclair!!", "ÉCLAIR.", "eclair.%%%", "a$$$", "ÄÖÜß***"} & set(calls)
    packing._ids.cache_clear()


@pytest.mark.parametrize("lot, words", [(1, 0), (300, 5), (1 << 20, 1000)])
def test_texts_in_lots(monkeypatch, lot, words):
    """However texts are cut into lots and whatever is kept of them, ids are those of whole texts."""
    path = packing.vocabulary()
    for name, value in (("LOT", lot), ("WORDS", words)):
        monkeypatch.setattr(packing, name, value)
    rng = random.Random(7)
    texts = [rng.choice(["", " \x0b\f", None, "Été, ΣΑΣ привет! naïve\x0bÖl.\x0c12 <|endoftext|>!!", " ".join(rng.choice(["The", "cat,", "été!!", "don't", "x y", "中。"]) for _ in range(40))]) for _ in range(60)]
    packing._ids.cache_clear()
    tokenizer = packing._ids(path).tokenizer
    assert list(packing.ids_of(texts, path)) == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END], "<u4").tobytes() for t in texts]
    packing._ids.cache_clear()


def test_a_lot_encodes_each_word_once(monkeypatch):
    """Words that come back after many other texts, in any case and with punctuation, are encoded once, even where nothing is kept from lot to lot."""
    monkeypatch.setattr(packing, "CACHE", 0)
    sent, encode = [], packing.Ids.encode
    monkeypatch.setattr(packing.Ids, "encode", lambda self, texts: (sent.extend(w for t in texts for w in t.split(" ")), encode(self, texts))[1])
    letters = "abcdefgh"
    groups = [[f"{x}{y}{z}" for y in letters for z in letters] for x in letters]
    texts = [" ".join(w + "." if k % 2 else w.title() for w in groups[k // 128 % 8]) for k in range(128 * 24)]
    packing._ids.cache_clear()
    assert len(list(packing.ids_of(texts, packing.vocabulary()))) == len(texts)
    packing._ids.cache_clear()
    assert len([w for w in sent if w.isalpha()]) == 8 * 64


def test_packing_keeps_the_least_id(spark):
    """The least long is an id like any other, beside a null one."""
    out = packing.packed(spark.createDataFrame([(-(1 << 63), "a b"), (None, "a"), (3, None)], DOCS), size=16).collect()
    assert {(r.doc_id, r.length) for r in out} == {(-(1 << 63), 3), (None, 2), (3, 1)}
