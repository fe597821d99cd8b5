"""Plain versions of the operators, for small inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def mutated(text, rng, times, alphabet="abcde "):
    t = list(text)
    for _ in range(times):
        t[rng.randrange(len(t))] = rng.choice(alphabet)
    return "".join(t)


def hard_texts(seed=3):
    """(doc_id, text) rows with copies, near copies, periodic and very long texts, blanks, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        unit = "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40)))
        rows.append((i, unit * rng.randint(1, 12) + "x" * rng.choice([0, 0, 150, 99, 100])))
    base = "".join(rng.choice("abcd ") for _ in range(900))
    for i in range(80, 110):
        t = mutated(base, rng, rng.randint(0, 5))
        a = rng.randint(0, 300)
        rows.append((i, t[a : a + rng.randint(90, 600)]))
    shared = "".join(rng.choice("pqrst ") for _ in range(240))
    for i in range(110, 140):
        rows.append((i, "".join(rng.choice("uvwxyz ") for _ in range(60)) + shared + "".join(rng.choice("klmno ") for _ in range(60))))
    rows += [(200, ""), (201, None), (202, " \t\n "), (203, base), (204, base), (203, base), (205, "one"), (206, "ab " * 30000), (None, "a null id " * 20)]
    return rows


def substring_dedup(rows, length=35):
    counts = Counter(tuple(w[p : p + length]) for _, t in rows for w in [words(t)] for p in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            if counts[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix_dedup(rows, length=100):
    first = {}
    key = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], (key(i), p)), (key(i), p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (key(i), p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_groups(rows, threshold=0.8):
    """(doc_id, class_id, n_links) by comparing every two rows."""
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(lambda: None)
    key = lambda i: -(1 << 63) if i is None else i
    for a, (i, _) in enumerate(rows):
        r = root(a)
        least[r] = i if r not in least or key(i) < key(least[r]) else least[r]
    return [(i, least[root(a)], links[a]) for a, (i, _) in enumerate(rows)]


def base_spans(text):
    """Personal data by the plain patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out
