"""Personal data in texts: patterns propose spans, validators confirm them, nearby words adjust the score.

Five kinds are always reported when their validator holds: email, ip, card (16 to 19 digits that pass
Luhn) and phone (international form). Their score starts at the reporting threshold, so context can only
raise it. Weaker kinds start below the threshold and need a validator and a telling word nearby:
iban (mod-97 holds; reported without context too), short_card (12 to 15 digits, Luhn) and local_phone
(ten digits, national form).

Edge cases: a null text counts as empty; an empty text has no spans; repeated rows are judged alike, one by
one; very long texts are scanned in linear time (no pattern backtracks over more than one candidate).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "local_phone")
BASE_KINDS = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
THRESHOLD = 0.5

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
NO_WORD = re.compile(r"(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

#: Lengths of account numbers by country; one that isn't here may have any.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Words that raise the score of a span when they stand within CONTEXT_CHARS before it or after it.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "short_card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
#: Words that lower the score of the weak kinds.
AGAINST = ("isbn", "order", "invoice", "version", "part", "serial")
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.3, "local_phone": 0.3}
RAISE, LOWER, CONTEXT_CHARS = 0.25, 0.25, 40
WORD = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    """Whether the Luhn checksum of a digit string holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the mod-97 check of an account number without spaces holds."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ with a domain takes the local part that ends at it."""
    done = last = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        low = max(done, text.rfind("@", last, at) + 1)
        last = at
        segment = text[low:at]
        if n := len(segment) - len(segment.rstrip(LOCAL_PART)):
            yield at - n, m.end()
            done = m.end()


def _octets(address: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in address.split(".")))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, leftmost first, to a word's end that passes mod-97: at the country's length, else the longest one; the
    longest that passes where the country isn't known. What a failed one runs over is searched too."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done:
            continue
        ends = [m.start(1) + k + 1 for k, c in enumerate(m[1]) if c != " "]
        compact, usual = m[0] + m[1].replace(" ", ""), IBAN_LENGTHS.get(m[0][:2])
        tried = [n for n in range(len(compact), 14, -1) if NO_WORD.match(text, ends[n - 5])]
        for n in tried if usual is None else [n for n in (usual, *tried[:1]) if n in tried]:
            if mod97(compact[:n]):
                done = ends[n - 5]
                yield m.start(), done
                break


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and validator hold, by kind."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in DIGITS.finditer(text):
        if 11 < m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card" if len(digits) > 15 else "short_card", m.start(), m.end()
    if "." in text:
        for m in IP.finditer(text):
            if _octets(m[0]):
                yield "ip", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {*WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower()), *WORD.findall(text[end : end + CONTEXT_CHARS].lower())}
    score = BASE_SCORE[kind] + RAISE * (not near.isdisjoint(CONTEXT[kind]))
    if kind not in BASE_KINDS:
        score -= LOWER * (not near.isdisjoint(AGAINST))
    return min(1.0, score)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Reported spans (kind, start, end, score) of one text in code points, end exclusive, by kind, then start."""
    if not text:
        return []
    found = [(k, s, e, _score(text, k, s, e)) for k, s, e in _candidates(text)]
    taken = [(s, e) for k, s, e, _ in found if k in BASE_KINDS]
    kept = [x for x in found if x[0] in BASE_KINDS or x[3] >= THRESHOLD and not any(s < x[2] and x[1] < e for s, e in taken)]
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans_of(t)])


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def redact(text: str) -> str:
    """The text with each reported span replaced by its kind in brackets; overlapping spans by the first one's."""
    spans = sorted(spans_of(text), key=lambda x: (x[1], -x[2]))
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_spans(df: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """df with a column of the spans reported in each text. A column named as `into` is replaced."""
    return df.withColumn(into, F.pandas_udf(_spans, SPANS)(F.col(text)))


def redact_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with reported spans in its texts replaced by their kind. Null texts stay null."""
    return df.withColumn(text, F.pandas_udf(_redacted, "string")(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """Counts and digests of the spans of documents (doc_id, text)."""
    found = find_spans(df.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda x: x.kind.isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
