"""URL filter: host and path rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

A url is split at its first "://" into host (up to /, ? or #, ASCII lower case) and path (up to ? or #).
The longest rule that fits the host or a parent domain of it, and begins the path, decides. Without a rule
the vocabulary decides: a term counts where no ASCII letter or digit stands on either side of it, in host and path,
lower case; the weights of the different terms found are added, and LIMIT blocks the url: one strict term has as much, a soft one half of it.

Edge cases: a null url, or one without "://", has empty host and path and is allowed; repeated rows are
judged alike; a rule and a vocabulary may fit at once, then the rule decides, and of rules the longest; a very long url is read once by the automaton; an empty
table gives no rows; digest reads page_id and url only, whatever other columns are named.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument

#: Rules as (host, path, verdict); fixed values.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Weights of a strict term, of a soft one, and of different terms together that block a url.
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 1.0, 0.5, 1.0
#: Default terms.
STRICT = ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm", "porn", "xxx", "viagra", "cialis")
SOFT = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "farm", "free", "jackpot", "loan", "lottery", "pills", "poker", "sex", "slots", "spam", "track", "win")
TERMS = tuple((t, SOFT_WEIGHT) for t in SOFT) + tuple((t, STRICT_WEIGHT) for t in STRICT)
#: Most terms of a vocabulary that is read from a table; it goes to every task.
MOST_TERMS = 1_000_000
JUDGED = "struct<host:string,path:string,rule:string,verdict:string,n_strict:int,n_soft:int>"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


@lru_cache(1)
def _rules(rules: tuple) -> list[tuple[str, str, str, str]]:
    return sorted(((h, p, v, h + p) for h, p, v in rules), key=lambda x: -len(x[3]))


def vocabulary(terms: DataFrame) -> tuple[tuple[str, float], ...]:
    """Terms and weights of a table (term, weight), which must have at most MOST_TERMS different terms; the largest weight of a term counts, null terms don't."""
    rows = terms.where("term is not null and term <> ''").groupBy(F.lower("term").alias("term")).agg(F.max("weight").cast("double").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise InvalidArgument(f"more than {MOST_TERMS} terms")
    return tuple(sorted((r.term, r.weight or 0.0) for r in rows))


@lru_cache(4)
def _automaton(terms: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term, weight in terms:
        built.add_word(term, (term, weight))
    built.make_automaton()
    return built


def _plain(c: str) -> bool:
    return not ("a" <= c <= "z" or "0" <= c <= "9")


def weigh_terms(text: str, terms: tuple[tuple[str, float], ...] = TERMS) -> tuple[int, int, float]:
    """How many different strict (LIMIT or more) and soft terms stand alone in a lower-case text, and their weight."""
    found: dict[str, float] = {}
    for last, (term, weight) in _automaton(terms).iter(text) if terms else ():
        first = last - len(term) + 1
        if (first == 0 or _plain(text[first - 1])) and (last + 1 == len(text) or _plain(text[last + 1])):
            found[term] = weight
    strict = sum(w >= LIMIT for w in found.values())
    return strict, len(found) - strict, sum(found.values())


def judge(url: str | None, terms: tuple[tuple[str, float], ...] = TERMS, rules: tuple = RULES) -> tuple[str, str, str | None, str, int, int]:
    """host, path, rule, verdict and counts of terms of one url."""
    host, path = split_url(url)
    n_strict, n_soft, weight = weigh_terms("".join(c.lower() if "A" <= c <= "Z" else c for c in host + path), terms) if host or path else (0, 0, 0.0)
    for h, p, verdict, name in _rules(rules):
        if path.startswith(p) and (host == h or host.endswith("." + h)):
            return host, path, name, verdict, n_strict, n_soft
    return host, path, None, "block" if weight >= LIMIT else "allow", n_strict, n_soft


def judge_urls(df: DataFrame, url: str = "url", into: str = "judged", terms: tuple[tuple[str, float], ...] = TERMS, rules: tuple = RULES) -> DataFrame:
    """df with a struct column of host, path, rule, verdict and counts. A column named as `into` is replaced. terms: see vocabulary."""

    def judged(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(u, terms, rules) for u in urls], columns=["host", "path", "rule", "verdict", "n_strict", "n_soft"]).astype({"n_strict": "int32", "n_soft": "int32"})

    return df.withColumn(into, F.pandas_udf(judged, JUDGED)(F.col(url)))


def digest(df: DataFrame) -> DataFrame:
    """Verdict on each page (page_id, url)."""
    return judge_urls(df.select("page_id", "url")).select("page_id", "judged.*")


def sql() -> str:
    """The same over the table pages, for engines with regular expressions."""
    alone = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)"
    total = lambda terms: " + ".join(map(alone, terms))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{upper}', '{lower}') AS host, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut
), counted AS (
  SELECT *, {total(STRICT)} AS n_strict, {total(SOFT)} AS n_soft FROM (SELECT *, translate(host || path, '{upper}', '{lower}') AS u FROM parts)
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)} END AS rule FROM counted
)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in ordered)} WHEN n_strict * {STRICT_WEIGHT} + n_soft * {SOFT_WEIGHT} >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft
FROM ruled"""
