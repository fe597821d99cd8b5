"""Quality rules, line first: lines that break a rule go, then documents that lost too much text go.

Everything is Spark's own expressions. A document's three-word windows are hashed in place, and only a
document that has an equal pair sorts its (hash, position) list to count the words under repeated windows:
no row leaves its partition, so there is no shuffle and no hot key.

Line rules, judged on each line that has a word:
- punctuation: more than a fifth of its non-space characters are symbols, or more than a tenth are exclamation
  or question marks while it has five words or more;
- navigation: at least three separators (| » › or a middle dot), and at most three words between two of them on average;
- boilerplate: it has under 25 words and one of the phrases that sites repeat on every page.
A document is kept when it passes the base rules and lost at most MAX_LOST of its non-space characters.

Edge cases: a null or blank text has no words and fails the base rules; repeated rows are judged alike; a tie
with a limit passes; very long texts cost n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, WORD_CLASS, word_array

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&<>{}[]=_~^\\"
SEPARATORS = "|»›·"
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "cookie policy", "click here", "enable javascript", "log in to", "privacy policy",
    "read more", "sign in", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use", "use cookies",
)
MAX_SYMBOLS, MAX_MARKS, MAX_LOST = 0.2, 0.1, 0.5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _solid(text: Column) -> Column:
    """Code points other than separators of words."""
    return F.char_length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def bad_line(line: Column) -> Column:
    """Whether a line breaks a rule."""
    solid = _solid(line)
    count = lambda characters: F.char_length(line) - F.char_length(_without(line, characters))
    n_words = F.size(word_array(line))
    low = F.lower(line)
    symbols = count(LINE_SYMBOLS) > solid * MAX_SYMBOLS
    marks = (count("!?") > solid * MAX_MARKS) & (n_words >= 5)
    separators = count(SEPARATORS)
    navigation = (separators >= 3) & (n_words - separators <= 3 * (separators + 1))
    phrase = F.lit(False)
    for x in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(x))
    return (solid > 0) & (symbols | marks | navigation | ((n_words < 25) & phrase))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base measures, the text without bad lines (clean_text), its lost share and the verdict.

    Columns added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed,
    lost, kept, clean_text. Columns of df with these names are replaced; names that start with q_ are used within.
    """
    x = df.withColumn("q_text", F.coalesce(F.col(text), F.lit("")))
    x = x.withColumn("q_words", word_array(F.col("q_text"))).withColumn("q_lines", F.split("q_text", "\n"))
    n = F.size("q_words")
    w = F.col("q_words")
    windows = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
    x = x.withColumn("q_windows", windows)
    h = F.col("q_windows")
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    placed = F.when(repeats, F.sort_array(F.transform(h, lambda a, i: F.struct(a.alias("h"), i.alias("i")))))
    x = x.withColumn("q_placed", placed)
    s = F.col("q_placed")
    again = F.filter(s, lambda a, i: a.h.eqNullSafe(F.get(s, i - 1).h) | a.h.eqNullSafe(F.get(s, i + 1).h))
    x = x.withColumn("q_again", F.sort_array(F.transform(again, lambda a: a.i)))
    p = F.col("q_again")
    steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))
    lines = F.filter("q_lines", lambda a: a.rlike(WORD_CLASS))
    x = x.withColumn("q_full", lines).withColumn("q_marked", F.transform("q_lines", lambda a: F.struct(a.alias("l"), bad_line(a).alias("bad"))))
    x = x.withColumn("clean_text", F.array_join(F.transform(F.filter("q_marked", lambda a: ~a.bad), lambda a: a.l), "\n"))
    x = x.withColumns({
        "n_words": n.cast("long"),
        "word_chars": _solid(F.col("q_text")).cast("long"),
        "n_symbols": (F.char_length("q_text") - F.char_length(_without(F.col("q_text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("q_full") - F.size(F.array_distinct("q_full"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_lines_removed": F.size(F.filter("q_marked", lambda a: a.bad)).cast("long"),
    })
    x = x.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    x = x.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - _solid(F.col("clean_text")) / F.col("word_chars")).otherwise(0.0))
    x = x.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MAX_LOST))
    return x.drop("q_text", "q_words", "q_lines", "q_windows", "q_placed", "q_again", "q_full", "q_marked")


def cleaned(df: DataFrame) -> DataFrame:
    """Documents (text and any columns) that are kept, with the text cleaned.

    The filter also names a running number, which keeps the optimizer from moving it below the measures and so
    computing them once for each place where the verdict uses them.
    """
    measured = measure(df).withColumn("q_row", F.monotonically_increasing_id()).where("kept and q_row >= 0")
    return measured.select(*(F.col("clean_text").alias(c) if c == "text" else F.col(c) for c in df.columns))


def digest(df: DataFrame) -> DataFrame:
    """Measures and verdict for each document (doc_id, text)."""
    return measure(df.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", F.round("lost", 6).alias("lost"))


def measured_sql(table: str = "documents") -> str:
    """SELECT of doc_id, the measures, the verdict and clean_text from a table with doc_id and text."""
    blank = " || ".join(["' '", *(f"chr({i})" for i in range(9, 14))])
    q = lambda x: x.replace("'", "''")
    without = lambda t, chars: f"translate({t}, '{q(chars)}', '')"
    solid = lambda t: f"length(translate({t}, {blank}, ''))"
    count = lambda t, chars: f"(length({t}) - length({without(t, chars)}))"
    n_words = f"len(list_filter(string_split_regex(l, '{SPACE_CLASS}+'), lambda w: w <> ''))"
    phrase = " OR ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)
    bad = (
        f"({solid('l')} > 0 AND ({count('l', LINE_SYMBOLS)} > {solid('l')} * {MAX_SYMBOLS}::DOUBLE"
        f" OR ({count('l', '!?')} > {solid('l')} * {MAX_MARKS}::DOUBLE AND {n_words} >= 5)"
        f" OR ({count('l', SEPARATORS)} >= 3 AND {n_words} - {count('l', SEPARATORS)} <= 3 * ({count('l', SEPARATORS)} + 1))"
        f" OR ({n_words} < 25 AND ({phrase}))))"
    )
    return f"""
WITH q_base AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, *, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{SPACE_CLASS}+'), lambda w: w <> '') AS words,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}
), q_repeats AS (
  SELECT row_no, count(DISTINCT i + o)::BIGINT AS n_repeat FROM (
    SELECT row_no, i, count(*) OVER (PARTITION BY row_no, words[i], words[i + 1], words[i + 2]) AS same
    FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM q_base)), unnest([0, 1, 2]) AS v(o)
  WHERE same > 1 GROUP BY row_no
), q_measured AS (
  SELECT q_base.*, len(words)::BIGINT AS n_words, {solid("t")}::BIGINT AS word_chars, {count("t", SYMBOLS)}::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda l: regexp_matches(l, '{WORD_CLASS}'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '{WORD_CLASS}')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, coalesce(array_to_string(list_filter(lines, lambda l: NOT {bad}), chr(10)), '') AS clean_text,
    len(list_filter(lines, lambda l: {bad}))::BIGINT AS n_lines_removed
  FROM q_base LEFT JOIN q_repeats USING (row_no)
), q_failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1 - {solid("clean_text")}::DOUBLE / word_chars ELSE 0.0::DOUBLE END AS lost FROM q_measured
)
SELECT *, NOT base_failed AND lost <= {MAX_LOST} AS kept FROM q_failed"""


def sql() -> str:
    return f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, round(lost, 6) AS lost FROM ({measured_sql()})"
