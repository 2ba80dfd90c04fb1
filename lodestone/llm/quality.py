"""Quality rules (operator 9): line-first cleaning with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, words

#: White space between words, symbol characters, marks that may end a line, boilerplate phrases.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LINE_END = r"""[.!?"':;,)\]»”…][\x20\x09-\x0D]*\z"""
BOILERPLATE = r"(?i)cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|licensed under|click here|sign up for"
#: Words in a window of repeats.
WINDOW = 5


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule: punctuation (symbols, shouting), navigation (short, without an end) or boilerplate."""
    n = F.regexp_count(line, F.lit(WORD))
    symbols = count_of(line, SYMBOLS) * 10 > n
    shouting = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) * 3 > 2 * n
    navigation = (n <= 3) & ~line.rlike(LINE_END)
    return (n > 0) & (symbols | shouting | navigation | line.rlike(BOILERPLATE))


def clean(docs: DataFrame, most_lost: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``cleaned`` (the text without failed lines).

    A document is kept if it passes the base rule (at least 10 words; at most 20 % of them in 5-word windows that occur twice
    or more) and its failed lines hold at most ``most_lost`` of its word characters. Null texts have no words and
    are not kept; an empty table gives an empty result; other columns pass through. Lines without a word stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__w", words(F.col(text))).withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate(t, SPACE_CHARS, "")).cast("long")).withColumn("n_symbols", count_of(t, SYMBOLS))
    d = d.withColumn("__lines", F.split(t, "\n"))
    full = F.filter("__lines", lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    d = d.withColumn("n_dup_lines", (F.size(full) - F.size(F.array_distinct(full))).cast("long"))
    # hashes of the word windows; only texts with equal ones look at positions
    windows = F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)]))
    )
    d = d.withColumn("__h", windows)
    d = d.withColumn("__some", F.size(F.array_distinct("__h")) < F.size("__h"))
    d = d.withColumn("__sorted", F.when(F.col("__some"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("__sorted", lambda x, k: (x.h == F.get("__sorted", k - 1).h) & (k > 0) | F.coalesce(x.h == F.get("__sorted", k + 1).h, F.lit(False)))
    d = d.withColumn("__at", F.array_sort(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(F.transform("__at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("__kept", F.filter("__lines", lambda x: ~line_fails(x))).withColumn("cleaned", F.when(F.col(text).isNotNull(), F.concat_ws("\n", "__kept")))
    left = F.length(F.translate(F.concat_ws("", "__kept"), SPACE_CHARS, ""))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - left <= F.lit(float(most_lost)) * F.col("word_chars")))
    # the results come out of a generator, as a filter on them would else be worked out anew down to the text
    found = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    out = d.select(*docs.columns, F.explode(F.array(F.struct(*found))).alias("__q"))
    return out.select(*docs.columns, *[F.col("__q")[c].alias(c) for c in found])


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
c AS (
  SELECT rid, doc_id, w, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl FROM d),
l AS (SELECT rid, unnest(fl) AS line FROM c),
f AS (
  SELECT rid, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
b AS (
  SELECT rid, sum(chars) AS lost FROM f
  WHERE (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 10 > n
    OR (length(line) - length(replace(line, '!!', ''))) * 3 > 2 * n
    OR (n <= 3 AND NOT regexp_matches(line, '[.!?"'':;,)\]»”…][\x20\x09-\x0D]*\z'))
    OR regexp_matches(line, '(?i)cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|licensed under|click here|sign up for')
  GROUP BY rid),
g AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM c, unnest(range(1, n_words - 3)) AS u(i) WHERE n_words >= 5),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) - i AS gap FROM h WHERE n > 1),
s AS (SELECT rid, sum(least(5, coalesce(gap, 5))) AS rep FROM r GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(fl) - len(list_distinct(fl)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * coalesce(rep, 0) > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * coalesce(rep, 0) > 20 * n_words) AND coalesce(lost, 0) <= 0.5 * word_chars AS kept
FROM c LEFT JOIN s USING (rid) LEFT JOIN b USING (rid)
"""
