"""Benchmark decontamination (operator 11): a prefix-filtered join of item windows with documents, DataFrame functions only.

A window of an item is a set of shingles, ordered by how rare they are in the documents. A document that contains the whole window contains
each of its shingles, so for containment the first of that order is the necessary prefix: windows and documents join on it
alone. A candidate must leave room for the window before and behind its shingle, and its words are then compared one by one. Both
happen in the stage that reads the documents; only what is found leaves it.

The windows' keys are broadcast in parts of at most ``PART_BYTES``, counted beforehand; every part passes over the documents once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

#: Everything between words: ASCII but for digits and letters; words keep all other characters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of keys that are broadcast at once.
PART_BYTES = 32 << 20


def plain_words(text: Column) -> Column:
    """Words with A-Z lower-cased; none for null."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), GAP), "")


def token(words: str, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from ``at`` on."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def windows_of(items: DataFrame, window: int, text: str) -> DataFrame:
    """``items(item_id, text)`` to the distinct ``(item, a, b, win)``: a, b name the word sequence ``win``."""
    own = items.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col(text)).alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at")
    own = own.select("item", "w", at).select("item", F.slice("w", F.col("at") + 1, window).alias("win"))
    name = F.array_join("win", " ")
    return own.select("item", F.xxhash64(name).alias("a"), F.xxhash64(F.lit(1), name).alias("b"), "win").distinct()


def placed(docs: DataFrame, sizes: list[int], ended: bool) -> DataFrame:
    """A row for each place of ``docs(..., w)`` and shingle size, with the shingle's hash; ``ended`` adds one behind the last word."""
    rows = docs.select("*", F.posexplode(F.array_append("w", F.lit("")) if ended else F.col("w")).alias("at", "word"))
    tokens = F.array(*[F.xxhash64("word", *[F.get("w", F.col("at") + k) for k in range(1, s)]) for s in sizes])
    if len(sizes) == 1:
        return rows.withColumn("token", tokens[0])
    return rows.withColumn("token", F.explode(F.array_distinct(tokens)))


def in_parts(keys: DataFrame, joined) -> DataFrame:
    """The union of ``joined(part)`` over parts of ``keys(token, ...)`` that hold ``PART_BYTES`` or less each, about."""
    n_bytes = keys.agg(F.sum("n_bytes")).first()[0] or 0
    n = -(-n_bytes // PART_BYTES) or 1
    parts = [keys.where(F.pmod(F.xxhash64("token"), F.lit(n)) == k) if n > 1 else keys for k in range(n)]
    return reduce(DataFrame.unionAll, [joined(F.broadcast(p.drop("n_bytes"))) for p in parts])


def find(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences ``(doc_id, k1, k2, n, from, len, a, b)`` of item windows, with one row of ``len`` 0 for every document row; and the windows."""
    windows = written(windows_of(items, window, text))
    kinds = windows.dropDuplicates(["a", "b"]).select("a", "b", "win", F.size("win").alias("len"))
    sizes = sorted(r[0] for r in kinds.select(F.least("len", F.lit(shingle))).distinct().collect()) or [shingle]
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.col("len") - shingle, F.lit(0)))).alias("off")
    shingles = kinds.select("a", "b", "len", "win", at).withColumn("token", token("win", F.col("off"), shingle))
    d = docs.select(F.col("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), plain_words(F.col(text)).alias("w"))
    # how often the shingles occur in all documents
    tokens = shingles.select("token", F.lit(16).alias("n_bytes")).distinct()
    uses = in_parts(tokens, lambda part: placed(d.select("w"), sizes, False).select("token").join(part, "token", "left_semi")).groupBy("token").agg(F.count("*").alias("uses"))
    rare = F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token", "off")).alias("x")
    first = shingles.join(uses, "token", "left").groupBy("a", "b", "len").agg(rare, F.first("win").alias("win"))
    keys = first.select("x.token", "x.off", "a", "b", "len", "win")
    end = kinds.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("token"), F.lit(0).alias("off"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"))
    keys = written(keys.unionAll(end).withColumn("n_bytes", F.lit(64) + F.octet_length(F.array_join("win", "        "))))
    begin = F.col("at") - F.col("off")
    room = (begin >= 0) & (begin + F.col("len") <= F.size("w"))
    same = F.slice("w", F.when(room, begin + 1).otherwise(1), F.col("len")) == F.col("win")

    def joined(part: DataFrame) -> DataFrame:
        rows = placed(d, sizes, True)
        return rows.join(part, "token").where(room & same).select("doc_id", "k1", "k2", F.size("w").alias("n"), begin.alias("from"), "len", "a", "b")

    return written(in_parts(keys, joined)), windows


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, text: str = "text") -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_hit, spans, items, contaminated``.

    Every ``window`` consecutive words of an item are a window; an item of fewer, but not none, is one itself. ``spans`` are the
    stretches of a document's words (from, to) that occurrences of windows cover, ``n_hit`` their words, ``items`` the ids, as
    sorted strings, of items with a window there. Null texts have no words; an item without an id marks words but isn't listed; equal
    items count once for each id; repeated rows stay repeated; empty tables give empty results.
    """
    found, windows = find(docs, items, window, shingle, text)
    key = ["doc_id", "k1", "k2"]
    base = found.where("len = 0").groupBy(*key, "n").agg(F.count("*").alias("m"))
    hits = found.where("len > 0")
    order = Window.partitionBy(*key).orderBy("from")
    spans = hits.groupBy(*key, "from").agg(F.max(F.col("from") + F.col("len")).alias("to"))
    spans = spans.withColumn("begins", F.col("from") > F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    spans = spans.withColumn("span", F.sum(F.col("begins").cast("int")).over(order)).groupBy(*key, "span").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    spans = spans.groupBy(*key).agg(F.sum(F.col("to") - F.col("from")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    names = hits.select(*key, "a", "b").distinct().join(windows.where("item is not null").select("a", "b", "item"), ["a", "b"]).select(*key, "item").distinct()
    names = names.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = spans.join(names, [spans[c].eqNullSafe(names[c]) for c in key], "left").select(*[spans[c] for c in key], "n_hit", "spans", "items")
    out = base.join(found, [base[c].eqNullSafe(found[c]) for c in key], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        base.doc_id, F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("spans", F.array()).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))),
    ).drop("col")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0),
p AS (
  SELECT rid, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM d, (SELECT DISTINCT n FROM v), unnest(range(1, len(w) - n + 2)) AS u(k)),
h AS (SELECT rid, k, v.n, item_id FROM p JOIN v ON p.n = v.n AND p.s = v.s),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM h, unnest(range(k, k + n)) AS u(j) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
