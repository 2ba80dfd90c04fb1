"""Mixing sources to target weights (operator 8) by hash-threshold histograms: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, written

#: Bits of the hash that one histogram resolves, and how many histograms follow one another.
BITS, LEVELS = 12, 4


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: list[float], budget: float, most: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: shares by weight, none above ``most`` times its source's size.

    The sources in order of code points (null last) take the weights in turn. What a capped source can't take is
    shared among the others by weight until none is above; in the end some level L gives each source
    min(cap, weight * L). Sources are filled in the order in which they reach their caps, which one pass finds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_size"), F.lit(1).alias("one"))
    t = t.crossJoin(F.broadcast(total))
    # sources by the level at which they are full; those before are full when this one is
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("all_size") * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    # the level of the first source that isn't full holds for it and all after it
    t = t.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    level = t.where("open").agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level")).alias("x")).select(F.col("x.level").alias("final"))
    t = t.crossJoin(F.broadcast(level))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``doc_id, source, text_key, size, source_size, target, copies, taken``.

    A source's documents all get the whole copies that fit its target; for the rest, documents whose hash is below
    a threshold get one more. The threshold is found from sums of words by source and hash bucket: the bucket in
    which the sum passes the rest is resolved by the next histogram, over its documents only, and so on; the
    last one is taken if that comes nearer. Nothing is sorted. The hash is of doc_id and text, so reruns agree and
    repeated rows share their fate; no document takes more than ``most`` times its size. Null texts and sources are
    a text without words and a source of their own; an empty table gives an empty result.
    """
    key = F.xxhash64("doc_id", text)
    rows = written(docs.select("doc_id", "source", key.alias("text_key"), n_words(F.col(text)).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id"), key), 64 - BITS * LEVELS).alias("h")))
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goal = written(targets(sizes, list(weights), budget, most))
    goal = goal.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    # low: hashes below it are in; left: words still to come above it
    now = goal.withColumn("low", F.lit(0).cast("long")).withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
    for k in range(LEVELS):
        width = 2 ** (BITS * (LEVELS - 1 - k))
        near = now.select(F.col("source").alias("s"), "low", "left", F.col("base").alias("b"))
        some = rows.join(near, F.col("source").eqNullSafe(F.col("s"))).where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * 2**BITS))
        bins = some.groupBy("source", "low", "left", F.floor((F.col("h") - F.col("low")) / width).alias("bin")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source", "low", "left").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        # the bins that fit whole; the next one is to be refined
        if k < LEVELS - 1:
            fits = F.col("upto") <= F.col("left")
        else:
            fits = F.abs(F.col("upto") - F.col("left")) <= F.abs(F.col("upto") - F.col("words") - F.col("left"))
        inside = bins.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("got"), F.min(F.when(~fits, F.col("bin"))).alias("next"), F.max(F.when(fits, F.col("bin"))).alias("last")).withColumnRenamed("source", "s")
        step = F.coalesce(F.col("next"), F.col("last") + 1, F.lit(0))
        now = written(now.join(inside, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "base", (F.col("low") + step * width).alias("low"), (F.col("left") - F.coalesce("got", F.lit(0))).alias("left")))
    ends = now.select(F.col("source").alias("s"), "source_size", "target", "base", "low")
    out = rows.join(ends, F.col("source").eqNullSafe(F.col("s")))
    copies = F.least(F.lit(int(most)), F.col("base") + F.when(F.col("h") < F.col("low"), 1).otherwise(0)).cast("int")
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns."""
    m = mix(docs, **how).select("doc_id", "text_key", "copies").distinct()
    d = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    joined = d.join(m, d.doc_id.eqNullSafe(m.doc_id) & (F.col("__k") == F.col("text_key"))).where("copies > 0")
    return joined.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[d[c] for c in docs.columns])
