"""Sharding by sampled splitters (operator 3): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written


def range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the ascending ``bounds`` are below ``key``, by halving: n is a power of two, bounds has n - 1 entries."""
    steps, k = [], n // 2
    while k:
        steps.append(k)
        k //= 2
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) < key, at + s).otherwise(at))


def ranged(records: DataFrame, ranges: int = 1024, sample: int = 32_768) -> DataFrame:
    """``records(key long, size long, ...)`` with ``range`` and ``part``: ranges of keys of about equal size.

    Draws keys with a chance in proportion to their size (decided by a hash of the key, so reruns draw the same),
    takes the quantiles of the drawn keys as boundaries, and divides ranges that hold over twice their share
    into parts, as one key may have any number of rows. The sample has about ``sample`` rows at any input size.
    """
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    chance = (F.xxhash64(F.lit(7), "key").bitwiseAND(2**52 - 1)) / F.lit(float(2**52))
    drawn = records.crossJoin(F.broadcast(total)).where(chance * F.col("total") < F.col("size") * F.lit(float(sample)))  # total is one row
    quantiles = [k / ranges for k in range(1, ranges)]
    bounds = drawn.agg(F.percentile_approx("key", quantiles, 1_000_000).alias("bounds"))
    out = records.crossJoin(F.broadcast(bounds))  # one row of ranges - 1 keys
    out = out.withColumn("range", F.coalesce(range_of(F.col("key"), F.col("bounds"), ranges), F.lit(0))).drop("bounds")
    held = written(out.withColumn("__row", F.monotonically_increasing_id()))
    sizes = held.groupBy("range").agg(F.sum("size").alias("in_range"))
    share = sizes.agg((F.sum("in_range") / F.lit(float(ranges))).alias("share"))
    parts = written(sizes.crossJoin(F.broadcast(share)).select("range", F.when(F.col("in_range") > 2 * F.col("share"), F.ceil(F.col("in_range") / F.col("share"))).otherwise(1).cast("int").alias("parts")))
    # at most `ranges` rows
    out = held.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64("__row"), F.col("parts")).cast("int"))
    return written(out.drop("parts", "__row"))


def shard(docs: DataFrame, n_shards: int = 8, ranges: int = 1024) -> DataFrame:
    """Deal documents to shards of near equal bytes: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the UTF-8 bytes of the text plus 1. The key is a hash of doc_id and text; ranges of keys go to shards in
    order, so a shard's bytes miss an eighth by at most a range's size. Slots count from 0 within each shard.
    Null texts have size 1 and checksum 0; null doc_ids, repeated rows and empty tables are dealt like any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", text).alias("key"))
    held = ranged(rows, ranges)
    stats = held.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # a few rows for each range
    order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = stats.agg(F.sum("bytes").alias("total"))
    placed = stats.withColumn("upto", F.sum("bytes").over(order)).crossJoin(F.broadcast(all_of))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((F.col("upto") - F.col("bytes") / 2) * n_shards / F.col("total"))).cast("int"))
    inside = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(placed.select("range", "part", "shard", (F.sum("rows").over(inside) - F.col("rows")).alias("before")))
    row = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32"))
    return held.join(F.broadcast(placed), ["range", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + row - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
