"""Helpers that the corpus operators share: word rules, scratch tables, streaming groups and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Spark's regular expressions; words are runs of everything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Scratch folders that this session has named.
SCRATCH: list[str] = []


def discard_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this session's operators have written, and count them.

    For use once results are written elsewhere: tables that operators have returned, and token files that were given no folder, read from there.
    """
    n = 0
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop() + "*")  # and what its users have named after it
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        n += sum(store.delete(found.getPath(), True) for found in store.globStatus(path) or [])
    return n


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where the session names none (tests on one machine), a checkpoint folder is set first.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = jsc.getCheckpointDir().get()
    SCRATCH.append(f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iter_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by ``keys`` yield tables that hold whole key groups: many small groups at once.

    A group that is larger than a batch is gathered from its batches; callers split hot groups beforehand.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = run_starts(table, keys)
        last = int(starts[-1])
        same = held and all(held[-1].column(k)[-1].as_py() == table.column(k)[0].as_py() for k in keys)
        if same and last == 0:
            held.append(table)
            continue
        if held and not same:
            yield pa.concat_tables(held)
            held = []
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        a = table.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for every node of an edge, root being the smallest node of its component (also for
    the root itself). Each round is joins and partial aggregations only, is written to the shared folder, and no
    node's neighbours are ever gathered in one row, so a hub with very many neighbours is dealt with by Spark's
    skewed-join splitting.
    """

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = df.select("u", "v").unionAll(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:  # u is the larger end
            pairs = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = signature(now)
    for _ in range(max_rounds if seen[0] else 0):
        now = written(star(star(now, True), False))
        was, seen = seen, signature(now)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
