"""Streams: documents that arrive as files, and job status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import hash_text
from lodestone.operators.evidence import chunk_text


def stream_ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk documents ``(doc_id, text)`` as their Parquet files arrive; a text that came before, in any batch, is skipped.

    Of equal texts of a batch the one of the smallest doc_id stays. The hashes seen are a table below ``out``, by batch and the hash's first
    digits; a batch meets only those of earlier batches and of its own digits, so the stream itself keeps no state. A batch that runs
    again doesn't see what it wrote itself, and writes the same folders again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        first = F.row_number().over(Window.partitionBy("content_hash").orderBy("doc_id"))
        new = batch.withColumn("content_hash", hash_text(F.col("text"))).withColumn("n", first).where("n = 1").drop("n").withColumn("part", F.substring("content_hash", 1, 2))
        seen = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/seen")
        if seen.getFileSystem(spark._jsc.hadoopConfiguration()).exists(seen):
            touched = [r[0] for r in new.select("part").distinct().collect()]  # 256 at most
            old = spark.read.schema("content_hash string, part string, batch long").parquet(f"{out}/seen").where((F.col("batch") < batch_id) & F.col("part").isin(touched))
            new = new.join(old, ["part", "content_hash"], "left_anti")
        fresh = new.persist()
        fresh.select("doc_id", "content_hash").write.mode("overwrite").parquet(f"{out}/documents/batch={batch_id}")
        chunk_text(fresh, "doc_id", "text").write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        fresh.where("content_hash is not null").select("content_hash", "part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/seen/batch={batch_id}")
        fresh.unpersist()

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_job_status(events: DataFrame) -> DataFrame:
    """The latest status of each job of a stream ``events(job_id, status, ts)``; for update or complete mode."""
    last = events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))
    return last.withColumn("terminal", F.col("status").isin("COMPLETED", "FAILED"))
