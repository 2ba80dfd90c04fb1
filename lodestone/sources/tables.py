"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.text import hash_text, preview, trim_all
from lodestone.operators.evidence import chunk_text


def scan(spark: SparkSession, folder: str, name: str, project: str | None = None) -> DataFrame:
    """A table; of one project only, where it is named: the filter reaches the scan."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table if project is None else table.where(F.col("project_id") == project)


def ingest_text_files(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Text files as documents: the file's name is the title; empty files are refused."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("markdown"), F.col("_metadata.file_name").alias("title"), F.col("_metadata.file_path").alias("source_url"))
    return raw.where(trim_all(F.col("markdown")) != "").select(F.lit(project).alias("project_id"), "title", "source_url", "markdown", hash_text(F.col("markdown")).alias("content_hash"))


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New documents of ``incoming(project_id, title, url, markdown, pos)``: by project and content hash, the first of a batch."""
    new = incoming.withColumn("content_hash", hash_text(F.col("markdown")))
    first = Window.partitionBy("project_id", "content_hash").orderBy("pos")
    new = new.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    new = new.join(existing.select("project_id", "content_hash"), ["project_id", "content_hash"], "left_anti")
    return new.withColumn("title", F.coalesce("title", "url", F.lit("Untitled document")))


def ingest(stored: DataFrame, chunks: DataFrame, incoming: DataFrame, size: int = 700, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """What becomes of ``incoming(pos, project_id, title, url, markdown)``, and the chunks to write.

    ``stored(project_id, content_hash)`` and ``chunks(project_id, content_hash)`` are what is there. The first table is
    ``pos, project_id, content_hash, title, status``: deduped (stored with chunks, or earlier in the batch), backfilled (stored without
    chunks) or new. The second has the chunks of new and backfilled documents with start, end and a preview.
    """
    new = incoming.withColumn("content_hash", hash_text(F.col("markdown"))).withColumn("title", F.coalesce("title", "url", F.lit("Untitled document")))
    key = ["project_id", "content_hash"]
    first = new.groupBy(*key).agg(F.min("pos").alias("first"))
    there = stored.select(*key).distinct().withColumn("there", F.lit(True))
    cut = chunks.select(*key).distinct().withColumn("cut", F.lit(True))
    s = new.join(first, key).join(there, key, "left").join(cut, key, "left")
    status = F.when(F.col("cut") | (F.col("pos") > F.col("first")), "deduped").when(F.col("there"), "backfilled").otherwise("new")
    s = s.withColumn("status", status)
    made = chunk_text(s.where("status != 'deduped'"), "pos", "markdown", size, overlap).withColumn("preview", preview(F.col("chunk_text"), 240))
    return s.select("pos", *key, "title", "status"), made


def scan_memories(raw: DataFrame) -> DataFrame:
    """``raw`` memories whose ``entities``, ``source_urls`` and ``metadata`` are JSON: arrays of text, none where it is no array; confidence .7 and no metadata by default."""
    array = lambda c: F.coalesce(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    metadata = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return raw.withColumn("entities", array("entities")).withColumn("source_urls", array("source_urls")).withColumn("confidence", F.coalesce("confidence", F.lit(0.7))).withColumn("metadata", metadata)


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` with the number of their ``chunks`` by ``doc_id``, newest first by ``pos``."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return documents.join(n, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def conversation_turns(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and first messages that ``jobs(job_id, conversation_id, question)`` need: those without one get one, named by the question's first 80 characters."""
    j = jobs.withColumn("conv", F.coalesce("conversation_id", F.concat(F.lit("conv-"), F.col("job_id").cast("string"))))
    made = j.where("conversation_id is null").select(F.col("conv").alias("conversation_id"), F.substring("question", 1, 80).alias("title"))
    return made, j.select(F.col("conv").alias("conversation_id"), F.lit("user").alias("role"), F.col("question").alias("content"))


def upsert_vectors(store: DataFrame, points: DataFrame) -> DataFrame:
    """``store`` and ``points`` (both id, vector, payload, version): the latest version of each id."""
    both = store.unionByName(points)
    latest = F.max_by(F.struct("vector", "payload", "version"), "version").alias("x")
    return both.groupBy("id").agg(latest).select("id", "x.*")


def normalize_search_results(raw: DataFrame) -> DataFrame:
    """Candidates from ``raw(provider, body)``, the providers' JSON: url, title, reason, tier, published_at, provider, pos.

    Rows without a url go; a missing title is the host.
    """
    item = "array<struct<url:string,title:string,name:string,html_url:string,description:string,content:string,snippet:string,publishedAt:string,published_date:string,pushed_at:string,updated_at:string,created_at:string,metadata:struct<sourceURL:string,title:string,publishedTime:string>>>"
    got = raw.withColumn("j", F.from_json("body", f"struct<data:{item},results:{item},items:{item}>"))
    rows = got.select("provider", F.posexplode(F.coalesce("j.items", "j.data", "j.results")).alias("pos", "r"))
    text = lambda *c: F.coalesce(*[F.nullif(trim_all(F.col(x)), F.lit("")) for x in c])
    url = F.when(F.col("provider") == "github", text("r.html_url", "r.url")).otherwise(text("r.url", "r.metadata.sourceURL"))
    out = rows.select("provider", F.col("pos").cast("long").alias("pos"), url.alias("url"), text("r.title", "r.name", "r.metadata.title").alias("title"), text("r.description", "r.snippet", "r.content").alias("reason"), text("r.publishedAt", "r.published_date", "r.metadata.publishedTime", "r.pushed_at", "r.updated_at", "r.created_at").alias("published_at"))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://(?:www\.)?([^/?#:]+)", 1)
    return out.where("url is not null").withColumn("title", F.coalesce("title", host)).withColumn("tier", F.when(F.col("provider") == "github", "reference_examples"))


def route_budgets(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """``route, provider, max_results, enabled``; ``overrides``, of the same columns, replace what they are not null in, for all routes where theirs is null."""
    base = spark.createDataFrame([(r, p, *x) for r, of in K.ROUTE_BUDGETS.items() for p, x in of.items()], "route string, provider string, max_results int, enabled boolean")
    if overrides is None:
        return base
    o = overrides.select(F.col("route").alias("r"), F.col("provider").alias("p"), F.col("max_results").alias("most"), F.col("enabled").alias("on"))
    own = base.join(F.broadcast(o), (F.col("provider") == F.col("p")) & (F.col("r").isNull() | (F.col("route") == F.col("r"))), "left")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("r").isNotNull()))  # noqa: E731  a route's own override before that of all
    g = own.groupBy("route", "provider", "max_results", "enabled").agg(last("most").alias("most"), last("on").alias("on"))
    return g.select("route", "provider", F.coalesce("most", "max_results").alias("max_results"), F.coalesce("on", "enabled").alias("enabled"))


def source_registry(spark: SparkSession) -> DataFrame:
    """The known documentation as candidates, in order of ``pos``."""
    rows = [(k, title, product, domain, url, "official_docs", topics, keywords, reason, "registry") for k, (title, product, domain, url, topics, keywords, reason) in enumerate(K.SOURCE_REGISTRY)]
    out = spark.createDataFrame(rows, "pos long, title string, product string, domain string, url string, tier string, topics array<string>, keywords array<string>, reason string, source string")
    return out.withColumn("published_at", F.lit(None).cast("timestamp"))


def normalize_scrape_results(raw: DataFrame) -> DataFrame:
    """Pages from ``raw(body)``, the JSON rows of a scraping service: url, title, markdown; rows without a url or any text go.

    Markdown of under 100 characters gives way to the description, the content or the title.
    """
    inner = "metadata:struct<title:string,sourceURL:string>,markdown:string,content:string,title:string,url:string"
    r = raw.withColumn("r", F.from_json("body", f"struct<data:struct<{inner}>,description:string,{inner}>"))
    first = lambda *c: F.coalesce(*[F.nullif(F.col("r." + x), F.lit("")) for x in c])
    r = r.select(first("url", "data.url", "metadata.sourceURL").alias("url"), first("data.metadata.title", "data.title", "metadata.title", "title").alias("title"), first("data.markdown", "markdown", "data.content", "content").alias("md"), first("description", "content").alias("other"))
    r = r.where("url is not null").withColumn("title", F.coalesce("title", "url"))
    short = F.length(trim_all(F.coalesce("md", F.lit("")))) < 100
    return r.select("url", "title", F.when(short, F.coalesce("other", "title")).otherwise(F.col("md")).alias("markdown")).where(trim_all(F.col("markdown")) != "")


def load_query_suite(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions with the least numbers of pages, claims and citations that they must reach."""
    return spark.read.schema("id string, category string, query string, minAcceptedPages int, minFilteredClaims int, minCitations int").option("multiLine", True).json(path)


def write_run_summary(rows: DataFrame, folder: str) -> None:
    """``rows`` as JSON, as CSV with a header, all values quoted, and as a Markdown table, below ``folder``."""
    flat = rows.select(*[F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast("string").alias(f.name) for f in rows.schema.fields])
    rows.write.mode("overwrite").json(f"{folder}/json")
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{folder}/csv")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(c, r"\|", "\\\\|"), F.lit("")) for c in flat.columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(flat.columns) + " |"), (1, "|" + "---|" * len(flat.columns))], "k int, value string")
    head.unionAll(flat.select(F.lit(2), cells)).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{folder}/markdown")


def vector_stats(vectors: DataFrame) -> DataFrame:
    """How many vectors of which length a store has."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("points"))
