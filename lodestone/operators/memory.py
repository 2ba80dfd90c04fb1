"""Memories of past runs: drafted from evidence and failures, searched, and used to rank sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.scores import by_tier, is_blocked_reason, rounded
from lodestone.functions.text import hostname, normalize_url, unique


def source_quality_memories(claims: DataFrame) -> DataFrame:
    """``pack_id, url, claim_count, supported_count, title, tier, confidence, text`` from verified claims ``(pack_id, url, title, tier, status, claim_pos)``.

    The first claim of the most trusted tier speaks for its source.
    """
    trust = by_tier(K.TIER_MEMORY_CONFIDENCE, F.col("tier"))
    best = F.min_by(F.struct("title", "tier", trust.alias("trust")), F.struct(-trust, "claim_pos")).alias("x")
    g = claims.where("url is not null and url != ''").groupBy("pack_id", "url").agg(F.count("*").alias("claim_count"), F.count_if(F.col("status") == "supported").alias("supported_count"), best)
    confidence = F.least(F.lit(0.95), F.col("x.trust") + F.least(F.col("supported_count"), F.lit(5)) * 0.01)
    text = F.format_string('Source "%s" was useful with %d extracted claims and %d supported claims.', "x.title", "claim_count", "supported_count")
    return g.select("pack_id", "url", "claim_count", "supported_count", "x.title", "x.tier", confidence.alias("confidence"), text.alias("text"))


def failure_memories(failures: DataFrame) -> DataFrame:
    """From ``failures(query_id, url, reason)``: blocked hosts with confidence .9, others .8; with ``query``, each has a text too."""
    blocked = is_blocked_reason(F.col("reason"))
    text = [F.concat(F.lit('Source "'), "url", F.lit('" failed during crawl for query "'), "query", F.lit('" because: '), "reason").alias("text")] if "query" in failures.columns else []
    return failures.where("url is not null and url != ''").select("query_id", *text, F.array("url").alias("source_urls"), F.lit("source").alias("scope"), F.lit("source_failure").alias("kind"), F.when(blocked, 0.9).otherwise(0.8).alias("confidence"), blocked.alias("domain_blocked"))


def durable_fact_memories(claims: DataFrame) -> DataFrame:
    """Supported claims as facts, each (pack, text, url) once."""
    return claims.where("status = 'supported'").select("pack_id", F.col("claim").alias("text"), F.array("url").alias("source_urls"), "entities", "confidence", F.lit("project").alias("scope"), F.lit("durable_fact").alias("kind")).dropDuplicates(["pack_id", "text", "source_urls"])


def recent_memories(memories: DataFrame, limit: int) -> DataFrame:
    """The newest max(5 limit, 25) of each project."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id"))
    return memories.withColumn("n", n).where(F.col("n") <= max(5 * limit, 25)).drop("n")


def memory_score(query: Column, now: Column) -> Column:
    """Points of a memory row for a query: confidence, entities, words, age and kind."""
    q, text = F.lower(query), F.lower("text")
    named = F.exists("entities", lambda e: q.contains(F.lower(e)))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: (F.length(w) > 3) & text.contains(w)))
    months = F.floor((F.unix_timestamp(now) - F.unix_timestamp("created_at")) / (86_400 * 30))
    boost = F.when(F.col("kind") == "durable_fact", 12).when(F.col("kind") == "source_quality", 8).when(F.col("kind") == "source_failure", 6).otherwise(0)
    return F.col("confidence") * 50 + F.when(named, 25).otherwise(0) + words * 3 + F.greatest(F.lit(0), 10 - months) + boost


def memory_search(queries: DataFrame, memories: DataFrame, now: Column, limit: int = 8) -> DataFrame:
    """The best ``limit`` of each project's recent memories for ``queries(query_id, project_id, query)``."""
    j = queries.join(recent_memories(memories, limit), "project_id").withColumn("score", memory_score(F.col("query"), now))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), "id"))).where(F.col("place") <= limit)


def parents(host: Column) -> Column:
    """A host and its parent domains, of two labels or more."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


def grams(text: Column) -> Column:
    """The distinct runs of two characters."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda k: F.substring(text, k, F.lit(2)))))


def fact_entities(memories: DataFrame) -> DataFrame:
    """The entities of durable facts, by their first two characters."""
    of = ["of"] if "of" in memories.columns else []
    facts = memories.where("kind = 'durable_fact'").select(F.col("id").alias("mid"), *of, trusted().alias("c"), F.posexplode("entities").alias("i", "entity"))
    return facts.withColumn("low", F.lower("entity")).where(F.length("low") > 1).withColumn("gram", F.substring("low", 1, 2))


def trusted() -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7))))


def query_facts(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """``query_id, facts``: the durable facts of which ``queries(query_id, low)`` name an entity."""
    facts = fact_entities(memories)
    on = ["gram"] + (["of"] if "of" in memories.columns else [])
    named = queries.select("query_id", F.col("query_id").alias("of"), F.col("low").alias("text")).withColumn("gram", F.explode(grams(F.col("text")))).join(facts, on).where(F.col("text").contains(F.col("low")))
    return named.groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("mid").cast("string"))).alias("facts"))


def memory_deltas(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """``pos, delta, matched``: what memories ``(id, kind, confidence, source_urls, entities)`` add to a candidate's score.

    ``candidates(pos, url)``, with ``query``, ``title``, ``product``, ``domain``, ``topics`` and ``keywords`` where they have them. Where memories have ``of``,
    a memory counts for candidates of the same ``of`` only. Source memories count by url or host. Hosts match either way round, host to parent domain, so both sides are keyed by
    host and parents. Durable facts count by the first of their entities that the query or the candidate names; an entity meets
    texts that hold its first two characters. Equi-joins only.
    """
    of = ["of"] if "of" in memories.columns else []
    m = memories.where(F.col("kind").isin("source_quality", "source_failure")).select(F.col("id").alias("mid"), *of, "kind", trusted().alias("c"), F.explode("source_urls").alias("u"))
    m = m.withColumn("key", F.lower(normalize_url(F.col("u")))).withColumn("at", hostname(F.col("u")))
    c = candidates.select("pos", *of, F.lower(normalize_url(F.col("url"))).alias("key"), hostname(F.col("url")).alias("at"))
    cols = ["pos", "mid", "kind", "c"]
    pairs = c.drop("at").join(m.drop("at"), ["key", *of]).select(cols)
    up = c.withColumn("at", F.explode(parents(F.col("at")))).join(m.where("at != ''"), ["at", *of]).select(cols)
    down = c.where("at != ''").join(m.withColumn("at", F.explode(parents(F.col("at")))), ["at", *of]).select(cols)
    hit = pairs.union(up).union(down).distinct()
    delta = F.when(F.col("kind") == "source_quality", rounded(18 * F.col("c"))).otherwise(-rounded(30 * F.col("c"))).cast("int")
    hit = hit.select("pos", "mid", delta.alias("delta"), F.concat(F.lit("memory:"), "kind", F.lit(":")).alias("said"))
    if "entities" in memories.columns:
        own = [F.col(x) for x in ("query", "title", "product", "domain") if x in candidates.columns] + [F.array_join(x, " ") for x in ("topics", "keywords") if x in candidates.columns]
        text = F.lower(F.concat_ws(" ", *[F.when(x != "", x) for x in own]))
        named = candidates.select("pos", *of, text.alias("text")).withColumn("gram", F.explode(grams(F.col("text")))).join(fact_entities(memories), ["gram", *of]).where(F.col("text").contains(F.col("low")))
        first = named.groupBy("pos", "mid").agg(F.min(F.struct("i", "entity", "c")).alias("x"))
        hit = hit.unionByName(first.select("pos", "mid", rounded(5 * F.col("x.c")).cast("int").alias("delta"), F.concat(F.lit("memory:durable_fact_entity:"), "x.entity", F.lit(":")).alias("said")))
    trail = F.concat("said", F.when(F.col("delta") >= 0, "+").otherwise(""), F.col("delta").cast("string"))
    return hit.groupBy("pos").agg(F.sum("delta").alias("delta"), F.transform(F.array_sort(F.collect_list(F.struct("mid", trail.alias("t")))), lambda x: x.t).alias("matched"))


def blocked_hosts(memories: DataFrame) -> DataFrame:
    """Hosts that a failure memory marked as blocked."""
    return memories.where("kind = 'source_failure' and domain_blocked").select(F.explode("source_urls").alias("u")).select(hostname(F.col("u")).alias("host")).where("host != ''").distinct()


def exclude_blocked(resources: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resources that stay, and those whose host is blocked."""
    r, b = resources.withColumn("host", hostname(F.col("url"))), blocked_hosts(memories)
    return r.join(b, "host", "left_anti"), r.join(b, "host", "left_semi")


def merge_resources(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """One row of each url of a query's ranked batches ``(query_id, url, title, score, tier, matched, pos)``: first title, best score and tier, all trails.

    ``by`` names another column where batches are not a query's own.
    """
    key = normalize_url(F.col("url"))
    g = ranked.withColumn("key", key).groupBy(by, "key").agg(
        F.min_by(F.struct("url", "title"), "pos").alias("first"),
        F.min_by(F.struct("score", "tier"), F.struct(-F.col("score"), "pos")).alias("best"),
        F.array_sort(F.collect_list(F.struct("pos", "matched"))).alias("all"),
        F.min("pos").alias("pos"),
    )
    return g.select(by, "first.*", "best.*", unique(F.flatten(F.transform("all", lambda x: x.matched))).alias("matched"), "pos")
