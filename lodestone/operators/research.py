"""Research from question to answer, for many questions at once: one dataflow over the operators of the other modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions.scores import page_features, page_quality, verify_claim
from lodestone.functions.text import preview
from lodestone.operators import answers, crawl, evidence, logs, memory, search
from lodestone.operators.runs import research_status
from lodestone.sources.tables import ingest


def planned_searches(queries: DataFrame) -> DataFrame:
    """``query_id, turn, sub, priority, text``: the sub-queries of ``queries(query_id, query)`` and what each searches the web for."""
    subs = queries.select("query_id", F.posexplode(Q.plan_subqueries(F.col("query"))).alias("turn", "x")).select("query_id", "turn", F.col("x.query").alias("sub"), F.col("x.priority").alias("priority"))
    return subs.withColumn("text", F.explode(Q.fallback_queries(F.col("sub"))))


def planned_sources(queries: DataFrame, memories: DataFrame, registry: DataFrame, searched: DataFrame, now: Column, max_sources: int | None = None) -> DataFrame:
    """``run_id, pos, url, title, tier, score, matched``: the sources that each query's sub-queries choose, merged, the best first.

    ``memories`` are those retrieved for each query (``query_id``, ``of`` is made here); a sub-query may take max(5, its share of the run's sources).
    """
    use = Q.infer_use_case(Q.normalize_query(F.col("query")))
    own = F.lit(max_sources) if max_sources else F.when(Q.needs_official_docs(use), 8).otherwise(6)
    asked = planned_searches(queries).withColumn("id", F.struct("query_id", "turn"))
    subs = asked.select("query_id", "turn", "sub", "id").distinct()
    n = F.count("*").over(Window.partitionBy("query_id"))
    subs = subs.join(queries.select("query_id", own.alias("max_sources")), "query_id").withColumn("most", F.greatest(F.lit(5), F.ceil(F.col("max_sources") / n)).cast("int"))
    hints = memories.where(F.col("kind").isin("source_quality", "source_failure", "durable_fact")).join(subs.select("query_id", F.col("id").alias("of")), "query_id").drop("query_id")
    # what was found for a text is a candidate of each sub-query that searched for it, after the registry's
    columns = ["url", "title", "product", "domain", "tier", "topics", "keywords", "reason", "source", "published_at"]
    last = registry.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 1
    order = F.row_number().over(Window.partitionBy("id").orderBy("text", "pos")) + F.lit(last)
    found = asked.select("id", "text").join(searched.withColumnRenamed("search", "text"), "text").select(F.col("id").alias("query_id"), *columns, order.cast("long").alias("pos"))
    asks = subs.select(F.col("id").alias("query_id"), F.col("sub").alias("query"), "most")
    plan = search.plan_resources(asks, registry, found, now, max(5, -(-(max_sources or 8) // 2)), hints)
    plan = plan.join(subs.select(F.col("id").alias("query_id"), "sub"), "query_id").withColumn("matched", F.array_append("matched", F.concat(F.lit("subquery:"), "sub")))
    merged = memory.merge_resources(plan.select("query_id.query_id", "url", "title", "score", "tier", "matched", F.struct("query_id.turn", "place").alias("pos")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    merged = merged.withColumn("place", place).join(queries.select("query_id", own.alias("max_sources")), "query_id").where("place <= max_sources")
    return merged.select(F.col("query_id").alias("run_id"), F.col("place").cast("long").alias("pos"), "url", "title", "tier", "score", "matched")


def research(
    queries: DataFrame, registry: DataFrame, searched: DataFrame, fetched: DataFrame, memories: DataFrame, stored: DataFrame, chunks: DataFrame, now: Column,
    max_sources: int | None = None, pages_per_source: int = 3, total_pages: int = 20, most_claims: int = 10,
) -> dict[str, DataFrame]:
    """All that research of ``queries(query_id, project_id, query)`` gives, by name; each table has ``run_id``, the query's id.

    ``registry`` and ``searched(search, ...)`` are candidates, the latter by the text searched for; ``fetched`` what fetches gave (``crawl_sources``, with
    ``title``); ``memories`` all stored ones; ``stored`` and ``chunks`` what is ingested already.

    resources: sources chosen, with trails. pages: accepted pages. attempts, trace: of the crawl. documents, chunks: of the ingest. claims: with outcome and status.
    packs: coverage and gaps. answers: with their audit. drafts: memories to append, each once. failures: sources and addresses that
    failed. runs: a row for each query with status, counts and warnings.
    """
    queries = evidence.checkpointed(queries)
    found = evidence.checkpointed(memory.memory_search(queries, memories, now))
    kinds = ["source_quality", "source_failure", "durable_fact"]
    hints = found.where(F.col("kind").isin(kinds))
    resources = evidence.checkpointed(planned_sources(queries, hints.select("query_id", "id", "kind", "confidence", "source_urls", "entities"), registry, searched, now, max_sources))
    barred = hints.select(F.col("query_id").alias("run_id"), "kind", "domain_blocked", "source_urls")
    outcomes, attempts = crawl.crawl_sources(resources, fetched, barred, pages_per_source, total_pages)
    outcomes, attempts = evidence.checkpointed(outcomes), evidence.checkpointed(attempts)

    first = crawl.mode_for_tier(F.col("tier"))
    at = resources.select("run_id", F.col("pos").alias("resource"), F.col("url").alias("root_url"), F.col("title").alias("source_title"), "tier", "score")
    rows = outcomes.join(at, ["run_id", "resource"]).withColumn("mode", F.when(F.col("attempt") == 1, first).otherwise(crawl.fallback_mode(first)))
    rows = rows.join(fetched.where("failure is null").select("root_url", "mode", F.col("pos").alias("page"), "url", "title", "markdown"), ["root_url", "mode", "page"])
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "source_title"))
    pages = evidence.checkpointed(rows.where("status = 'accepted'").select("run_id", "resource", "attempt", "page", "url", "title", "markdown", "tier", "score"))

    place = F.struct("run_id", "resource", "attempt", "page")
    documents, new_chunks = ingest(stored, chunks, pages.join(queries.select(F.col("query_id").alias("run_id"), "project_id"), "run_id").select(place.alias("pos"), "project_id", "title", "url", "markdown"))
    claims = evidence.near_dedupe_claims(evidence.extract_evidence(pages.select(F.col("run_id").alias("pack_id"), "url", "title", "markdown", "tier", F.struct("resource", "attempt", "page").alias("pos"))))
    claims = evidence.checkpointed(claims.withColumn("status", verify_claim(F.col("claim"), F.col("quote"), F.col("url"), F.col("tier"), F.col("confidence"))))
    asks = queries.select(F.col("query_id").alias("pack_id"), "query", Q.infer_use_case(F.col("query")).alias("use_case"))
    packs = evidence.evidence_gaps(asks, evidence.evidence_coverage(claims.drop("status")))
    kept = claims.where("outcome = 'kept'")
    written = logs.grounding_audit(answers.synthesize_answers(packs.select("pack_id", "query", "use_case", "missing"), kept, most_claims).withColumnRenamed("status", "answer_status"))
    written = evidence.checkpointed(written.withColumnRenamed("status", "grounding").withColumnRenamed("answer_status", "status"))

    # what failed: blocked sources, errors, addresses; and, for memories, pages that were skipped
    tried = attempts.join(at, ["run_id", "resource"])
    blocked = tried.where("blocked").select("run_id", F.col("source_title").alias("title"), F.col("root_url").alias("url"), F.lit("Domain blocked (known blocked from prior failures)").alias("reason"))
    errors = tried.where("error is not null and not retried").select("run_id", F.col("source_title").alias("title"), F.col("root_url").alias("url"), F.col("error").alias("reason"))
    ran = tried.where("not blocked and error is null").withColumn("mode", F.when(F.col("attempt") == 1, first).otherwise(crawl.fallback_mode(first))).select("run_id", "root_url", "mode", "source_title")
    lost = ran.join(fetched.where("failure = 'url'").select("root_url", "mode", "url", "reason"), ["root_url", "mode"]).select("run_id", F.col("source_title").alias("title"), "url", "reason")
    failures = evidence.checkpointed(blocked.unionAll(errors).unionAll(lost))
    quality = page_quality(F.col("markdown"), page_features(F.col("markdown")))
    why = F.when(F.col("status") == "rejected", F.concat(F.lit("Quality check failed (score="), quality["score"].cast("string"), F.lit("): "), F.array_join(quality["flags"], ", "))).otherwise(F.concat(F.lit("Duplicate: "), "status"))
    skipped = rows.where("status in ('rejected', 'duplicate_url', 'duplicate_content')").select("run_id", "title", "url", F.concat(F.lit("Skipped by quality gate: "), why).alias("reason"))

    drafts = run_drafts(queries, kept, failures.unionAll(skipped))
    count = lambda df, name, by="run_id", what=F.count("*"): df.groupBy(F.col(by).alias("run_id")).agg(what.alias(name))
    trace = crawl.source_crawl_trace(outcomes, attempts)
    memory_counts = found.groupBy(F.col("query_id").alias("run_id")).agg(F.count("*").alias("memories_retrieved"), F.count_if(F.col("kind").isin(kinds)).alias("memories_used"))
    drafted = drafts.groupBy("run_id").agg(F.count("*").alias("memories_written"), *[F.count_if(F.col("kind") == k).alias(f"{k}_memories") for k in kinds])
    runs = queries.select(F.col("query_id").alias("run_id"), "query", Q.normalize_query(F.col("query")).alias("normalized_query"), F.size(Q.plan_subqueries(F.col("query"))).alias("subqueries"))
    for part in (count(resources, "resources"), count(documents.select("pos.run_id"), "documents"), count(failures, "failed"), count(skipped, "skipped"), memory_counts, drafted, trace.drop("failures")):
        runs = runs.join(part, "run_id", "left")
    numbers = [f.name for f in runs.schema.fields if f.name not in ("run_id", "query", "normalized_query")]
    runs = runs.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers})
    runs = runs.join(packs.select(F.col("pack_id").alias("run_id"), "raw_claims", "kept_claims", "quality_rejected", "duplicate_rejected", "supported", "weak", "unsupported", "missing"), "run_id")
    runs = runs.join(written.select(F.col("pack_id").alias("run_id"), F.col("status").alias("answer"), "mode", "confidence", F.size("citations").alias("citations"), "grounding", F.size("issues").alias("issues")), "run_id")
    runs = runs.withColumn("status", research_status(F.col("documents"), F.col("failed"), F.col("answer") == "answered")).withColumn("warnings", response_warnings())
    return {"resources": resources, "pages": pages, "attempts": attempts, "trace": trace, "documents": documents, "chunks": new_chunks, "claims": claims, "packs": packs, "answers": written, "drafts": drafts, "failures": failures, "runs": runs}


def run_drafts(queries: DataFrame, kept: DataFrame, failures: DataFrame) -> DataFrame:
    """``run_id, project_id, kind, scope, text, source_urls, confidence``: what runs remember of sources, failures and facts; each once."""
    cols = ["run_id", "kind", "scope", "text", "source_urls", "confidence"]
    quality = memory.source_quality_memories(kept).select(F.col("pack_id").alias("run_id"), F.lit("source_quality").alias("kind"), F.lit("source").alias("scope"), "text", F.array("url").alias("source_urls"), "confidence")
    failed = memory.failure_memories(failures.join(queries.select(F.col("query_id").alias("run_id"), "query"), "run_id").withColumn("query_id", F.col("run_id"))).withColumn("run_id", F.col("query_id")).select(*cols)
    facts = memory.durable_fact_memories(kept).withColumn("run_id", F.col("pack_id")).select(*cols)
    all_ = quality.select(F.lit(0).alias("turn"), *cols).unionByName(failed.select(F.lit(1).alias("turn"), *cols)).unionByName(facts.select(F.lit(2).alias("turn"), *cols))
    all_ = all_.join(queries.select(F.col("query_id").alias("run_id"), "project_id"), "run_id").withColumn("pos", F.struct("run_id", "turn", "text")).withColumn("user_id", F.col("run_id"))
    return logs.dedupe_memory_drafts(all_).select("run_id", "project_id", "kind", "scope", "text", "source_urls", "confidence")


def response_warnings() -> Column:
    """What a response warns of, from a run's counts."""
    said = lambda n, text: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))
    return F.array_compact(
        F.array(
            said("failed", " source(s) failed to crawl"),
            said("skipped", " page(s) skipped by quality gate"),
            F.when(F.col("answer") != "answered", F.concat(F.lit("Answer status: "), "answer")),
            said("blocked_hosts", " domain(s) blocked during crawl"),
            F.when(F.col("kept_claims") == 0, F.lit("No evidence claims passed quality filtering")),
        )
    )


def response_contract(found: dict[str, DataFrame]) -> DataFrame:
    """``run_id, contractVersion, status, query, ui, debug`` of ``research``'s tables: what a client shows, and how it came about."""
    r, a = found["runs"], found["answers"]
    sources = F.array_sort(F.collect_list(F.struct("pos", "title", "url", "tier", "score")))
    planned = found["resources"].groupBy("run_id").agg(sources.alias("planned"))
    answer = a.select(F.col("pack_id").alias("run_id"), "markdown", F.col("citations").alias("cited"), F.col("issues").alias("said"))
    j = r.join(planned, "run_id", "left").join(answer, "run_id")
    coverage = F.struct("raw_claims", "kept_claims", "quality_rejected", "duplicate_rejected", "supported", "missing")
    trace = F.struct("crawled", "accepted", "rejected_by_quality", "duplicate_url", "duplicate_content", "sources_with_content", "sources_skipped", "retries", "blocked_hosts")
    shown = F.transform(F.coalesce("planned", F.array().cast(planned.schema["planned"].dataType)), lambda x: F.struct(x.title.alias("title"), x.url.alias("url"), x.tier.alias("tier"), x.score.alias("score")))
    ui = F.struct(
        F.col("markdown").alias("answerMarkdown"), F.col("cited").alias("citations"), "confidence", F.col("mode").alias("answerMode"), F.col("grounding").alias("groundingStatus"), F.col("said").alias("groundingIssues"),
        coverage.alias("evidenceCoverage"), trace.alias("crawlTrace"), shown.alias("resources"), "warnings",
    )
    debug = F.struct(
        F.struct("query", F.col("normalized_query").alias("normalizedQuery"), "subqueries").alias("search"), trace.alias("crawl"), coverage.alias("evidence"),
        F.struct(F.col("answer").alias("status"), "mode", "citations").alias("answer"), F.struct("memories_retrieved", "memories_used", "memories_written").alias("memories"),
    )
    return j.select("run_id", F.lit("research-response-v1").alias("contractVersion"), "status", "query", ui.alias("ui"), debug.alias("debug"))


def simple_research(queries: DataFrame, registry: DataFrame, searched: DataFrame, scraped: DataFrame, stored: DataFrame, chunks: DataFrame, now: Column, max_sources: int = 10) -> dict[str, DataFrame]:
    """Research without sub-queries or crawls: one page of each planned source; ``resources``, ``documents``, ``failures``, ``claims`` and ``packs``.

    ``searched(query_id, ...)`` are each query's candidates, ``scraped(source_url, url, title, markdown)`` the pages. A page of under 250 characters fails; one without
    claims gives a claim that it may matter.
    """
    plan = evidence.checkpointed(search.plan_resources(queries.select("query_id", "query"), registry, searched, now, max_sources))
    got = plan.join(scraped.select(F.col("source_url").alias("url"), F.col("url").alias("page_url"), F.col("title").alias("page_title"), "markdown"), "url", "left")
    good = F.coalesce(F.length(F.regexp_replace("markdown", r"^\s+|\s+\z", "")) >= 250, F.lit(False))
    failures = got.where(~good).select("query_id", "title", "url", F.when(F.col("page_url").isNull(), "Page could not be scraped.").otherwise("Scraped markdown was too short.").alias("reason"))
    pages = evidence.checkpointed(got.where(good).select(F.col("query_id").alias("pack_id"), F.col("page_url").alias("url"), F.coalesce(F.nullif("page_title", F.lit("")), "title").alias("title"), "markdown", "tier", F.col("place").alias("pos")))
    documents, new_chunks = ingest(stored, chunks, pages.join(queries.select(F.col("query_id").alias("pack_id"), "project_id"), "pack_id").select(F.struct("pack_id", "pos").alias("pos"), "project_id", "title", "url", "markdown"))
    claims = evidence.checkpointed(evidence.extract_evidence(pages))
    fallback = evidence.fallback_evidence(pages, claims).withColumn("claim", F.concat(F.lit('Source "'), "title", F.lit('" contains potentially relevant information for the query.')))
    more = {"claim_pos": F.lit(None).cast(claims.schema["claim_pos"].dataType), "section": F.lit(None).cast("string"), "entities": F.array().cast("array<string>")}
    both = claims.unionByName(fallback.withColumns(more).select(*claims.columns))
    packs = evidence.evidence_gaps(queries.select(F.col("query_id").alias("pack_id"), "query", Q.infer_use_case(F.col("query")).alias("use_case")), evidence.evidence_coverage(evidence.near_dedupe_claims(both)))
    return {"resources": plan, "documents": documents, "chunks": new_chunks, "failures": failures, "claims": both, "packs": packs}


def crawl_and_ingest(pages: DataFrame, roots: DataFrame, stored: DataFrame, chunks: DataFrame, max_depth: int = 1, max_pages: int = 25) -> tuple[DataFrame, DataFrame]:
    """Crawl from ``roots(root_id, url, project_id)`` over ``pages(url, html, title, markdown)`` and ingest what is found: a row for each visit, and the chunks.

    A visit has ``root_id, place, url, found, status, chunks, preview``: new, backfilled or deduped as the ingest says, the number of its chunks (of those made now)
    and the first 500 characters; pages that aren't stored, or are empty, have no status.
    """
    own = pages.withColumn("key", crawl.page_key(F.col("url"))).groupBy("key").agg(F.min(F.struct("url", "title", "markdown")).alias("p"))
    visits = evidence.checkpointed(crawl.bounded_crawl(pages.select("url", "html"), roots.select("root_id", "url"), max_depth, max_pages))
    got = visits.join(own, "key", "left").join(roots.select("root_id", "project_id"), "root_id").select("root_id", "place", "found", "key", "project_id", "p.title", "p.markdown").withColumn("pos", F.struct("root_id", "place"))
    incoming = got.where("found and trim(markdown) != ''").select("pos", "project_id", "title", F.col("key").alias("url"), "markdown")
    told, made = ingest(stored, chunks, incoming)
    made = evidence.checkpointed(made)
    n = made.groupBy("pos").agg(F.count("*").alias("chunks"))
    out = got.join(told.select("pos", "status"), "pos", "left").join(n, "pos", "left")
    return out.select("root_id", "place", F.col("key").alias("url"), "found", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), preview(F.col("markdown"), 500).alias("preview")), made
