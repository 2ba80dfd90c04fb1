"""Queries on jobs, model output, lists and whole research runs, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import model_json
from lodestone.operators import crawl, evidence, jobs, memory, research, runs, search
from lodestone.plans.queries import _CLAIMS, _STATUS, _USE, DEALT, DEALT_SQL, rx, verified
from lodestone.plans.research import NOW
from lodestone.sources.tables import scan, source_registry, upsert_vectors

VERSION = jobs.VERSION


def contracts_found(spark: SparkSession, d: str) -> DataFrame:
    """Turns as what a job's runs returned: a response of its text at the top, two levels down, beside another under a preferred key, or too deep."""
    t = scan(spark, d, "conversations").withColumn("c", F.to_json(F.struct(F.lit(VERSION).alias("contractVersion"), F.struct(F.col("text").alias("answerMarkdown"), "role").alias("ui"))))
    other = f'{{"contractVersion":"{VERSION}","ui":{{"answerMarkdown":"other"}}}}'
    wrap = lambda *parts: F.concat(*[F.lit(p) if p != "c" else F.col("c") for p in parts])
    shape = F.pmod(F.length("text") + F.col("turn"), F.lit(4))
    raw = F.when(shape == 0, F.col("c")).when(shape == 1, wrap('{"a":1,"b":{"list":[1],"e":', "c", "}}")).when(shape == 2, wrap(f'{{"x":{other},"final":{{"data":', "c", "}}")).otherwise(wrap('{"a":{"b":{"c":{"d":{"e":', "c", "}}}}}"))
    found = jobs.find_contracts(t.select(F.col("conv_id").alias("job_id"), "turn", raw.alias("raw")))
    return found.select(F.col("job_id").alias("conv_id"), F.md5(F.get_json_object("contract", "$.ui.answerMarkdown")).alias("answer_md5"), F.get_json_object("contract", "$.ui.role").alias("role"))


def labels_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Turns as what a model said of them: labels in JSON, alone or with words around, or no JSON."""
    t = scan(spark, d, "conversations").withColumn("k", F.length("text"))
    allowed = F.array(*map(F.lit, [*model_json.INTENTS, "smalltalk"]))
    tools = F.array(F.element_at(F.array(*map(F.lit, [*model_json.TOOLS, "shell"])), (F.col("k") % 6 + 1).cast("int")), F.lit("shell"), F.lit("search_kb"))
    said = F.to_json(F.struct(F.element_at(allowed, (F.col("k") % 8 + 1).cast("int")).alias("intent"), tools.alias("requiredTools"), F.when(F.col("k") % 3 == 0, "deep").otherwise("quick").alias("answerMode"), (F.col("k") % 2).alias("requiresFreshness"), F.substring("text", 1, F.col("turn").cast("int") % 3).alias("requiresWeb"), F.col("text").alias("reason")))
    raw = F.when(F.col("k") % 5 == 4, F.col("text")).when(F.col("k") % 5 == 3, F.concat(F.lit("Here: "), said, F.lit(" as asked."))).otherwise(said)
    got = t.select("conv_id", "turn", model_json.parse_model_labels(raw).alias("l"))
    return got.select("conv_id", "turn", F.col("l.intent").alias("intent"), F.array_join("l.tools", ",").alias("tools"), F.col("l.mode").alias("mode"), F.col("l.fresh").alias("fresh"), F.col("l.web").alias("web"), F.col("l.github").alias("github"), F.md5("l.reason").alias("reason_md5"))


def strategies_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Documents as outputs of strategies: a table, a direct answer, an answer from a document, a summary, and a table without columns."""
    t = scan(spark, d, "documents").where("text is not null").withColumn("k", F.pmod("doc_id", F.lit(5))).withColumn("ls", F.split("text", "\n"))
    first, n = F.get("ls", F.lit(0)), F.size("ls").cast("string")
    rows = F.array(F.create_map(F.lit("Entity"), "source", F.lit("lang"), "lang"), F.create_map(F.lit("name"), F.lit("lines"), F.lit("first"), first))
    table = F.to_json(F.struct(F.lit("comparison_table").alias("type"), F.col("source").alias("title"), F.array("source").alias("entities"), F.array(F.lit("lang"), F.lit("first")).alias("columns"), rows.alias("rows"), F.when(F.col("doc_id") % 2 == 0, n).alias("recommendation")))
    fact = F.to_json(F.struct(F.lit("factual_answer").alias("type"), first.alias("answer"), F.slice("ls", 2, 3).alias("details")))
    qa = F.to_json(F.struct(F.lit("document_qa").alias("type"), n.alias("answer"), F.array("lang").alias("key_points"), F.array().cast("array<string>").alias("insights"), F.array(F.struct(first.alias("text"), F.col("source").alias("source"))).alias("citations")))
    summary = F.to_json(F.struct(F.lit("research_summary").alias("type"), F.col("text").alias("summary"), F.array("lang", n).alias("key_findings")))
    raw = F.when(F.col("k") == 0, table).when(F.col("k") == 1, fact).when(F.col("k") == 2, qa).when(F.col("k") == 3, summary).otherwise('{"type":"comparison_table","rows":[]}')
    got = t.select("doc_id", model_json.strategy_output(raw).alias("o"))
    return got.select("doc_id", F.col("o.type").alias("type"), F.array_join("o.missing", ",").alias("missing"), F.md5("o.markdown").alias("markdown_md5"))


def job_results(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as jobs: a turn is a report, a run, or the error, so that every origin has rows."""
    t = scan(spark, d, "conversations").withColumn("job_id", F.col("conv_id"))
    shape = F.pmod("conv_id", F.lit(5))
    js = t.groupBy("job_id").agg(F.max_by("text", "turn").alias("error"))
    last = t.groupBy("job_id").agg(F.max_by("text", "turn").alias("text"), F.count("*").alias("n")).withColumn("shape", F.pmod("job_id", F.lit(5)))
    contract = F.to_json(F.struct(F.struct(F.lit(VERSION).alias("contractVersion"), F.struct(F.col("text").alias("answerMarkdown"), F.array(F.struct(F.col("n").alias("id"))).alias("citations")).alias("ui")).alias("result")))
    reports = last.where("shape in (0, 1, 2)").select("job_id", F.lit(0).alias("pos"), F.when(F.col("shape") == 1, F.col("text")).otherwise("Done").alias("content"), F.when(F.col("shape") == 0, contract).otherwise(F.to_json(F.struct(F.array(F.col("n")).alias("sources")))).alias("metadata"))
    printed = t.where(shape == 2).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("job_id", F.to_json(F.struct(F.transform("x", lambda s: F.struct(s.text.alias("stdout"))).alias("steps"))).alias("final_output"))
    finals = last.where("shape = 3").select("job_id", F.to_json(F.struct(F.col("text").alias("final"), F.array(F.col("n")).alias("sources"))).alias("final_output"))
    none = spark.createDataFrame([], "job_id long, pos int, step int, result string, stdout string")
    got = jobs.job_answers(js, reports, printed.unionAll(finals).withColumn("pos", F.lit(0)), none)
    return got.select("job_id", "origin", F.md5("answer").alias("answer_md5"), "sources")


def sources_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Pages as answers that name sources at several depths, and steps that print addresses."""
    p = scan(spark, d, "pages").select("page_id", "url")
    strong, weak = F.concat(F.lit("https://developers.google.com/"), "page_id"), F.concat(F.lit("https://www.youtube.com/"), "page_id")
    none = F.lit(None).cast("string")
    raw = F.to_json(F.struct(F.concat(F.lit("Page "), "page_id").alias("title"), "url", F.struct(F.array(F.struct(strong.alias("sourceUrl"), none.alias("url"), F.col("page_id").cast("double").alias("score")), F.struct(none.alias("sourceUrl"), weak.alias("url"), F.lit(0.0).cast("double").alias("score"))).alias("items")).alias("found")))
    steps = p.select(F.col("page_id").alias("job_id"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("raw"), F.concat(F.lit("read https://docs.example.org/"), "page_id", F.lit(" and '"), "url", F.lit("'")).alias("stdout"))
    got = jobs.extract_sources(p.select(F.col("page_id").alias("job_id"), raw.alias("raw")), steps)
    return got.select(F.col("job_id").alias("page_id"), F.col("place").cast("long").alias("place"), "title", "url", "score")


def reports_written(spark: SparkSession, d: str) -> DataFrame:
    """Last answers of conversations as reports, and as messages where the conversation has more than two turns."""
    t = scan(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.count("*").alias("n"))
    done = t.select(F.col("conv_id").alias("job_id"), F.lit("p").alias("project_id"), F.when(F.col("n") > 2, F.concat(F.lit("conv-"), "conv_id")).alias("conversation_id"), "answer", F.array(F.col("n")).alias("sources"))
    reports, messages = jobs.report_rows(done)
    both = reports.select("job_id", F.lit("report").alias("kind"), "content", "metadata").unionAll(messages.select("job_id", F.lit("message"), "content", "metadata"))
    return both.select("job_id", "kind", F.md5("content").alias("content_md5"), "metadata")


def newest_events(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 of the events, newest first, after the cursor that the first page ends with."""
    e = scan(spark, d, "events").select("event_id", "ts", "event_type")
    last = jobs.newest_page(e, "ts", "event_id", 50).collect()
    after = (last[-1]["ts"], last[-1]["event_id"]) if last else None
    return jobs.newest_page(e, "ts", "event_id", 50, after).select("event_id", "event_type")


def ranked_undated(spark: SparkSession, d: str) -> DataFrame:
    """Pages without dates, or with them, and with years in their titles, as candidates for questions made of benchmark items."""
    q = scan(spark, d, "benchmark").selectExpr("item_id AS query_id", "concat(text, array(' latest sdk', ' overview')[pmod(item_id, 2)]) AS query")
    title = "concat('Notes', array(' of 2019', ' of 2024', ' of 2050', '', ' legacy', ' 2023 or 2018')[pmod(page_id, 6)])"
    c = scan(spark, d, "pages").selectExpr("page_id AS pos", "concat('https://h', page_id, '.org/') AS url", f"{title} AS title", "'sdk' AS product", "CAST(NULL AS STRING) AS domain", f"{DEALT}[pmod(page_id div 6, 6)] AS tier", "array(concat('topic', page_id)) AS topics", "array('zzz') AS keywords", "'p/2048' AS reason", "'search' AS source", "IF(page_id % 5 = 0, timestamp'2024-01-01 00:00:00' - make_dt_interval(CAST(page_id % 1500 AS INT)), NULL) AS published_at")
    r = search.rank_sources(q, c, F.lit(NOW).cast("timestamp"), most=20, least_score=20)
    return r.select("query_id", F.col("place").cast("long").alias("place"), F.col("pos").alias("page_id"), F.col("score").cast("long").alias("score"), F.array_join("matched", " ").alias("matched"))


def gaps_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """What each source's evidence lacks, for a question of a use case by the length of its name."""
    claims = verified(spark, d).withColumn("outcome", F.lit("kept")).drop("status")
    packs = scan(spark, d, "documents").select(F.coalesce("source", F.lit("-")).alias("pack_id")).distinct().withColumn("use_case", F.expr("array('comparison', 'api_facts', 'tutorial')[pmod(length(pack_id), 3)]"))
    packs = packs.unionAll(spark.range(1).selectExpr("'nothing' AS pack_id", "'comparison' AS use_case"))
    g = evidence.evidence_gaps(packs, evidence.evidence_coverage(claims))
    return g.select("pack_id", F.col("kept_claims").cast("long").alias("kept_claims"), F.col("official_sources").cast("long").alias("official_sources"), F.col("supported").cast("long").alias("supported"), F.array_join("missing", "; ").alias("missing"))


def fetches(spark: SparkSession, d: str) -> DataFrame:
    """Documents as what fetches gave: a root for every three, whose pages come in the first mode or, where the language is German, in the second; toxic ones are refused."""
    docs = scan(spark, d, "documents").join(scan(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    root = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.expr("doc_id div 3"))
    mode = F.when(F.col("lang") == "de", "dynamic").otherwise("auto")
    refused = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return docs.where("source is not null").select(root.alias("root_url"), mode.alias("mode"), F.col("doc_id").alias("pos"), F.concat(F.lit("https://x.example.org/"), "doc_id").alias("url"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("text").alias("markdown"), F.when(refused, "url").alias("failure"), F.when(refused, "HTTP 403").alias("reason"))


def crawled_resources(spark: SparkSession, d: str) -> DataFrame:
    """Crawls of fifty documents' roots each: pages by what became of them, retries and blocked hosts."""
    got = fetches(spark, d)
    roots = got.groupBy("root_url").agg(F.min("pos").alias("pos")).select(F.expr("pos div 150").alias("run_id"), "pos", F.col("root_url").alias("url"), F.expr(f"{DEALT}[pmod(pos, 6)]").alias("tier"))
    pages, attempts = crawl.crawl_sources(roots, got, per_source=3, most=20)
    return crawl.source_crawl_trace(pages, attempts)


def research_runs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions, researched from sub-queries to answers over the documents."""
    q = scan(spark, d, "benchmark").selectExpr("item_id AS query_id", "concat('p', pmod(item_id, 5)) AS project_id", "concat(array('compare ', 'how to use ', 'latest ', '')[pmod(item_id, 4)], text) AS query")
    got = fetches(spark, d)
    roots = got.groupBy("root_url").agg(F.min("pos").alias("pos"), F.min("title").alias("title")).withColumn("n", F.expr("pos div 3"))
    n = roots.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + 1
    searches = research.planned_searches(q).select("text").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("n", F.crc32(F.concat("text", F.col("k").cast("string"))) % n)
    none = F.lit(None).cast("string")
    found = searches.join(roots, "n").select(F.col("text").alias("search"), F.col("k").cast("long").alias("pos"), F.col("root_url").alias("url"), "title", none.alias("product"), none.alias("domain"), F.expr(f"{DEALT}[pmod(n, 3)]").alias("tier"), F.array(F.lit("api")).alias("topics"), F.array(F.lit("guide")).alias("keywords"), F.lit("found").alias("reason"), F.lit("search").alias("source"), F.lit(None).cast("timestamp").alias("published_at"))
    memories = roots.where("n % 4 = 0").selectExpr("CAST(n AS STRING) AS id", "concat('p', pmod(n, 5)) AS project_id", "if(n % 8 = 0, 'source_failure', 'source_quality') AS kind", "title AS text", "array(title) AS entities", "array(root_url) AS source_urls", "0.8D AS confidence", "n % 16 = 0 AS domain_blocked", f"timestamp'{NOW}' - make_dt_interval(CAST(n % 300 AS INT)) AS created_at")
    stored = spark.createDataFrame([], "project_id string, content_hash string")
    found = research.research(q, source_registry(spark).where("pos < 2"), found, got, memories, stored, stored, F.lit(NOW).cast("timestamp"))
    out = research.response_contract(found)
    return out.select(F.col("run_id").alias("item_id"), "status", F.col("debug.search.subqueries").alias("subqueries"), F.size("ui.resources").cast("long").alias("resources"), F.col("ui.crawlTrace.accepted").alias("pages"), F.col("ui.evidenceCoverage.kept_claims").cast("long").alias("claims"), F.col("ui.answerMode").alias("mode"), F.col("ui.groundingStatus").alias("grounding"), F.size("ui.citations").cast("long").alias("citations"), F.array_join("ui.warnings", "; ").alias("warnings"))


def jobs_nested(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as jobs: the assistant's turns are reports, the user's are runs, whose lines are steps."""
    t = scan(spark, d, "conversations").withColumn("job_id", F.col("conv_id")).withColumn("run", F.concat_ws("/", "conv_id", "turn"))
    asked = t.where("role = 'user'")
    steps = asked.select("run", F.posexplode(F.split("text", "\n")).alias("step", "stdout"))
    got = runs.nested_job_views(t.select("job_id").distinct(), t.where("role != 'user'").select("job_id", F.col("turn").alias("pos"), F.col("text").alias("content")), asked.select("job_id", "run", F.col("turn").alias("pos"), F.col("role").alias("status")), steps, 2)
    printed = F.transform("runs", lambda r: F.concat(r.run, F.lit("="), F.array_join(F.transform(r.steps, lambda s: s.stdout), "|")))
    return got.select("job_id", F.md5(F.array_join("reports", "#")).alias("reports_md5"), F.size("runs").cast("long").alias("runs"), F.md5(F.array_join(printed, "#")).alias("runs_md5"))


def vectors_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a store, every third in a newer version and every fifth in an older one: which version stays, by label."""
    v = scan(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("payload"), F.lit(1).alias("version"))
    newer, older = v.where("id % 3 = 0").withColumn("version", F.lit(2)), v.where("id % 5 = 0").withColumn("version", F.lit(0)).withColumn("payload", F.lit(-1))
    got = upsert_vectors(v, newer.unionAll(older))
    return got.groupBy("payload", "version").agg(F.count("*").alias("points"), F.sum("id").alias("ids"))


def failures_remembered(spark: SparkSession, d: str) -> DataFrame:
    """What a run remembers of documents that couldn't be fetched: toxic ones are refused, short ones time out."""
    t = scan(spark, d, "documents").join(scan(spark, d, "labels"), "doc_id").where("toxic = 1 or n_chars < 200")
    reason = F.when(F.col("toxic") == 1, "HTTP 403 Forbidden").otherwise("timeout")
    got = memory.failure_memories(t.select(F.col("source").alias("query_id"), F.concat(F.lit("https://x.org/"), "doc_id").alias("url"), F.coalesce("lang", F.lit("?")).alias("query"), reason.alias("reason")))
    return got.groupBy("confidence", "domain_blocked", "kind", "scope").agg(F.count("*").alias("memories"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "|")).alias("texts_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (contracts_found, labels_parsed, strategies_rendered, job_results, sources_extracted, reports_written, newest_events, ranked_undated, gaps_of_sources, crawled_resources, research_runs, jobs_nested, vectors_upserted, failures_remembered)
}

_POINTS = ", ".join(f"('{use}', '{t}', {n})" for t, ns in K.TIER_USE_CASE.items() for use, n in zip(K.USE_CASES, ns))

ORACLES: dict[str, str] = {
    "jobs_nested": """
WITH t AS (SELECT *, conv_id || '/' || turn AS run FROM conversations),
r AS (SELECT conv_id, string_agg(text, '#' ORDER BY turn DESC) AS x FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE role <> 'user') WHERE n <= 2 GROUP BY conv_id),
u AS (SELECT conv_id, count(*) AS n, string_agg(run || '=' || replace(text, chr(10), '|'), '#' ORDER BY turn DESC) AS x FROM t WHERE role = 'user' GROUP BY conv_id)
SELECT j.conv_id AS job_id, md5(coalesce(r.x, '')) AS reports_md5, coalesce(u.n, 0) AS runs, md5(coalesce(u.x, '')) AS runs_md5 FROM (SELECT DISTINCT conv_id FROM t) j LEFT JOIN r USING (conv_id) LEFT JOIN u USING (conv_id)""",
    "vectors_upserted": "SELECT label AS payload, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, count(*) AS points, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1, 2",
    "failures_remembered": """
WITH t AS (SELECT *, toxic = 1 AS b, 'Source "https://x.org/' || doc_id || '" failed during crawl for query "' || coalesce(lang, '?') || '" because: ' || CASE WHEN toxic = 1 THEN 'HTTP 403 Forbidden' ELSE 'timeout' END AS x
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR n_chars < 200)
SELECT CASE WHEN b THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, b AS domain_blocked, 'source_failure' AS kind, 'source' AS scope, count(*) AS memories, md5(string_agg(x, '|' ORDER BY x)) AS texts_md5 FROM t GROUP BY b""",
    "contracts_found": """
WITH t AS (SELECT *, (length(text) + turn) % 4 AS shape FROM conversations WHERE (length(text) + turn) % 4 <> 3)
SELECT conv_id, md5(arg_min(text, turn)) AS answer_md5, arg_min(role, turn) AS role FROM t GROUP BY conv_id""",
    "labels_parsed": """
WITH t AS (SELECT *, length(text) AS k FROM conversations),
l AS (
  SELECT *, k % 5 = 4 AS none, ['github_repo', 'news', 'web_research', 'kb', 'code', 'document', 'general', 'general'][k % 8 + 1] AS i,
    list_distinct(list_filter([['search_kb', 'web_research', 'crawl_url', 'query_graph', 'github_repo', 'shell'][k % 6 + 1], 'search_kb'], lambda x: x <> 'shell')) AS ts FROM t)
SELECT conv_id, turn, CASE WHEN none THEN 'general' ELSE i END AS intent,
  CASE WHEN none THEN '' WHEN k % 6 IN (0, 5) THEN 'search_kb' ELSE ['', 'web_research', 'crawl_url', 'query_graph', 'github_repo'][k % 6 + 1] || ',search_kb' END AS tools,
  CASE WHEN NOT none AND k % 3 = 0 THEN 'deep' ELSE 'fast' END AS mode, NOT none AND k % 2 = 1 AS fresh,
  NOT none AND (turn % 3 > 0 AND text <> '' OR k % 6 = 1) AS web, NOT none AND k % 6 = 4 AS github, CASE WHEN none THEN NULL ELSE md5(text) END AS reason_md5 FROM l""",
    "strategies_rendered": """
WITH t AS (SELECT *, doc_id % 5 AS k, string_split(text, chr(10)) AS ls, coalesce(nullif(string_split(text, chr(10))[1], ''), '—') AS cell, string_split(text, chr(10))[1] AS first FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN k IN (0, 4) THEN 'comparison_table' WHEN k = 1 THEN 'factual_answer' WHEN k = 2 THEN 'document_qa' ELSE 'research_summary' END AS type,
  CASE WHEN k = 4 THEN 'entities,columns' ELSE '' END AS missing,
  CASE WHEN k <> 4 THEN md5(CASE
    WHEN k = 0 THEN '## ' || coalesce(source, 'undefined') || chr(10) || chr(10) || '| Entity | lang | first |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || coalesce(nullif(source, ''), '—') || ' | ' || coalesce(nullif(lang, ''), '—') || ' | — |' || chr(10) || '| lines | — | ' || cell || ' |' || chr(10)
      || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '### Recommendation' || chr(10) || chr(10) || len(ls) || chr(10) ELSE '' END
    WHEN k = 1 THEN first || chr(10) || CASE WHEN len(ls) > 1 THEN chr(10) || array_to_string(list_transform(ls[2:4], lambda x: '- ' || x), chr(10)) || chr(10) ELSE '' END
    WHEN k = 2 THEN len(ls) || chr(10) || chr(10) || '### Key Points' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10) || '### Citations' || chr(10) || chr(10) || '> ' || first || chr(10) || '> — ' || source || chr(10)
    ELSE text || chr(10) || chr(10) || '### Key Findings' || chr(10) || chr(10) || '- ' || lang || chr(10) || '- ' || len(ls) || chr(10) END) END AS markdown_md5 FROM t""",
    "job_results": """
WITH t AS (SELECT conv_id AS job_id, arg_max(text, turn) AS text, count(*) AS n, conv_id % 5 AS s FROM conversations GROUP BY conv_id)
SELECT job_id, ['contract', 'report', 'stdout', 'final', 'error'][s + 1] AS origin, md5(CASE WHEN s IN (0, 2) THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END) AS answer_md5,
  CASE s WHEN 0 THEN '[{"id":' || n || '}]' WHEN 4 THEN '[]' ELSE '[' || n || ']' END AS sources FROM t""",
    "sources_extracted": """
WITH s AS (
  SELECT page_id, 1 AS r, 1 AS o, NULL AS title, 'https://developers.google.com/' || page_id AS url, page_id::DOUBLE AS score FROM pages
  UNION ALL SELECT page_id, CASE WHEN regexp_matches(url, '://') THEN 2 ELSE 3 END, 0, 'Page ' || page_id, url, NULL FROM pages
  UNION ALL SELECT page_id, 2, 2, NULL, 'https://docs.example.org/' || page_id, NULL FROM pages
  UNION ALL SELECT page_id, 2, 3, NULL, u, NULL FROM (SELECT page_id, regexp_extract('''' || url || '''', 'https?://[^\\s'',}]+') AS u FROM pages) WHERE u <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY r, o) AS place, title, url, score FROM s""",
    "reports_written": """
WITH t AS (SELECT conv_id AS job_id, arg_max(text, turn) AS answer, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT job_id, 'report' AS kind, md5(answer) AS content_md5, '{"sources":[' || n || ']}' AS metadata FROM t
UNION ALL SELECT job_id, 'message', md5(answer), '{"sources":[' || n || ']}' FROM t WHERE n > 2""",
    "newest_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50",
    "ranked_undated": rf"""
WITH q AS (SELECT item_id AS query_id, text || [' latest sdk', ' overview'][item_id % 2 + 1] AS q FROM benchmark),
u AS (SELECT query_id, lower(q) AS low, {_USE} AS use_case, regexp_matches(q, '{rx(K.FRESH_QUERY)}') AS fresh FROM q),
c AS (SELECT page_id, {DEALT_SQL}[page_id // 6 % 6 + 1] AS tier, page_id % 6 AS t, CASE WHEN page_id % 5 = 0 THEN (152 + page_id % 1500) / 365 END AS age, [2019, 2024, NULL, NULL, NULL, 2023][page_id % 6 + 1] AS y FROM pages),
m(use_case, tier, points) AS (VALUES {_POINTS}),
f AS (
  SELECT query_id, page_id, points, contains(low, 'topic' || page_id) AS topic, list_contains(regexp_split_to_array(regexp_replace(low, '[^a-z0-9.+#\s-]', ' ', 'g'), '\s+'), 'sdk') AS sdk, t = 4 AS old,
    CASE WHEN age <= 0.75::DOUBLE THEN CASE WHEN fresh THEN 'published_recent:+18' ELSE 'published_recent:+6' END WHEN age <= 2 THEN CASE WHEN fresh THEN 'published_moderate:+10' ELSE 'published_moderate:+3' END
      WHEN age IS NOT NULL THEN CASE WHEN NOT fresh THEN NULL WHEN tier = 'official_docs' THEN 'published_old:-8' ELSE 'published_old:-18' END
      WHEN y >= 2023 THEN 'year_recent:' || y || CASE WHEN fresh THEN ':+12' ELSE ':+4' END
      WHEN y IS NOT NULL THEN CASE WHEN NOT fresh THEN NULL WHEN tier = 'official_docs' THEN 'year_old:' || y || ':-4' ELSE 'year_old:' || y || ':-10' END
      WHEN fresh AND tier NOT IN ('official_docs', 'trusted_docs') THEN 'unknown_date:-4' END AS said
  FROM u, c JOIN m USING (tier) WHERE m.use_case = u.use_case),
s AS (SELECT *, points + 15 * topic::INT + 8 * sdk::INT - 24 * old::INT + coalesce(regexp_extract(said, '[+-]\d+$')::INT, 0) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS place FROM s WHERE score >= 20)
SELECT query_id, place, page_id, score::BIGINT AS score,
  array_to_string(list_filter([CASE WHEN topic THEN 'topic:topic' || page_id END, CASE WHEN sdk THEN 'product-token:sdk' END, CASE WHEN old THEN 'freshness:deprecated:-24' END, 'freshness:' || said], lambda x: x IS NOT NULL), ' ') AS matched
FROM r WHERE place <= 20""",
    "gaps_of_sources": _CLAIMS + f""", sc AS (SELECT *, {_STATUS} AS status FROM claims),
pk AS (SELECT DISTINCT coalesce(source, '-') AS pack_id, ['comparison', 'api_facts', 'tutorial'][length(coalesce(source, '-')) % 3 + 1] AS use_case FROM documents UNION ALL SELECT 'nothing', 'comparison'),
g AS (SELECT pk.pack_id, any_value(use_case) AS use_case, count(sc.c) AS kept, count(DISTINCT CASE WHEN tier IN ('official_docs', 'trusted_docs') THEN url END) AS official, count(*) FILTER (status = 'supported') AS supported FROM pk LEFT JOIN sc ON sc.pack_id = pk.pack_id GROUP BY pk.pack_id)
SELECT pack_id, kept AS kept_claims, official AS official_sources, supported, array_to_string(list_filter([CASE WHEN kept = 0 THEN 'No claim-level evidence was collected.' END, CASE WHEN use_case IN ('api_facts', 'comparison') AND official = 0 THEN 'No official/trusted sources were collected.' END,
  CASE WHEN kept > 0 AND supported = 0 THEN 'Evidence was collected, but no claim passed citation verification.' END], lambda x: x IS NOT NULL), '; ') AS missing FROM g""",
}
