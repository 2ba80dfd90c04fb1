import re

from pyspark.sql import functions as F

from lodestone.operators import answers, evidence, research, search

NOW = "2024-06-01 00:00:00"
CANDIDATE = "pos long, url string, title string, product string, domain string, tier string, topics array<string>, keywords array<string>, reason string, source string, published_at timestamp"
PAGE = "# %s\n## OAuth\n" + "The %s API supports OAuth 2.0 access tokens and requires scopes for every request that a client sends.\n"
EXAMPLE = PAGE % ("Authentication", "Example") + "An Example API token expires after one hour and a client can refresh it with the token endpoint of the Example API.\n"
SAMPLE = PAGE % ("Keys", "Sample") + "Sample API endpoints limit clients to 100 requests in a minute and return an error with status 429 beyond that.\nSample Console creates an API key for each project, which the header of every request must carry.\n"


def tables(spark, queries):
    registry = spark.createDataFrame([(0, "https://docs.example.com/auth", "Example API", "Example API", "auth", "official_docs", ["authentication"], ["example api"], "r", "registry", None), (1, "https://docs.sample.com/auth", "Sample API", "Sample API", "auth", "official_docs", ["authentication"], ["sample api"], "r", "registry", None)], CANDIDATE)
    q = spark.createDataFrame(queries, "query_id string, project_id string, query string")
    texts = [r.text for r in research.planned_searches(q).select("text").distinct().collect() if r.text.startswith("plain")]
    searched = spark.createDataFrame([(t, k, f"https://s{k}.org/x", f"Found {k}", None, None, "reference_examples", ["zzz"], ["zzz"], "r", "search", None) for t in texts for k in range(2)], "search string, " + CANDIDATE)
    fetched = [("https://docs.example.com/auth", "auto", 0, "https://docs.example.com/auth", "Auth guide", EXAMPLE, None, None), ("https://docs.sample.com/auth", "auto", 0, "https://docs.sample.com/auth", "Keys", SAMPLE, None, None), ("https://s0.org/x", "auto", 0, "https://s0.org/x", "", "short", None, None), ("https://s0.org/x", "dynamic", 0, "https://s0.org/x", None, None, "url", "HTTP 403")]
    fetched = spark.createDataFrame(fetched, "root_url string, mode string, pos long, url string, title string, markdown string, failure string, reason string")
    memories = spark.createDataFrame([("m1", "p", "source_quality", "Example API docs were useful", ["Example API"], ["https://docs.example.com/auth"], 0.9, False), ("m2", "p", "note", "a note", [], [], 0.5, False), ("m3", "p2", "source_failure", "blocked", [], ["https://docs.sample.com/auth"], 0.9, True), ("m4", "p3", "source_failure", "blocked", [], ["https://docs.sample.com/auth", "https://www.docs.example.com/"], 0.9, True)], "id string, project_id string, kind string, text string, entities array<string>, source_urls array<string>, confidence double, domain_blocked boolean").withColumn("created_at", F.lit("2024-05-01").cast("timestamp"))
    none = spark.createDataFrame([], "project_id string, content_hash string")
    return q, registry, searched, fetched, memories, none, none, F.lit(NOW).cast("timestamp")


def test_research_from_question_to_answer(spark):
    found = research.research(*tables(spark, [("a", "p", "Compare Example API and Sample API authentication"), ("b", "p2", "Sample API authentication error"), ("c", "p3", "plain thing")]), max_sources=4, pages_per_source=2, total_pages=4)
    runs = {r.run_id: r for r in found["runs"].collect()}
    a = runs["a"]
    assert (a.status, a.mode, a.answer, a.resources, a.documents, a.citations) == ("ok", "comparison", "answered", 2, 2, 2)
    assert a.kept_claims == a.supported > 1 and a.memories_retrieved == 2 and a.memories_used == 1 and a.source_quality_memories == 2 and a.durable_fact_memories == a.supported and a.memories_written == 2 + a.supported
    assert a.warnings == [] and a.grounding == "pass" and a.missing == []
    resources = found["resources"].where("run_id = 'a'").orderBy("pos").collect()
    assert resources[0].url == "https://docs.example.com/auth" and {"registry", "memory:source_quality:+16", "keyword:example api"} <= set(resources[0].matched)
    assert [m for m in resources[0].matched if m.startswith("subquery:")] == [f"subquery:{s.sub}" for s in research.planned_searches(found["runs"].where("run_id = 'a'").select(F.col("run_id").alias("query_id"), "query")).select("turn", "sub").distinct().orderBy("turn").collect()]
    text = {r.pack_id: r.markdown for r in found["answers"].collect()}
    assert "## Comparison table" in text["a"] and "https://docs.sample.com/auth" in text["a"]
    # the second project knows that a host is blocked; the third finds nothing that can be used
    assert runs["b"].blocked_hosts == 1 and runs["b"].documents == 1 and runs["b"].status == "partial" and runs["b"].warnings[0].endswith("source(s) failed to crawl")
    c = runs["c"]
    assert (c.status, c.answer, c.documents) == ("error", "insufficient_evidence", 0) and c.failed == 3 and c.blocked_hosts == 2 and c.skipped == 1 and c.retries == 2
    assert c.missing == ["No claim-level evidence was collected."] and "- No claim-level evidence was collected." in text["c"]
    assert "No evidence claims passed quality filtering" in c.warnings and "Answer status: insufficient_evidence" in c.warnings
    drafts = found["drafts"].where("run_id = 'c'").collect()
    assert {d.kind for d in drafts} == {"source_failure"} and any("HTTP 403" in d.text and d.confidence == 0.9 for d in drafts) and any("Skipped by quality gate" in d.text for d in drafts)
    out = {r.run_id: r for r in research.response_contract(found).collect()}
    assert out["a"].contractVersion == "research-response-v1" and out["a"].ui.answerMarkdown == text["a"] and len(out["a"].ui.resources) == 2 and out["a"].debug.search.query.startswith("Compare")
    assert out["c"].ui.warnings == c.warnings and out["c"].ui.citations == [] and out["b"].ui.crawlTrace.blocked_hosts == 1
    # what is stored already isn't ingested again, and a second run of the same question reads the same
    again = research.research(*tables(spark, [("a", "p", "Compare Example API and Sample API authentication")])[:5], found["documents"], found["documents"], F.lit(NOW).cast("timestamp"), max_sources=4)
    assert {r.status for r in again["documents"].collect()} == {"deduped"}


def test_answers_cite_sources_without_urls(spark):
    rows = [("p", u, t, "official_docs", f"The {t} API supports tokens number {k} for every client.", "q" * 30, "S", 0.9, ["API"], "supported", k) for k, (u, t) in enumerate([("", "One"), ("", "Two"), (None, "Three"), ("https://x.org", "Four"), ("", "One")])]
    claims = spark.createDataFrame(rows, "pack_id string, url string, title string, tier string, claim string, quote string, section string, confidence double, entities array<string>, status string, claim_pos int")
    q = spark.createDataFrame([("p", "plain question", None)], "pack_id string, query string, use_case string")
    got = answers.synthesize_answers(q, claims).first()
    assert got.supported == 5 and len(got.citations) == 4
    printed = [x for x in got.markdown.split("## Evidence notes")[0].split("\n") if re.match(r"\d+\. ", x)]
    assert len(printed) == 5 and sorted(re.search(r"\[(\d)\]$", x)[1] for x in printed) == ["1", "1", "2", "3", "4"]
    listed = got.markdown.split("## Sources\n")[1].split("\n")
    assert len(listed) == 4 and {x.split("] ")[1].split(" — ")[0] for x in listed} == {"One", "Two", "Three", "Four"}
    named = answers.topic_table(claims.withColumn("place", F.col("claim_pos")).withColumn("id", F.lit(1)).withColumn("product", F.when(F.col("claim_pos") == 0, "Prod")).withColumn("domain", F.when(F.col("claim_pos") < 2, "dom"))).first().body
    assert [x.split(" | ")[0] for x in named.split("\n")[2:]] == ["| Prod", "| dom", "| API"]


def test_evidence_gaps(spark):
    packs = spark.createDataFrame([("a", "comparison"), ("b", "api_facts"), ("c", "tutorial")], "pack_id string, use_case string")
    cover = spark.createDataFrame([("b", 3, 2, 0, 0), ("c", 3, 2, 0, 1)], "pack_id string, raw_claims long, kept_claims long, official_sources long, supported long")
    got = {r.pack_id: (r.raw_claims, len(r.missing)) for r in evidence.evidence_gaps(packs, cover).collect()}
    assert got == {"a": (0, 2), "b": (3, 2), "c": (3, 0)}


def test_simple_research(spark):
    q, registry, _, _, _, none, _, now = tables(spark, [("a", "p", "Compare Example API and Sample API authentication")])
    found = spark.createDataFrame([("a", 100 + k, f"https://s{k}.org/x", f"Found {k}", None, None, "reference_examples", ["zzz"], ["zzz"], "r", "search", None) for k in range(3)], "query_id string, " + CANDIDATE)
    quiet = "Zapf zipf zopf zupf zepf " * 40 + "."
    scraped = spark.createDataFrame([("https://docs.example.com/auth", "https://docs.example.com/auth", "Auth", EXAMPLE * 2), ("https://s0.org/x", "https://s0.org/x", "", quiet), ("https://s1.org/x", "https://s1.org/x", "T", "short")], "source_url string, url string, title string, markdown string")
    got = research.simple_research(q, registry, found, scraped, none, none, now)
    assert {(r.url, r.reason) for r in got["failures"].collect()} == {("https://docs.sample.com/auth", "Page could not be scraped."), ("https://s1.org/x", "Scraped markdown was too short."), ("https://s2.org/x", "Page could not be scraped.")}
    assert {r.strategy for r in got["resources"].collect()} == {"mixed"} and {r.status for r in got["documents"].collect()} == {"new"} and got["documents"].count() == 2
    claims = {(r.url, r.claim) for r in got["claims"].collect()}
    assert ("https://s0.org/x", 'Source "Found 0" contains potentially relevant information for the query.') in claims and len(claims) > 2
    assert got["packs"].first().raw_claims == len(claims)


def test_crawl_and_ingest(spark):
    pages = spark.createDataFrame([("https://x.org", '<a href="/a">a</a><a href="/b">b</a><a href="/gone">g</a>', "Home", "Start here. " * 100), ("https://x.org/a", "", None, "Page a."), ("https://x.org/b", "", "B", "Page a."), ("https://x.org/c", "", "C", "never seen")], "url string, html string, title string, markdown string")
    roots = spark.createDataFrame([(1, "https://x.org/", "p"), (2, "https://x.org/a", "p")], "root_id int, url string, project_id string")
    none = spark.createDataFrame([], "project_id string, content_hash string")
    visits, chunks = research.crawl_and_ingest(pages, roots, none, none)
    got = {(r.root_id, r.place): (r.url, r.found, r.status, r.chunks, r.preview and r.preview[:6]) for r in visits.collect()}
    assert got[1, 1][:4] == ("https://x.org", True, "new", 2) and got[1, 2] == ("https://x.org/a", True, "new", 1, "Page a")
    assert got[1, 3][:4] == ("https://x.org/b", True, "deduped", 0) and got[1, 4] == ("https://x.org/gone", False, None, 0, None) and got[2, 1][2:4] == ("deduped", 0)
    assert len(got) == 5 and chunks.count() == 3
    told = visits.where("root_id = 1").orderBy("place").first().preview
    assert told.startswith("Start here.") and "truncated" in told


def test_fallback_searches(spark):
    q = spark.createDataFrame([(1, "compare a and b"), (2, "what is it")], "query_id int, query string")
    got = {}
    for r in search.fallback_searches(q).orderBy("query_id", "turn").collect():
        got.setdefault(r.query_id, []).append(r.query)
    assert got == {1: ["compare a and b official documentation", "compare a and b API reference official docs", "compare a and b permissions rate limits official docs"], 2: ["what is it official docs", "what is it documentation"]}
