import re

from pyspark.sql import functions as F

from lodestone.functions import checks, intents, text
from lodestone.operators import answers, logs, providers, repos, runs, search
from lodestone.plans import queries, research
from lodestone.sources import tables


def col(spark, values, f):
    return [r.y for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").orderBy("k").select(f(F.col("x")).alias("y")).collect()]


def test_intents(spark):
    asked = ["see https://github.com/a/b", "readme of it", "latest of it", "oauth", "my pdf", "debug it", "hello"]
    got = col(spark, asked, intents.fast_intent)
    assert [x.intent for x in got] == ["github_repo", "kb", "news", "web_research", "document", "code", "general"]
    assert got[0].tools == ["github_repo"] and got[5].mode == "deep" and not got[6].web
    assert col(spark, ["a vs b", "the file", "overview", "x"], intents.strategy_type) == ["comparison_table", "document_qa", "research_summary", None]
    assert col(spark, ["what vs b", "x" * 181, "a plan of risk"], intents.should_use_strategy) == [False, True, True]
    assert col(spark, ["my sdk ", "cats", "repo in:name"], intents.repo_search_query) == ["my sdk in:name,description,readme", None, "repo in:name"]
    assert [(x.kind, x.normalized) for x in col(spark, ["table of mets graph api", "ads", "x"], intents.fallback_intent)] == [("comparison", "table of Meta Graph API"), ("web_research", "ads"), ("simple_answer", "x")]
    assert col(spark, ["Use the C++ API. And React-Native, API", "the API. C++"], text.extract_entities) == [["Use", "C++ API. And React-Native", "API"], ["API. C"]]


def test_checks(spark):
    assert col(spark, ["Done", "see above", '[{"a"', "fine words here", None], checks.generic_or_raw) == [True, True, True, False, True]
    assert col(spark, ["varies varies varies", "a | - | b", "api of 12345", "on reddit.com", "fine"], checks.bad_answer) == [True, True, True, True, False]
    rows = [("q", "short", [], [], 1), ("q", "x" * 30, ["web_research"], [], 1), ("latest", "x" * 30, [], [], 0), ("implement it", "Use `f`:\n```\nreturn 1\n```\n" + "x" * 60, [], [], 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, q string, a string, required array<string>, called array<string>, n int")
    c = checks.heuristic_critic(F.col("q"), F.col("a"), F.col("required"), F.col("called"), F.col("n"))
    got = df.withColumn("c", c).select("k", "c", checks.coding_override(F.col("q"), F.col("a"), F.col("c")).alias("o"), checks.final_gate(F.col("a"), F.col("required"), F.col("called")).alias("g")).orderBy("k").collect()
    assert [r.c.score for r in got[:3]] == [0.15, 0.25, 0.35] and got[3].c.passed and got[3].o == 0.82 and [r.g for r in got] == [None, "missing_tools", None, None]
    verdicts = col(spark, ['{"passed": true, "score": 0.9}', 'so: {"passed": true, "dimensions": {"relevance": 1, "specificity": 2, "completeness": 0, "sourceUse": -1}} end', "none"], checks.critic_json)
    assert [(v.passed, v.score) if v else None for v in verdicts] == [(True, 0.9), (False, 0.5), None]


def claims(spark):
    rows = [
        ("p", "https://a.org", "A", "official_docs", (1, 0, 0), "The Example API needs an OAuth token.", "quote of twenty chars", "API", 0.96, ["Example API"], "supported"),
        ("p", "https://b.org", "B", "community", (2, 0, 0), "Another maybe.", "quote of twenty chars", "", 0.56, ["Example API"], "weak"),
        ("p", "https://a.org", "A", "official_docs", (3, 0, 0), "Tokens expire.", "quote of twenty chars", "API", 0.9, [], "supported"),
        ("p", "https://c.org", "C", "media", (4, 0, 0), "Never printed.", "q", "", 0.5, [], "unsupported"),
        ("w", "https://b.org", "B", "community", (1, 0, 0), "Only a hint.", "quote of twenty chars", "", 0.56, [], "weak"),
    ]
    return spark.createDataFrame(rows, "pack_id string, url string, title string, tier string, claim_pos struct<a:int,b:int,c:int>, claim string, quote string, section string, confidence double, entities array<string>, status string")


def test_written_answers(spark):
    for query, use, mode, head in (("compare them", "comparison", "comparison", "## Comparison table"), ("how to", None, "how_to", "## Steps / implementation notes"), ("overview", None, "research_summary", "## Main points"), ("x", None, "general", "1. ")):
        q = spark.createDataFrame([("p", query, use), ("w", query, use), ("none", query, use)], "pack_id string, query string, use_case string")
        got = {r.pack_id: r for r in answers.synthesize_answers(q, claims(spark)).collect()}
        a = got["p"]
        assert (a.status, a.mode, a.supported, a.weak, [c.url for c in a.citations]) == ("answered", mode, 2, 1, ["https://a.org", "https://b.org"])
        assert head in a.markdown and "Likely: Another maybe. [2]" in a.markdown and "Never printed" not in a.markdown and a.markdown.endswith("[2] B — https://b.org")
        assert got["w"].status == "partial" and got["none"].status == "insufficient_evidence" and got["none"].confidence == 0
        audit = {r.answer_id: r.status for r in logs.grounding_audit(answers.synthesize_answers(q, claims(spark)).withColumnRenamed("pack_id", "answer_id")).collect()}
        assert audit == {"p": "pass", "w": "pass", "none": "pass"}
    table = answers.synthesize_answers(spark.createDataFrame([("p", "compare", None)], "pack_id string, query string, use_case string"), claims(spark)).first().markdown
    assert "| Example API | The Example API needs an OAuth token. [1]<br>Likely: Another maybe. [2] |\n| A | Tokens expire. [1] |" in table
    assert answers.synthesize_answers(spark.createDataFrame([], "pack_id string, query string, use_case string"), claims(spark)).count() == 0


def test_providers(spark):
    q = spark.createDataFrame([("q", "python sdk"), ("d", "plain docs")], "query_id string, query string")
    rows = [(i, p, k, f"https://x.org/{k}" + "/" * (p == "github"), f"{p}{k}", None if p == "github" else "2024", [p], "Found.") for i in "qd" for p in ("tavily", "github") for k in range(12)]
    r = spark.createDataFrame(rows, "query_id string, provider string, pos int, url string, title string, published_at string, keywords array<string>, reason string")
    got, trace = providers.search_candidates(q, r, tables.route_budgets(spark), limit=3)
    one = got.where("query_id = 'q' and place = 1").first()
    assert (one.title, one.published_at, one.keywords, one.alternates, one.reason) == ("github0", "2024", ["github", "tavily"], ["tavily"], "Found. Also discovered by tavily.")
    assert got.where("query_id = 'q'").count() == 9 and {(x.provider, x.status, x.result_count) for x in trace.where("query_id = 'q'").collect()} == {("github", "fulfilled", 10), ("tavily", "fulfilled", 6), ("firecrawl", "rejected", 0)}


def test_runs(spark):
    s = spark.createDataFrame([(1, 1, "good https://h.org/a and https://youtu.be/x"), (1, 2, "An error occurred: 0"), (1, 3, " "), (2, 1, "an ERROR occurred: 0 https://ads.tiktok.com/1, https://h.org/b"), (3, 1, None)], "run_id int, step int, stdout string")
    assert {r.run_id: r.stdout[:8] for r in runs.last_useful_stdout(s).collect()} == {1: "good htt", 2: "an ERROR"}
    assert [(r.run_id, r.place, r.url) for r in runs.named_sources(s).orderBy("run_id", "place").collect()] == [(1, 1, "https://h.org/a"), (2, 1, "https://ads.tiktok.com/1"), (2, 2, "https://h.org/b")]
    v = spark.createDataFrame([("research-response-v1", "pass", 0, 1, 1, 5, 1, 1, 5), (None, None, 2, 0, 0, 0, None, None, None)], "contract_version string, grounding_status string, grounding_issues int, citations int, accepted_pages int, filtered_claims int, min_citations int, min_pages int, min_claims int")
    got = [(r.passed, r.failures) for r in runs.benchmark_verdicts(v).collect()]
    assert got == [(True, []), (False, ["missing_contract_version", "grounding_not_pass:missing", "grounding_issues:2", "low_citations:0", "low_accepted_pages:0", "low_filtered_claims:0"])]


def test_phrases_and_fallback_by_words(spark):
    c = spark.createDataFrame([(k, f"alpha {'rate limits' if k == 1 else 'beta'}", f"T{k}", None, k) for k in range(4)], "chunk_id long, text string, title string, url string, pos long")
    q = spark.createDataFrame([(1, ["rate", "alpha"], ["Rate limits"], [1.0, 0.0]), (2, ["beta"], [], None)], "query_id int, tokens array<string>, phrases array<string>, query_vec array<double>")
    assert [(r.query_id, r.chunk_id, r.score) for r in search.keyword_search(q, c, 1).orderBy("query_id").collect()] == [(1, 1, 12), (2, 3, 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.6, 0.8]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.chunk_id, r.retrieval, r.title) for r in search.search_kb(q, v, c, 2).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, "semantic", "T1"), (1, 9, "semantic", None), (2, 3, "keyword_fallback", "T3"), (2, 2, "keyword_fallback", "T2")]


def test_plans_of_resources(spark):
    q = spark.createDataFrame([("a", "compare openai api and claude and nvidia"), ("b", "zzz")], "query_id string, query string")
    registry = tables.source_registry(spark)
    assert registry.count() == 14
    found = spark.createDataFrame([(i, f"https://s{k}.org/x", "community", 100 + k) for i in "ab" for k in range(3)], "query_id string, url string, tier string, pos long")
    found = found.selectExpr("query_id", "url", "'T' AS title", "CAST(NULL AS STRING) AS product", "CAST(NULL AS STRING) AS domain", "tier", "array('zzz') AS topics", "array('zzz') AS keywords", "'r' AS reason", "'search' AS source", "CAST(NULL AS TIMESTAMP) AS published_at", "pos")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    one = search.plan_resources(q, registry, found, now, 4).collect()
    assert {r.strategy for r in one} == {"registry_first"} and len(one) == 8
    top = [r.url for r in sorted(one, key=lambda r: r.place) if r.query_id == "a"]
    assert set(top[:3]) == {"https://platform.openai.com/docs", "https://docs.anthropic.com/", "https://docs.api.nvidia.com/"}
    little = registry.where("pos = 3").withColumn("tier", F.lit("media"))
    two = {(r.query_id, r.strategy, r.url) for r in search.plan_resources(q, little, found, now, 2).collect()}
    assert {(i, s) for i, s, _ in two} == {("a", "mixed"), ("b", "search_fallback")} and all("//s" in u for i, _, u in two if i == "b")
    memories = spark.createDataFrame([("m", "source_failure", 1.0, ["https://platform.openai.com/docs"], ["x"])], "id string, kind string, confidence double, source_urls array<string>, entities array<string>")
    score = {r.url: r.score for r in search.plan_resources(q, registry, found, now, 4).where("query_id = 'a'").collect()}
    less = {r.url: r.score for r in search.plan_resources(q, registry, found, now, 4, memories).where("query_id = 'a'").collect()}
    assert less["https://platform.openai.com/docs"] == score["https://platform.openai.com/docs"] - 30


def test_stored_memories_and_ingest(spark):
    m = spark.createDataFrame([("1", '["a", "b"]', "{}", None, '{"k": "v"}'), ("2", "no", None, 0.4, "[]")], "id string, entities string, source_urls string, confidence double, metadata string")
    got = {r.id: (r.entities, r.source_urls, r.confidence) for r in tables.scan_memories(m).collect()}
    assert got == {"1": (["a", "b"], [], 0.7), "2": ([], [], 0.4)}
    rows = [(1, "p", None, None, "one"), (2, "p", "t", None, "one"), (3, "p", "t", None, "two"), (4, "p", "t", None, "three"), (5, "q", "t", None, "one")]
    new = spark.createDataFrame(rows, "pos int, project_id string, title string, url string, markdown string")
    key = new.select("project_id", F.sha2("markdown", 256).alias("content_hash"), "pos")
    told, chunks = tables.ingest(key.where("pos in (3, 4)"), key.where("pos = 4"), new)
    assert {r.pos: r.status for r in told.collect()} == {1: "new", 2: "deduped", 3: "backfilled", 4: "deduped", 5: "new"}
    assert sorted(r.pos for r in chunks.collect()) == [1, 3, 5]


def test_scrapes_suites_and_summaries(spark, tmp_path):
    raw = spark.createDataFrame([('{"url":"https://a.org","markdown":"%s","title":"A"}' % ("x" * 120),), ('{"data":{"url":"https://b.org","markdown":"short"},"description":"told"}',), ('{"markdown":"no url"}',), ('{"metadata":{"sourceURL":"https://c.org"}}',)], "body string")
    assert {(r.url, r.title, r.markdown[:5]) for r in tables.normalize_scrape_results(raw).collect()} == {("https://a.org", "A", "xxxxx"), ("https://b.org", "https://b.org", "told"), ("https://c.org", "https://c.org", "https")}
    (tmp_path / "suite.json").write_text('[{"id": "q1", "category": "c", "query": "x", "minCitations": 2}]')
    assert [(r.id, r.minCitations, r.minAcceptedPages) for r in tables.load_query_suite(spark, f"{tmp_path}/suite.json").collect()] == [("q1", 2, None)]
    rows = spark.createDataFrame([("a|b", ["x", "y"], True)], "name string, failures array<string>, passed boolean")
    tables.write_run_summary(rows, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/markdown").collect()] == ["| name | failures | passed |", "|---|---|---|", "| a\\|b | x\\|y | true |"]
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/out/csv").collect()] == [("a|b", "x|y", "true")] and spark.read.json(f"{tmp_path}/out/json").count() == 1
    assert tables.vector_stats(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 0.0])], "id int, embedding array<double>")).first().asDict() == {"dimension": 2, "points": 2}


def test_repository_summaries(spark):
    files = spark.createDataFrame([("o/r", "README.md", "# Title\n\nFirst line.\r\nSecond."), ("o/r", "apps/api/src/server.ts", "// note\n"), ("o/r", "package.json", '{"fastify": 1}' + " " * 3000 + "x"), ("o/r", "a.bin", None)], "repo string, path string, text string")
    r = repos.summarize_repos(files).first()
    assert (r.files, r.selected, r.stack) == (4, 3, ["API service", "Fastify"])
    assert "- `README.md`: First line. Second." in r.markdown and "- `apps/api/src/server.ts`: File inspected." in r.markdown and "## High-level structure\n\n- `README.md`\n- `package.json`\n- `apps`" in r.markdown and "...[truncated]" in r.markdown


def test_links(spark):
    base = "https://x.org/a/b?q"
    hrefs = ["c", "/d/", "//y.org/z", "?p=1", "#f", "HTTPS://x.org/e#g", "mailto:a@x.org", "/user/LOGIN/x", "p?utm_source=1", "//x.org/k"]
    html = "".join(f"<a class=k href={q}{h}{q}>t</a>" for h, q in zip(hrefs, "\"'" * 5)) + "<a name='n'>none</a>"
    p = spark.createDataFrame([(1, base, html)], "page_id int, url string, html string")
    assert {r.link for r in logs.page_links(p).collect()} == {"https://x.org/a/c", "https://x.org/d", "https://x.org/a/b?p=1", "https://x.org/a/b", "HTTPS://x.org/e", "https://x.org/k"}


def test_every_query_has_sql_or_a_test():
    names = {*queries.QUERIES, *research.QUERIES}
    sql = {*queries.ORACLES, *research.ORACLES}
    assert names - sql == {"crawled_sites", "written_answers"} and sql <= names  # test_crawl.py and test_written_answers hold these
    assert not [n for n, s in (queries.ORACLES | research.ORACLES).items() if re.search(r"\{[a-z_]+\.", s)]
