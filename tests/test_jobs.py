import datetime as dt
import json

from pyspark.sql import functions as F

from lodestone.functions import checks, model_json
from lodestone.operators import jobs, runs
from lodestone.sources import tables

V = "research-response-v1"


def col(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_json_from_text(spark):
    got = col(spark, ['{"a": 1}', ' [1, 2] ', 'so: {"a": {"b": 2}} end', "{bad} {", None, "5", '{"a": 1} tail', "no"], model_json.json_object_from_text)
    assert got == ['{"a": 1}', "[1, 2]", '{"a": {"b": 2}}', None, None, None, '{"a": 1}', None]
    assert col(spark, ["```python\nx = 1\n```", " plain ", "a ``` b", "```\ny```"], model_json.strip_code_fence) == ["x = 1", "plain", "a ``` b", "y"]
    said = ['{"passed": true, "score": 0.9}', 'I say {"passed": true, "dimensions": {"relevance": 1, "specificity": 1, "completeness": 1, "sourceUse": 1}}!', "nothing"]
    assert [x and tuple(x) for x in col(spark, said, checks.critic_json)] == [(True, 0.9), (True, 1.0), None]


def test_model_labels(spark):
    said = ['{"intent":"news","requiredTools":["web_research","rm","web_research"],"answerMode":"deep","requiresFreshness":1,"reason":"r"}', 'x {"intent":"other","requiresWeb":"","requiresGithub":"yes","reason":5} y', "junk", '{"requiresFreshness":0,"requiresWeb":{},"requiredTools":"search_kb"}']
    got = [tuple(x) if x else None for x in col(spark, said, model_json.parse_model_labels)]
    assert got == [("news", ["web_research"], "deep", True, True, False, "r"), ("general", [], "fast", False, False, True, "Classified by fast intent model."), ("general", [], "fast", False, False, False, None), ("general", [], "fast", False, True, False, "Classified by fast intent model.")]


def test_strategy_outputs(spark):
    table = {"type": "comparison_table", "title": "T", "entities": ["a"], "columns": ["x", "y"], "rows": [{"Entity": "A", "x": "1"}, {"name": "B", "y": "2"}], "recommendation": "take A"}
    qa = {"type": "document_qa", "answer": "yes", "key_points": ["k"], "citations": [{"text": "q", "source": "s"}]}
    said = [json.dumps(x) for x in (table, qa, {"type": "factual_answer", "answer": "a", "details": ["d"]}, {"type": "research_summary", "summary": "s", "key_findings": []}, {"type": "comparison_table", "columns": []}, {"type": "factual_answer", "answer": 5}, {"type": "zzz"})] + ["[1]", None]
    got = [x and tuple(x) for x in col(spark, said, model_json.strategy_output)]
    assert got[0] == ("comparison_table", [], "## T\n\n| Entity | x | y |\n| --- | --- | --- |\n| A | 1 | — |\n| B | — | 2 |\n\n### Recommendation\n\ntake A\n")
    assert got[1][2] == "yes\n\n### Key Points\n\n- k\n\n### Citations\n\n> q\n> — s\n" and got[2][2] == "a\n\n- d\n" and got[3][2] == "s\n"
    assert got[4][:2] == ("comparison_table", ["entities", "rows"]) and got[4][2] is None and got[5] == ("factual_answer", ["answer"], None) and got[6:] == [None] * 3


def slow_find(v, depth=0):
    if depth > 4 or not isinstance(v, dict):
        return None
    if v.get("contractVersion") == V:
        return v
    for x in [v.get(k) for k in jobs.PREFERRED] + list(v.values()):
        if (found := slow_find(x, depth + 1)) is not None:
            return found
    return None


def test_contracts_and_answers(spark):
    c = lambda n: {"contractVersion": V, "ui": {"answerMarkdown": f" answer {n} ", "citations": [{"url": f"u{n}"}] if n % 2 else [], "resources": [{"url": "r"}]}}
    deep = lambda v, *keys: v if not keys else {"pad": 1, keys[0]: deep(v, *keys[1:])}
    values = [c(1), {"z": c(2), "a": c(3)}, {"z": c(2), "result": {"no": 1, "data": c(4)}}, deep(c(5), "a", "b", "c", "d"), deep(c(6), "a", "b", "c", "d", "e"), {"text": json.dumps(c(7)), "list": [c(8)]}, {"contractVersion": 5, "output": {"x": {"contractVersion": V}, "final": c(9)}}, None, [c(1)]]
    raw = spark.createDataFrame([(k, 0, json.dumps(v)) for k, v in enumerate(values)] + [(1, 1, json.dumps(c(11))), (4, 1, json.dumps(c(12))), (20, 0, "plain research-response-v1 {")], "job_id long, turn int, raw string")
    got = {r.job_id: json.loads(r.contract) for r in jobs.find_contracts(raw).collect()}
    want = {k: slow_find(v) for k, v in enumerate(values) if slow_find(v)} | {4: c(12)}
    assert got == want and set(want) == {0, 1, 2, 3, 4, 6}
    js = spark.createDataFrame([(k, "boom" if k == 5 else None) for k in range(7)], "job_id long, error string")
    reports = spark.createDataFrame([(0, 0, "as shown above", json.dumps({"result": c(1)})), (1, 0, "A report.", json.dumps({"sources": [1]})), (2, 0, "done", "{}"), (3, 1, "later", None), (3, 0, "See the table", None)], "job_id long, pos int, content string, metadata string")
    runs = spark.createDataFrame([(2, 0, json.dumps({"steps": [{"stdout": "one"}, {"stdout": " two "}, {"stdout": ""}], "sources": [{"url": "s"}]})), (3, 0, json.dumps({"final": "the end", "sources": "x"})), (4, 0, json.dumps({"final": {"a": 1}})), (6, 0, json.dumps({"final": c(3)}))], "job_id long, pos int, final_output string")
    steps = spark.createDataFrame([(4, 0, 0, json.dumps({"o": 1}), json.dumps(c(2))), (4, 0, 1, json.dumps(c(3)), "x")], "job_id long, pos int, step int, result string, stdout string")
    got = {r.job_id: (r.answer, r.origin, json.loads(r.sources)) for r in jobs.job_answers(js, reports, runs, steps).collect()}
    assert got == {0: ("answer 1", "contract", [{"url": "u1"}]), 1: ("A report.", "report", [1]), 2: ("two", "stdout", [{"url": "s"}]), 3: ("the end", "final", []), 4: ("answer 2", "contract", [{"url": "r"}]), 5: ("boom", "error", []), 6: ("answer 3", "contract", [{"url": "u3"}])}
    assert col(spark, ['"text"', '{"a":1}', None, "not json", "null"], jobs.readable) == ["text", '{"a":1}', "", "not json", ""]


def test_sources_of_answers(spark):
    finals = spark.createDataFrame([(1, json.dumps({"title": "A", "url": "https://a.org", "score": 0.5, "parts": [{"sourceUrl": "https://developers.google.com/x", "url": "u"}, [{"title": "A", "url": "https://a.org"}], {"deep": {"deeper": {"title": "only"}}}], "b": {"url": "https://youtube.com/w"}})), (2, "plain"), (3, json.dumps([{"url": f"https://h{k}.org"} for k in range(12)]))], "job_id long, raw string")
    steps = spark.createDataFrame([(1, 0, json.dumps({"url": "https://b.org", "retrieval": "semantic"}), "see https://c.org/x, and https://a.org"), (2, 0, None, "https://m.medium.com/1 https://d.org")], "job_id long, step int, raw string, stdout string")
    got = {}
    for r in jobs.extract_sources(finals, steps).orderBy("place").collect():
        got.setdefault(r.job_id, []).append((r.title, r.url, r.score, r.retrieval))
    assert got[1] == [(None, "https://developers.google.com/x", None, None), ("A", "https://a.org", 0.5, None), (None, "https://b.org", None, "semantic"), (None, "https://c.org/x", None, None), (None, "https://a.org", None, None), ("only", None, None, None)]
    assert got[2] == [(None, "https://d.org", None, None)] and [x[1] for x in got[3]] == [f"https://h{k}.org" for k in range(8)]


def test_reports_are_written_once(spark, tmp_path):
    rows = [(k, "p", None if k % 3 else f"c{k}", f"answer {k}", ["s"]) for k in range(50)]
    df = spark.createDataFrame(rows, "job_id long, project_id string, conversation_id string, answer string, sources array<string>")
    reports, messages = jobs.report_rows(df)
    assert reports.count() == 50 and messages.count() == 17 and json.loads(reports.first().metadata) == {"sources": ["s"]}
    for part in (reports, reports.where("job_id < 20"), reports.where("job_id < 10").withColumn("content", F.lit("new"))):
        jobs.write_by_key(part, f"{tmp_path}/reports", parts=8)
    got = {r.job_id: r.content for r in spark.read.parquet(f"{tmp_path}/reports").collect()}
    assert spark.read.parquet(f"{tmp_path}/reports").count() == 50 and got == {k: "new" if k < 10 else f"answer {k}" for k in range(50)}


def test_lists_in_pages(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 3)) for k in range(40)] + [(99, None)]
    spark.createDataFrame(rows, "id long, t timestamp").write.parquet(f"{tmp_path}/list")
    df, after, seen = spark.read.parquet(f"{tmp_path}/list"), None, []
    while page := jobs.newest_page(df, "t", "id", 7, after).collect():
        seen += [r.id for r in page]
        after = (page[-1].t, page[-1].id)
    assert seen == [r.id for r in df.where("t is not null").orderBy(F.desc("t"), F.desc("id")).collect()]
    plan = jobs.newest_page(df, "t", "id", 7, after)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "LessThanOrEqual(t" in plan
    assert [r.id for r in jobs.newest_page(df, "t", "id", 3, oldest_first=True).collect()] == [0, 1, 2]


def test_benchmark_summary(spark):
    got = spark.createDataFrame([("q1", "ok", "general", "pass", 0, 2, 3, 1, 0, 0, 0, 0, 9, 6, 2, 1, 5, 1, 0, 4, ["w"]), ("q2", "partial", "how_to", "fail", 2, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 2, [])],
        "run_id string, status string, mode string, grounding string, issues int, citations int, accepted int, skipped int, retries int, rejected_by_quality int, duplicate_url int, duplicate_content int, raw_claims int, kept_claims int, quality_rejected int, duplicate_rejected int, supported int, weak int, unsupported int, resources int, warnings array<string>")
    suite = spark.createDataFrame([("q1", "a", 1, 5, 1), ("q2", "b", 1, 5, 1), ("q3", "b", None, None, None)], "id string, category string, minAcceptedPages int, minFilteredClaims int, minCitations int")
    rows = runs.benchmark_rows(got.withColumn("routes", F.array(F.lit("docs"), F.lit("code"))), suite)
    assert rows.columns == list(runs.SUMMARY) and len(rows.columns) == 27
    r = {x.id: x for x in rows.collect()}
    assert r["q1"].passed and r["q1"].failures == "" and r["q1"].warningsLength == 1 and r["q1"].routeKinds == "docs|code" and r["q1"].durationMs is None
    assert r["q2"].failures == "grounding_not_pass:fail; grounding_issues:2; low_citations:0; low_accepted_pages:0; low_filtered_claims:1" and r["q3"].failures == "request_error:no response"
    text = runs.benchmark_markdown(rows, "s", "f", "api", "p").first().markdown.split("\n")
    assert text[6:8] == ["- Passed: 1/3", "- Failed: 2/3"] and "| q1 | ✅ | pass | 6 | 2 | 3 | 0 |  |" in text and text[-1] == "- **q3**: request_error:no response"


def test_job_views_and_budgets(spark):
    js = spark.createDataFrame([(1, "q"), (2, "r")], "job_id int, question string")
    reports = spark.createDataFrame([(1, k, f"r{k}") for k in range(5)], "job_id int, pos int, content string")
    rs = spark.createDataFrame([(1, "a", 0, "done"), (1, "b", 1, "failed")], "job_id int, run string, pos int, status string")
    steps = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one")], "run string, step int, stdout string")
    got = {r.job_id: r for r in runs.nested_job_views(js, reports, rs, steps, 3).collect()}
    assert got[1].reports == ["r4", "r3", "r2"] and [(x.run, [s.stdout for s in x.steps]) for x in got[1].runs] == [("b", []), ("a", ["one", "two"])] and got[2].reports == [] and got[2].runs == []
    plain = {(r.route, r.provider): (r.max_results, r.enabled) for r in tables.route_budgets(spark).collect()}
    over = spark.createDataFrame([(None, "tavily", 99, None), ("docs", "tavily", 7, None), (None, "github", None, False)], "route string, provider string, max_results int, enabled boolean")
    own = {(r.route, r.provider): (r.max_results, r.enabled) for r in tables.route_budgets(spark, over).collect()}
    assert own.keys() == plain.keys() and own["docs", "tavily"][0] == 7 and all(v[0] == 99 for (r, p), v in own.items() if p == "tavily" and r != "docs") and not any(v[1] for (_, p), v in own.items() if p == "github")
    assert all(own[k] == v for k, v in plain.items() if k[1] not in ("tavily", "github"))
