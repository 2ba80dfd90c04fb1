import random
import re

from pyspark.sql import functions as F

from lodestone.operators import evidence, logs, search
from lodestone.plans import queries as plans
from lodestone.sources import tables
from lodestone.streaming import ingest


def slow_chunks(t, size=700, overlap=200):
    out, start = [], 0
    while start < len(t):
        hard = min(start + size, len(t))
        end, p = hard, t.rfind("\n\n", 0, hard + 2)
        if p > start + int(size * 0.55):
            end = p
        if t[start:end].strip():
            out.append((len(out), start, end, t[start:end].strip()))
        if end >= len(t):
            break
        start = max(0, end - overlap)
    return out


def test_chunks(spark):
    r = random.Random(1)
    texts = ["", "short", "x" * 2000] + ["".join(r.choice(["word ", "a", "\n\n", ". ", "long" * 30]) for _ in range(r.randrange(400))).strip() for _ in range(40)]
    texts = [re.sub("\n{4,}", "\n\n\n", t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in evidence.chunk_text(df, "doc_id", "text").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(x.doc_id, []).append((x.chunk_index, x.start_char, x.end_char, x.chunk_text))
    assert got == {k: c for k, t in enumerate(texts) if (c := slow_chunks(t))}


def test_dedupe_pages_in_order(spark):
    rows = [(1, "https://a.b/1", "h one"), (2, "https://www.a.b/1", "h two"), (3, "https://a.b/2", "h two"), (4, "https://a.b/3", "H  Two")]
    got = {r.pos: r.status for r in evidence.dedupe_pages(spark.createDataFrame(rows, "pos long, url string, markdown string")).collect()}
    assert got == {1: "new", 2: "duplicate_url", 3: "new", 4: "duplicate_content"}
    r = random.Random(2)
    rows = [(k, f"https://a.b/{r.randrange(60)}", f"text {r.randrange(60)}") for k in range(150)]
    seen_u, seen_t, want = set(), set(), {}
    for k, u, t in rows:
        want[k] = "duplicate_url" if u in seen_u else "duplicate_content" if t in seen_t else "new"
        if want[k] == "new":
            seen_u.add(u)
            seen_t.add(t)
    assert {x.pos: x.status for x in evidence.dedupe_pages(spark.createDataFrame(rows, "pos long, url string, markdown string")).collect()} == want


def test_sections_and_evidence(spark):
    md = "Intro sentence that is long enough to pass as one whole claim here.\n# API Reference\n- The Example API requires an OAuth token for every request it gets.\n## Tutorial\n| The table row supports | version 2 of the Example API here |\n|---|---|\n##### no section\n"
    s = spark.createDataFrame([(md,)], "m string").select(evidence.split_sections(F.col("m")).alias("s")).first().s
    assert [x.heading for x in s] == ["Page", "API Reference", "Tutorial"]
    pages = spark.createDataFrame([("p", "https://a.b", "T", md, "official_docs", 1), ("p", "https://a.b", "T", md, "official_docs", 2)], "pack_id string, url string, title string, markdown string, tier string, pos long")
    e = evidence.extract_evidence(pages).collect()
    assert len({(x.url, x.claim.lower()) for x in e}) == len(e) and any(x.confidence == 0.96 for x in e)
    scored = evidence.near_dedupe_claims(evidence.extract_evidence(pages))
    c = evidence.evidence_coverage(scored).first()
    assert c.raw_claims == len(e) == c.kept_claims + c.quality_rejected + c.duplicate_rejected
    none = evidence.fallback_evidence(pages, evidence.extract_evidence(pages))
    assert none.count() == 0


def test_search(spark):
    c = spark.createDataFrame([(k, f"alpha {'beta' * (k % 2)}", f"T{k}", None, k) for k in range(9)], "chunk_id long, text string, title string, url string, pos long")
    q = spark.createDataFrame([(1, ["beta", "t3"])], "query_id int, tokens array<string>")
    got = [(r.chunk_id, r.score) for r in search.keyword_search(q, c, 3).orderBy("place").collect()]
    assert got == [(3, 10), (7, 2), (5, 2)]
    h = spark.createDataFrame([("q", k, "h" if k < 4 else f"h{k}") for k in range(6)], "q string, rank int, host string")
    got = [(r.rank, r.deferred) for r in search.select_diverse(h, "q", 5).orderBy("place").collect()]
    assert got == [(0, False), (1, False), (4, False), (5, False), (2, True)]
    e = spark.createDataFrame([("e1", "Example API", None), ("e2", "Other", "of example")], "id string, name string, description string")
    r = spark.createDataFrame([("r1", "e1", "x"), ("r2", "x", "e2"), ("r3", "x", "y"), ("r4", "e1", "e2")], "id string, source_id string, target_id string")
    found, touch = search.graph_hop(e, r, "Example")
    assert [x.id for x in found.collect()] == ["e1", "e2"] and [x.id for x in touch.collect()] == ["r1", "r2", "r4"]
    toks = spark.range(1).select(search.keyword_tokens(F.lit('the "Rate Limit" of the api'), ["the", "of"]).alias("t")).first().t
    assert toks == ["rate", "limit", "api"]


def test_logs(spark):
    rows = [(1, "x [1] y [2]\n## Sources\n[3]", [(1, "u1"), (2, "u2")], ["u1", "u2"]), (2, "x [99]", [(1, "u1")], ["u1"]), (3, "", [], []), (4, "no marker", [], ["u1"]), (5, "x [1]", [(1, "u9")], ["u1"])]
    a = spark.createDataFrame(rows, "answer_id int, markdown string, citations array<struct<id:int,url:string>>, row_urls array<string>")
    got = {r.answer_id: (r.status, r.missing, r.unused, r.ungrounded, len(r.issues)) for r in logs.grounding_audit(a).collect()}
    assert got == {1: ("pass", [], [], [], 0), 2: ("fail", [99], [1], [], 2), 3: ("pass", [], [], [], 0), 4: ("fail", [], [], [], 1), 5: ("fail", [], [], [1], 1)}
    d = spark.createDataFrame([(1, "p", None, "s", "k", "A  b", ["u2", "u1"]), (2, "p", None, "s", "k", " a B", ["u1", "u2", "u1"]), (3, "p", "x", "s", "k", "a b", ["u1", "u2"])], "pos int, project_id string, user_id string, scope string, kind string, text string, source_urls array<string>")
    assert sorted(r.pos for r in logs.dedupe_memory_drafts(d).collect()) == [1, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("  \n")
    assert [r.title for r in tables.ingest_text_files(spark, str(tmp_path), "p").collect()] == ["a.txt"]
    raw = spark.createDataFrame([("tavily", '{"results":[{"url":"https://www.x.y/z","content":"c"},{"title":"no url"}]}'), ("github", '{"items":[{"html_url":"https://github.com/a/b","name":"b","pushed_at":"2024"}]}')], "provider string, body string")
    got = {(r.provider, r.url, r.title, r.tier) for r in tables.normalize_search_results(raw).collect()}
    assert got == {("tavily", "https://www.x.y/z", "x.y", None), ("github", "https://github.com/a/b", "b", "reference_examples")}
    new = spark.createDataFrame([("p", None, None, "m1", 1), ("p", "t", "u", "m1", 2), ("p", None, "u3", "m2", 3)], "project_id string, title string, url string, markdown string, pos int")
    old = new.where("pos = 3").select("project_id", F.sha2("markdown", 256).alias("content_hash"))
    assert [(r.pos, r.title) for r in tables.upsert_documents(old, new).collect()] == [(1, "Untitled document")]


def test_stream_ingest_skips_what_it_knows(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, rows in enumerate([[(1, "one text"), (2, "one text")], [(3, "one text"), (4, "another")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
        ingest.stream_ingest(spark, folder, "doc_id long, text string", out, f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.chunk_text for r in spark.read.parquet(f"{out}/chunks").collect()) == ["another", "one text"]
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/documents").collect()) == [1, 4]


def test_stream_of_equal_documents_keeps_the_first(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([(9, "same"), (3, "same"), (5, None)], [(1, "same"), (2, "new"), (7, "new")]):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.mode("append").parquet(folder)
        ingest.stream_ingest(spark, folder, "doc_id long, text string", out, f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/documents").collect()) == [2, 3, 5]


def test_no_python_in_plans(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    for name, q in plans.QUERIES.items():
        plan = q(spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan, name


def test_memory_and_answers(spark):
    from lodestone.operators import answers, memory, repos

    claims = spark.createDataFrame(
        [("p", "u1", "T1", "community", "supported", 1, 0.9, "a  claim"), ("p", "u1", "T2", "official_docs", "supported", 2, 0.8, "b"), ("p", "u2", "T3", "media", "weak", 3, 0.5, "c"), ("p", "u1", "T1", "community", "unsupported", 4, 0.1, "d")],
        "pack_id string, url string, title string, tier string, status string, claim_pos int, confidence double, claim string",
    )
    m = {r.url: r for r in memory.source_quality_memories(claims).collect()}
    assert m["u1"].title == "T2" and m["u1"].claim_count == 3 and abs(m["u1"].confidence - 0.92) < 1e-9 and abs(m["u2"].confidence - 0.65) < 1e-9
    assert [(r.id, r.url, r.used_claims) for r in answers.citations(claims.where("status != 'unsupported'")).orderBy("id").collect()] == [(1, "u1", 2), (2, "u2", 1)]
    assert answers.answer_confidence(claims.where("status != 'unsupported'")).first().confidence == round(0.85 * 0.8 + 2 / 3 * 0.2, 2)
    full = claims.withColumn("section", F.lit("Page")).withColumn("entities", F.array(F.lit("Example")))
    best = answers.answer_evidence(spark.createDataFrame([("p", "claim example")], "pack_id string, query string"), full, 2).orderBy("place").collect()
    assert [r.claim for r in best] == ["b", "a  claim"]
    dump = spark.createDataFrame([("1 2 3\n44 55\n99",), ("plain words\nof text\nhere",), ("1",)], "t string").select(answers.numeric_dump(F.col("t")).alias("x")).collect()
    assert [r.x for r in dump] == [True, False, False]
    c = spark.createDataFrame([(1, "https://docs.example.com/a", "One"), (2, "https://example.com/b/", "Two"), (3, "https://other.org", "The example api Docs")], "pos int, url string, title string")
    mem = spark.createDataFrame([("m1", "source_quality", 1.0, ["https://example.com"], [], False), ("m2", "source_failure", 0.5, ["https://docs.example.com/a"], [], True), ("m3", "durable_fact", 0.9, ["https://other.org"], ["Nothing", "Example API", "Docs"], False)], "id string, kind string, confidence double, source_urls array<string>, entities array<string>, domain_blocked boolean")
    deltas = {r.pos: (r.delta, r.matched) for r in memory.memory_deltas(c, mem).collect()}
    assert {k: (d, len(t)) for k, (d, t) in deltas.items()} == {1: (3, 2), 2: (3, 2), 3: (5, 1)} and deltas[3][1] == ["memory:durable_fact_entity:Example API:+5"]
    stay, gone = memory.exclude_blocked(c, mem)
    assert sorted(r.pos for r in stay.collect()) == [2, 3] and [r.pos for r in gone.collect()] == [1]
    refs = spark.createDataFrame([("https://github.com/a/b.git",), ("a/b",), ("nothing",)], "r string").select(repos.parse_repo_ref(F.col("r")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in refs] == [("a", "b"), ("a", "b"), None]
    files = spark.createDataFrame([("r", "README.md", None), ("r", "apps/api/src/server.ts", None), ("r", "package.json", "fastify"), ("r", "x.bin", None)], "repo string, path string, text string")
    assert [r.path for r in repos.select_repo_files(files).orderBy("place").collect()] == ["README.md", "package.json", "apps/api/src/server.ts"]
    assert repos.repo_stack(files).first().stack == ["API service", "Fastify"]


def test_near_claims_in_order_without_a_row_for_a_pack(spark):
    r, rows = random.Random(5), []
    for k in range(240):
        base = random.Random(k % 24).sample([f"api{j}" for j in range(200)], 20)
        for j in r.sample(range(20), r.randrange(4)):
            base[j] = f"new{r.randrange(300)}"
        rows.append((f"p{k % 2}", f"https://a.b/{k}", "T", "official_docs", (k, 0, 0), "The Example API OAuth 2 SDK Token needs " + " ".join(base), "Authentication", ["Example", "OAuth"]))
    schema = "pack_id string, url string, title string, tier string, claim_pos struct<pos:long,section_no:int,no:int>, claim string, section string, entities array<string>"
    out = evidence.near_dedupe_claims(spark.createDataFrame(rows, schema))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got, kept = out.withColumn("w", evidence.word_set(F.col("claim"))).collect(), {}
    for x in sorted(got, key=lambda x: (-x.quality.total, x.claim_pos)):
        w, before = set(x.w), kept.setdefault(x.pack_id, [])
        stays = all(len(w & o) / len(w | o) <= 0.7 for o in before)
        assert x.outcome == ("kept" if stays else "duplicate_rejected")
        if stays:
            before.append(w)
    assert len(got) == 240 and 24 <= sum(map(len, kept.values())) < 200
