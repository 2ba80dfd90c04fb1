"""Queries against their SQL on small tables of what the driver's rarely or never hold."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import scores
from lodestone.operators import providers, search
from lodestone.sources import tables

#: What providers give: a row of one of them.
RESULTS = "batch long, provider string, pos long, url string, title string, published_at string, keywords array<string>, reason string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, texts):
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{folder}/documents.parquet")


def equal_to_sql(spark, folder, name, tables=("documents",)):
    """Compare the rows of a query with those of its SQL, and return them."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def test_ratios_are_rounded_like_sql(spark, tmp_path):
    ratios = sorted({a / b for b in range(1, 120) for a in range(b + 1)} | {k / 1000 for k in range(1001)} | {0.004, 0.005, 1e-9})
    got = spark.createDataFrame([(x,) for x in ratios], "x double").select("x", scores.two_places(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [f"{r.x:.2f}" for r in got]
    # an eighth of the words, three eighths and five eighths of the lines
    documents(spark, tmp_path, ["aaa " * 15 + "bbb", "aaa " * 39 + "bbb ccc ddd eee ", "aaa " * 7 + "bbb", "aaa " * 8, "\n".join(["https://a.b/c"] * 5 + ["word"] * 3), "\n".join(["https://a.b/c"] * 7 + ["word"])])
    flags = [r[5] for r in equal_to_sql(spark, tmp_path, "page_quality_scores")]
    assert sum("low_unique_word_ratio:0.12" in f for f in flags) == 3 and sum(f.endswith(("0.62", "0.88")) for f in flags) == 2


def test_sections_of_odd_documents(spark, tmp_path):
    odd = [None, "", " ", "\n\n", "\r\n", "# own\nword", "word\n#### own \n# b", "a\r\nb\r", "\x0b", "a\x0b\nb", "\t\n\n x \n", "##### five\n\n\nword one", "# API Reference\n\r\n"]
    documents(spark, tmp_path, odd * 5)  # each under every heading
    rows = equal_to_sql(spark, tmp_path, "sections_of_documents")
    assert {r[0] for r in rows}.isdisjoint(range(0, 5 * len(odd), len(odd)))


def batches(spark):
    """Questions of three batches and routes, and what providers gave for each batch."""
    asked = ["python sdk", "plain docs", "latest news of it", "python sdk"]
    q = spark.createDataFrame([(f"q{k}", k % 3, asked[k % 4]) for k in range(24)], "query_id string, batch long, query string")
    rows = [(b, p, k, f"https://x.org/{k}" + "/" * (p == "github"), f"{p}{k}", None if p == "tavily" else "2024", [p, "all"], "Found.") for b in range(2) for p in ("tavily", "github", "firecrawl") for k in range(b, 30, b + 1)]
    return q, spark.createDataFrame(rows, RESULTS)


def test_candidates_of_a_batch_are_those_of_its_queries(spark):
    q, r = batches(spark)
    budgets = tables.route_budgets(spark)
    shared, _ = providers.search_candidates(q, r, budgets)
    own, _ = providers.search_candidates(q.drop("batch"), q.select("query_id", "batch").join(r, "batch").drop("batch"), budgets)
    seen = lambda t: sorted(map(repr, t.select("query_id", "place", "url", "title", "provider", "published_at", "keywords", "alternates", "reason").collect()))
    assert seen(shared) == seen(own) and shared.count() > 100


def test_traces_count_a_batch_once(spark):
    q, r = batches(spark)
    _, trace = providers.search_candidates(q, r, tables.route_budgets(spark))
    got = {(x.query_id, x.provider): (x.status, x.budget, x.result_count) for x in trace.collect()}
    assert len(got) == trace.count() == 12 * 3 + 12 * 2
    assert got["q0", "github"] == ("fulfilled", 10, 10) and got["q1", "tavily"] == ("fulfilled", 8, 8) and got["q2", "tavily"] == ("rejected", 10, 0)
    # questions meet the trace of their batch and route, none of the results
    text = trace._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < text.index("Aggregate")


def test_sources_are_merged_before_questions_meet_them(spark, tmp_path):
    turns = [(k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for k in range(45) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    urls = ["https://a.org/x", "https://a.org/x/", "https://a.org/x#y", "https://b.org/?q=1", None, "https://c.org"]
    spark.createDataFrame([(k, urls[k // 20 % 6], "") for k in range(300)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(equal_to_sql(spark, tmp_path, "merged_sources", ("conversations", "pages"))) > 90
    plan = entry.queries()["merged_sources"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_words_are_found_where_texts_are_read(spark, monkeypatch):
    r = random.Random(4)
    words = ["alpha", "beta", "al", "rate limits", "limits", "x.org", "zeta", "omega rare", "Ünïcode", "a+b"]
    docs = [(k, None if k % 17 == 0 else " ".join(r.choices(words[: 6 if k % 40 else 10], k=5)), r.choice(["Alpha", "T limits", None]), r.choice([None, "https://x.org"]), 1000 - k) for k in range(400)]
    asked = [(q, r.sample(["ALPHA", "al", "mega", "eta", "limits", "x.o", "rare", "none", "ünï", "", "a+b"], 3), r.sample(["rate limits", "a r", ""], 2)) for q in range(30)]
    want = []
    for q, tokens, phrases in asked:
        found = []
        for chunk, *fields, pos in docs:
            t, h, u = [(f or "").lower() for f in fields]
            points = lambda x, a, b, c: a * (x in h) + b * (x in u) + c * (x in t)
            if any(x and x.lower() in f for x in tokens for f in (t, h, u)):
                found.append((pos, sum(points(x.lower(), 8, 4, 2) for x in tokens if x) + sum(points(x, 25, 10, 8) for x in phrases if x), chunk))
        best = sorted(sorted(found, reverse=True)[:20], key=lambda x: (-x[1], -x[0]))[:6]
        want += [(q, n + 1, chunk, score) for n, (_, score, chunk) in enumerate(best)]
    q = spark.createDataFrame(asked, "query_id int, tokens array<string>, phrases array<string>")
    c = spark.createDataFrame(docs, "chunk_id long, text string, title string, url string, pos long")
    for newest in (50, 1000):  # many queries need older chunks, and none
        monkeypatch.setattr(search, "NEWEST", newest)
        found = search.keyword_search(q, c, 6, 20)
        assert sorted(map(tuple, found.collect())) == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a word


def test_only_questions_without_near_vectors_are_searched_by_words(spark, monkeypatch):
    q = spark.createDataFrame([(1, ["beta"], [1.0, 0.0]), (2, ["beta"], None), (3, ["beta"], [0.0, -1.0])], "query_id int, tokens array<string>, query_vec array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.6, 0.8])], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(k, "alpha beta", f"T{k}", None, k) for k in range(4)], "chunk_id long, text string, title string, url string, pos long")
    asked = []
    whole = search.keyword_search
    monkeypatch.setattr(search, "keyword_search", lambda q, *a: asked.extend(r.query_id for r in q.collect()) or whole(q, *a))
    got = search.search_kb(q, v, c, 1)
    assert sorted(asked) == [2, 3]
    assert [(r.query_id, r.chunk_id, r.retrieval) for r in got.orderBy("query_id").collect()] == [(1, 1, "semantic"), (2, 3, "keyword_fallback"), (3, 3, "keyword_fallback")]


def test_nearest_vectors_by_a_bound(spark, monkeypatch):
    r = random.Random(6)
    rows = [(k, [float(r.randrange(-3, 4)) for _ in range(6)]) for k in range(300)]
    rows += [(300, [0.0] * 6), (301, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (302, [1.0, 2.0]), (303, None), (304, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 30 = 0 or vec_id > 299").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    monkeypatch.setattr(search, "FIRST", 40)
    near = search.semantic_search(q, v, 5)
    assert "least" in near._jdf.queryExecution().optimizedPlan().toString()  # few pairs are sorted
    got = sorted((x.query_id, x.place, x.vec_id, x.score) for x in near.collect())
    monkeypatch.setattr(search, "UNROLLED", 0)
    assert sorted((x.query_id, x.place, x.vec_id, x.score) for x in search.semantic_search(q, v, 5).collect()) == got
    vectors = dict(rows)

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)

    for k in {x[0] for x in got}:
        best = sorted(((c := cosine(vectors[k], b)) is None, -(c or 0), i) for i, b in rows)[:5]
        assert [x[2] for x in got if x[0] == k] == [i for _, _, i in best]
