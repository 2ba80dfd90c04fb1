from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import scores, text


def col(spark, values, f):
    return [r.y for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").orderBy("k").select(f(F.col("x")).alias("y")).collect()]


def test_canonical_urls(spark):
    cases = {
        "https://example.com/page#section": "https://example.com/page",
        "https://example.com/docs/auth/": "https://example.com/docs/auth",
        "https://www.example.com/a": "https://example.com/a",
        "https://Example.com/Auth": "https://example.com/Auth",
        "https://example.com/p?utm_source=twitter&id=1&utm_campaign=test": "https://example.com/p?id=1",
        "https://example.com/p?fbclid=1&gclid=2&msclkid=3&ref=4&source=5&keep=1": "https://example.com/p?keep=1",
        "https://example.com/p?z=1&a=2&m=3": "https://example.com/p?a=2&m=3&z=1",
        "https://example.com/": "https://example.com/",
        "not-a-url": "not-a-url",
    }
    assert col(spark, list(cases), text.canonicalize_url) == list(cases.values())


def test_hash_and_text(spark):
    assert col(spark, ["  Hello \n World "], text.content_hash) == ["0to5x38"]

    def units(t):  # over UTF-16
        raw, h = t.encode("utf-16-be"), 0
        for k in range(0, len(raw), 2):
            h = (31 * h + int.from_bytes(raw[k : k + 2])) % 2**32
        h, out = abs(h - 2**32 if h >= 2**31 else h), ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out.rjust(7, "0")

    assert col(spark, ["a \U0001f642 b", "\U00010000", ""], text.content_hash) == [units("a \U0001f642 b"), units("\U00010000"), "0000000"]
    assert col(spark, ["a [b](http://c) ![d](e) `f` <b>g</b>\n- h\n1. i | j"], text.strip_markdown) == ["a b !d f g h i j"]
    assert col(spark, ["The Graph API and OAuth, The Graph API"], text.extract_entities) == [["The Graph API", "OAuth"]]
    assert col(spark, ["made 2019 or 2024, 1999, 2090"], lambda x: text.infer_year(x, 2025)) == [2024]
    assert col(spark, ["abcdef"], lambda x: text.preview(x, 4)) == ["abcd\n...[truncated 2 chars]"]
    assert col(spark, ['find "rate limits" now'], text.quoted_phrases) == [["rate limits"]]
    assert col(spark, ["https://docs.github.com/x", "https://www.stackoverflow.com", "https://nowhere.example"], text.infer_tier) == ["official_docs", "community", "unknown"]


def test_queries(spark):
    qs = ["compare A vs B", "oauth endpoint", "fix this bug", "how to bake", "weather", "rate limits", "éapi"]
    assert col(spark, qs, Q.infer_use_case) == ["comparison", "api_facts", "implementation_help", "tutorial", "general_research", "general_research", "api_facts"]
    assert col(spark, ["mets graph api", "Facebook Ads API x "], Q.normalize_query) == ["Meta Graph API", "Meta Marketing API x"]
    plan = col(spark, ["latest oauth"], Q.plan_subqueries)[0]
    assert [(p.query, p.priority) for p in plan] == [("latest oauth official docs", 120), ("latest oauth official documentation", 100), ("latest oauth API reference official docs", 90), ("latest oauth permissions rate limits official docs", 80), ("latest oauth latest update changelog", 75)]
    assert [r.kind for r in col(spark, ["python sdk", "latest news", "cats"], Q.provider_route)] == ["code", "freshness", "docs"]
    assert col(spark, ["pros and cons", "set up it", "what is it", "cats"], lambda x: Q.answer_mode(x, Q.infer_use_case(x))) == ["comparison", "how_to", "research_summary", "general"]


def test_claims(spark):
    def quality(claim, tier, section, entities):
        return spark.range(1).select(scores.claim_quality(F.lit(claim), F.lit(tier), F.lit(section), F.array(*map(F.lit, entities)).cast("array<string>")).alias("q")).first().q

    q = quality("The Example API requires an OAuth token with scope read and 2 permissions for every request sent to the endpoint.", "official_docs", "Authentication", ["Example API", "OAuth"])
    assert q.total >= 50 and q.authority == 25 and q.section_quality == 15 and q.specificity >= 10
    q = quality("Click here for more information.", "media", None, [])
    assert q.total < 40 and {"navigation_like", "too_short"} <= set(q.flags)
    rows = [("a claim", "a quote of more than twenty characters", "https://a.b", "official_docs", 0.92), ("a claim", "a quote of more than twenty characters", "https://a.b", "community", 0.58), ("a claim", "", "https://a.b", "official_docs", 0.92), (None, "a quote of more than twenty characters", "https://a.b", "official_docs", 0.92)]
    got = spark.createDataFrame(rows, "c string, q string, u string, t string, s double").select(scores.verify_claim(*map(F.col, "cquts")).alias("v")).collect()
    assert [r.v for r in got] == ["supported", "weak", "unsupported", "unsupported"]
    tries = [(1, 0, 0, 1, None, False), (0, 1, 0, 1, None, True), (0, 0, 1, 0, None, True), (0, 0, 0, 0, "x", True), (0, 0, 0, 0, "", False), (0, 0, 0, 0, None, False)]
    got = spark.createDataFrame(tries, "a int, s int, f int, r int, e string, want boolean").select(scores.should_retry(*map(F.col, "asfre")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)


def test_page_quality(spark):
    good = "# One\n\n" + " ".join(f"word{k} explains" for k in range(40)) + "\n\n## Two\n\ntext\n\n### Three\n"
    code = good + "\n```\nx = 1\n```\n"
    nav = "\n".join(f"https://docs.example.com/page{k}" for k in range(20))
    got = col(spark, [good, code, "Short content.", "# Access Denied\nPlease sign in.", nav], lambda x: scores.page_quality(x, scores.page_features(x)))
    assert got[0].status == "accept" and got[0].score >= 20 and not got[0].flags and got[1].score > got[0].score
    assert got[2].status == "reject" and got[2].flags[0].startswith("low_word_count:") and "blocked_content" in got[3].flags
    assert any(f.startswith("high_nav_ratio:") for f in got[4].flags)
