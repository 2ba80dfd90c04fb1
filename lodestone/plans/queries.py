"""Queries over the driver's tables, one for each operator or plan, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import query as Q
from lodestone.functions import scores, text
from lodestone.operators import answers, evidence, logs, memory, repos, search
from lodestone.sources.tables import scan

#: A tier for each source or host, dealt in turn, so that every branch has rows.
DEALT = "array('official_docs', 'trusted_docs', 'reference_examples', 'community', 'media', 'unknown')"
DEALT_SQL = "['official_docs', 'trusted_docs', 'reference_examples', 'community', 'media', 'unknown']"


def as_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown pages of their source's pack."""
    return scan(spark, d, "documents").selectExpr("source AS pack_id", "concat('https://', lang, '.example.org/', doc_id) AS url", "concat('Document ', doc_id) AS title", "text AS markdown", f"{DEALT}[pmod(doc_id, 6)] AS tier", "doc_id AS pos")


def evidence_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: claims, their quality, near duplicates, verification and coverage of each source."""
    claims = evidence.near_dedupe_claims(evidence.extract_evidence(as_pages(spark, d)))
    return evidence.evidence_coverage(claims)


def claims_extracted(spark: SparkSession, d: str) -> DataFrame:
    e = evidence.extract_evidence(as_pages(spark, d))
    return e.select("pack_id", "url", F.col("claim_pos.no").cast("long").alias("no"), F.sha2("claim", 256).alias("claim_sha"), F.round("confidence", 4).alias("confidence"), F.size("entities").cast("long").alias("n_entities"))


def claims_scored(spark: SparkSession, d: str) -> DataFrame:
    e = evidence.extract_evidence(as_pages(spark, d))
    q = scores.claim_quality(F.col("claim"), F.col("tier"), F.col("section"), F.col("entities"))
    s = e.withColumn("q", q).withColumn("status", scores.verify_claim(F.col("claim"), F.col("quote"), F.col("url"), F.col("tier"), F.col("confidence")))
    return s.groupBy("tier", "status").agg(F.count("*").alias("claims"), F.sum(F.col("q.total").cast("long")).alias("total"), F.sum(F.col("q.specificity").cast("long")).alias("specificity"), F.sum(F.col("q.domain_signal").cast("long")).alias("domain_signal"), F.count_if(F.array_contains("q.flags", "too_short")).alias("too_short"))


def chunked(spark: SparkSession, d: str) -> DataFrame:
    docs = scan(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    c = evidence.chunk_text(docs, "doc_id", "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.md5("chunk_text").alias("chunk_md5"))


def page_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    p = scan(spark, d, "documents").select("doc_id", F.col("text").alias("md")).withColumn("f", scores.page_features(F.col("md")))
    p = p.withColumn("q", scores.page_quality(F.col("md"), F.col("f")))
    return p.select("doc_id", F.col("f.words").cast("long").alias("words"), F.round("f.unique_ratio", 6).alias("unique_ratio"), F.round("f.link_ratio", 6).alias("link_ratio"), F.col("q.score").alias("score"), F.array_join("q.flags", ",").alias("flags"), F.col("q.status").alias("status"))


def quality_by_label(spark: SparkSession, d: str) -> DataFrame:
    labels = scan(spark, d, "labels")
    p = page_quality_scores(spark, d).join(labels, "doc_id")
    return p.groupBy("quality").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("status") == "reject").alias("rejected"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return scan(spark, d, "pages").select("page_id", text.canonicalize_url(u).alias("canonical"), text.normalize_url(u).alias("normalized"), text.hostname(u).alias("host"), text.infer_tier(u).alias("tier"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return scan(spark, d, "documents").select("doc_id", text.content_hash(t).alias("rolling"), text.hash_text(t).alias("sha256"), text.estimate_tokens(t).alias("tokens"), F.md5(text.preview(t, 240)).alias("preview_md5"), F.md5(text.shorten(t, 120)).alias("short_md5"))


def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "pages").select("page_id", logs.html_title(F.col("html"), F.col("url")).alias("title"))


def links_of_pages(spark: SparkSession, d: str) -> DataFrame:
    return logs.page_links(scan(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.min("link").alias("first_link"))


def query_features(spark: SparkSession, d: str) -> DataFrame:
    """User turns, with a few words of the rules mixed in by turn, as questions."""
    add = "array('compare', 'latest pricing', 'oauth error fix', 'how to install sdk', 'version 2025', '')[pmod(conv_id, 6)]"
    q = scan(spark, d, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"concat(text, ' ', {add}) AS query")
    c = F.col("query")
    route = Q.provider_route(c)
    return q.select("conv_id", "turn", Q.infer_use_case(c).alias("use_case"), route["kind"].alias("route"), route["fresh"].alias("route_fresh"), Q.is_freshness_required(c).alias("fresh"), Q.needs_freshness_planner(c).alias("fresh_plan"), Q.answer_mode(c, Q.infer_use_case(c)).alias("mode"), F.size(Q.plan_subqueries(c)).cast("long").alias("n_subqueries"))


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    c = logs.conversation_context(scan(spark, d, "conversations"), 1_500)
    return c.select("conv_id", "turn", "role", F.col("used").cast("long").alias("used"), "truncated")


def conversation_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.message_counts(scan(spark, d, "conversations"))


def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of job transitions: a job for each user and day."""
    status = "CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'click' THEN 'RUNNING' ELSE 'QUEUED' END"
    e = scan(spark, d, "events").selectExpr("concat(user_id, '/', date_format(ts, 'yyyy-MM-dd')) AS job_id", f"{status} AS status", "ts", "event_id AS seq")
    return logs.job_status(e).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    v = scan(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search.semantic_search(q, v.select("vec_id", "embedding"), 5).select("query_id", F.col("place").cast("long").alias("place"), "vec_id", F.round("score", 6).alias("score"))


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as a question, with its first two words as a quoted phrase too, searched in all documents."""
    q = scan(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.col("text"), F.lit(' "'), F.array_join(F.slice(F.split("text", " "), 1, 2), " "), F.lit('"')).alias("q"))
    q = q.select("query_id", search.keyword_tokens(F.col("q"), K.STOPWORDS).alias("tokens"), text.quoted_phrases(F.col("q")).alias("phrases"))
    docs = scan(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat(F.lit("Document of "), "source").alias("title"), F.lit(None).cast("string").alias("url"), F.col("doc_id").alias("pos"))
    return search.keyword_search(q, docs, 5).select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", F.col("score").cast("long").alias("score"))


def diverse_pages(spark: SparkSession, d: str) -> DataFrame:
    """For each language of the url, the ten first pages with at most two of a host before the rest."""
    p = scan(spark, d, "pages").withColumn("host", text.hostname(F.col("url"))).withColumn("lang", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("page_id")))
    return search.select_diverse(p, "lang", 10).select("lang", "page_id", F.col("place").cast("long").alias("place"), "deferred")


def ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages as candidates for questions made of benchmark items."""
    q = scan(spark, d, "benchmark").selectExpr("item_id AS query_id", "concat(text, array(' latest api', ' compare', ' error', ' guide')[pmod(item_id, 4)]) AS query")
    c = scan(spark, d, "pages").selectExpr("page_id AS pos", "url", "concat('Page ', page_id) AS title", "CAST(NULL AS STRING) AS product", "CAST(NULL AS STRING) AS domain", f"{DEALT}[pmod(page_id, 6)] AS tier", "array('api') AS topics", "array('compare', 'guide') AS keywords", "'stored page' AS reason", "if(page_id % 3 = 0, 'registry', 'search') AS source", "timestamp'2024-01-01 00:00:00' - make_dt_interval(CAST(page_id % 1500 AS INT)) AS published_at")
    r = search.rank_sources(q, c, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return r.select("query_id", F.col("place").cast("long").alias("place"), F.col("pos").alias("page_id"), F.col("score").cast("long").alias("score"), "deferred")


def pages_deduped(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages under few urls: what is new, and what repeats a url or a text."""
    p = scan(spark, d, "documents").selectExpr("doc_id AS pos", "concat('https://www.example.org/p', doc_id % 400, '?utm_source=', doc_id) AS url", "text AS markdown")
    return evidence.dedupe_pages(p).select("pos", "status")


def verified(spark: SparkSession, d: str) -> DataFrame:
    e = evidence.extract_evidence(as_pages(spark, d))
    return e.withColumn("status", scores.verify_claim(F.col("claim"), F.col("quote"), F.col("url"), F.col("tier"), F.col("confidence")))


def source_memories(spark: SparkSession, d: str) -> DataFrame:
    m = memory.source_quality_memories(verified(spark, d))
    return m.select("pack_id", "url", "claim_count", "supported_count", F.round("confidence", 4).alias("confidence"))


def citations_of_sources(spark: SparkSession, d: str) -> DataFrame:
    c = answers.citations(verified(spark, d).where("status != 'unsupported'"))
    return c.select("pack_id", F.col("id").cast("long").alias("id"), "url", "tier", "used_claims")


def answer_confidences(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_confidence(verified(spark, d))


def memory_effects(spark: SparkSession, d: str) -> DataFrame:
    """Pages scored by memories of all sources of documents: quality, failure or fact by turn, on the pages' own hosts."""
    p = scan(spark, d, "pages")
    host = text.hostname(F.col("url"))
    m = p.groupBy(host.alias("host")).agg(F.min("page_id").alias("id")).selectExpr("id", "array('source_quality', 'source_failure', 'durable_fact')[pmod(id, 3)] AS kind", "0.5 + (id % 7) / 20 AS confidence", "array(concat('https://', host, '/any')) AS source_urls", "array('Nowhere Else', concat('Part ', id % 5)) AS entities")
    out = memory.memory_deltas(p.selectExpr("page_id AS pos", "url", "concat('A part ', page_id % 9, ' of many') AS title"), m)
    return out.select(F.col("pos").alias("page_id"), F.col("delta").cast("long").alias("delta"), F.size("matched").cast("long").alias("memories"))


def repo_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages' paths as files of their host's repository."""
    f = scan(spark, d, "pages").select("page_id", text.hostname(F.col("url")).alias("repo"), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1).alias("p"))
    f = f.select("repo", F.concat(F.expr("array('docs/', 'apps/api/', '', 'packages/')[pmod(page_id, 4)]"), "p", F.expr("array('/index.ts', '.md', '.py', '.txt', '/package.json')[pmod(page_id, 5)]")).alias("path"))
    return repos.select_repo_files(f, 5).select("repo", "path", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (evidence_by_source, claims_extracted, claims_scored, chunked, page_quality_scores, quality_by_label, canonical_urls, content_hashes, html_titles, links_of_pages, query_features, context_windows, conversation_counts, job_states, vector_search, keyword_hits, diverse_pages, ranked_sources, pages_deduped, source_memories, citations_of_sources, answer_confidences, memory_effects, repo_files)
}

WS = r"\s"
TRIM = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"


def rx(alternatives: str) -> str:
    return rf"(?i)\b(?:{alternatives})\b"


_FEATURES = rf"""
WITH d AS (SELECT doc_id, text AS md, regexp_split_to_array(text, '\s+') AS parts, regexp_split_to_array(lower(text), '\s+') AS low, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS ls FROM documents),
f AS (
  SELECT doc_id, md, len(list_filter(parts, lambda w: w <> '' AND NOT regexp_matches(w, '^[#\-*|\[\]()>]+\z'))) AS words, length(md) AS chars,
    list_filter(list_transform(low, lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2) AS plain,
    len(ls) AS nl, len(list_filter(ls, lambda x: regexp_matches(x, '^(?i)https?://') OR regexp_matches(x, '^\[.*?\]\(') OR regexp_matches(x, '^\|.*\|\z'))) AS links,
    len(regexp_extract_all(md, '(?m)^#{{1,6}}\s')) AS headings, len(regexp_extract_all(md, '```')) / 2 AS code FROM d),
g AS (SELECT *, CASE WHEN len(plain) = 0 THEN 0.0 ELSE len(list_distinct(plain)) / len(plain) END AS u, CASE WHEN nl = 0 THEN 0.0 ELSE links / nl END AS l, regexp_matches(md, '{rx(K.BLOCKED_PAGE)}') AS blocked FROM f),
s AS (
  SELECT *, least(100.0, CASE WHEN words >= 30 THEN least(25.0, floor(words * 0.08::DOUBLE + 0.5)) ELSE 0 END + CASE WHEN chars > 500 THEN least(10.0, floor(chars * 0.005::DOUBLE + 0.5)) ELSE 0 END
    + CASE WHEN u > 0.3 THEN least(15.0, floor(u * 30 + 0.5)) ELSE 0 END + CASE WHEN l <= 0.45 THEN least(10.0, floor((1 - l) * 15 + 0.5)) ELSE 0 END + least(10.0, headings * 3.0) + least(8.0, code * 4.0)) AS score FROM g),
q AS (
  SELECT doc_id, words::BIGINT AS words, round(u::DOUBLE, 6) AS unique_ratio, round(l::DOUBLE, 6) AS link_ratio, score::DOUBLE AS score,
    array_to_string(list_filter([CASE WHEN words < 30 THEN 'low_word_count:' || words END, CASE WHEN chars < 200 THEN 'low_char_count:' || chars END, CASE WHEN u < 0.15 THEN 'low_unique_word_ratio:' || printf('%.2f', u::DOUBLE) END, CASE WHEN l > 0.45 THEN 'high_nav_ratio:' || printf('%.2f', l::DOUBLE) END, CASE WHEN blocked THEN 'blocked_content' END], lambda x: x IS NOT NULL), ',') AS flags,
    CASE WHEN words < 30 OR chars < 200 OR l > 0.45 OR u < 0.15 OR blocked OR score < 20 THEN 'reject' ELSE 'accept' END AS status FROM s)
"""

_STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)```.*?```', ' ', 'g'), '`([^`]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '\|', ' ', 'g')"
STRIP = TRIM.format("regexp_replace(" + _STRIP + r", '\s+', ' ', 'g')")
_CLAIM_HIT = " OR ".join(f"contains(' ' || lower(c) || ' ', '{w}')" for w in K.CLAIM_WORDS)
_TECH = " + ".join(f"contains(lower(c), '{t}')::INT" for t in K.TECH_TERMS)
_CONF = "CASE tier " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in K.TIER_CONFIDENCE.items()) + " END"
_AUTH = "CASE tier " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in K.TIER_AUTHORITY.items()) + " END"

#: The claims of documents as pages: these hold no headings, so each is one section "Page".
_CLAIMS = rf"""
WITH p AS (SELECT source AS pack_id, 'https://' || lang || '.example.org/' || doc_id AS url, {DEALT_SQL}[doc_id % 6 + 1] AS tier, doc_id AS pos, {TRIM.format('text')} AS t FROM documents),
a AS (
  SELECT pack_id, url, tier, pos, regexp_extract_all({STRIP.format('t')}, '[^.!?]+[.!?]+(?:\s|\z)|[^.!?]+\z') AS s, list_transform(string_split(t, chr(10)), lambda x: {TRIM.format('x')}) AS ls FROM p),
b AS (SELECT pack_id, url, tier, pos, list_concat(s, list_filter(ls, lambda x: regexp_matches(x, '^[-*+]\s+') OR regexp_matches(x, '^\d+\.\s+')), list_filter(ls, lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[-\s|:]+\z'))) AS cs FROM a),
c0 AS (SELECT pack_id, url, tier, pos, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM b),
c1 AS (SELECT pack_id, url, tier, pos, i, {STRIP.format('c')} AS c FROM c0),
c2 AS (SELECT pack_id, url, tier, pos, c, min(i) AS i FROM c1 WHERE length(c) BETWEEN 45 AND 520 GROUP BY ALL),
c3 AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) - 1 AS no FROM c2),
c4 AS (SELECT *, row_number() OVER (PARTITION BY pos, lower(c) ORDER BY no) AS n FROM c3 WHERE NOT regexp_matches(c, '^(?i)(home|next|previous|skip to|copyright|privacy|terms)\b') AND ({_CLAIM_HIT})),
c5 AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY no) AS k FROM c4 WHERE n = 1),
claims AS (SELECT pack_id, url, tier, pos, no, c, {_CONF}::DOUBLE AS confidence FROM c5 WHERE k <= 30)
"""
#: Claims with the parts of their quality, and what verifies them.
_SCORED_TAIL = """, n AS (SELECT *, len(regexp_split_to_array(c, '\\s+')) AS w, ({tech}) AS hits, len(regexp_extract_all(c, '\\b[A-Z][A-Za-z0-9.]*(?:\\s+[A-Z][A-Za-z0-9.]*){{0,3}}\\b')) AS found, {auth} AS authority,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(c, '{ent}'), lambda x: {trim}), lambda x: x <> ''))) AS named0,
  len(list_filter(list_distinct(list_transform(regexp_extract_all(c, '{ent}'), lambda x: {trim})), lambda e: length(e) > 2)) AS named FROM claims),
s AS (
  SELECT *, least(30, CASE WHEN regexp_matches(c, '[0-9]') THEN 8 ELSE 0 END + CASE WHEN found >= 3 THEN 10 WHEN found = 2 THEN 7 WHEN found = 1 THEN 3 ELSE 0 END + CASE WHEN hits >= 3 THEN 7 WHEN hits = 2 THEN 4 WHEN hits = 1 THEN 2 ELSE 0 END + CASE WHEN length(c) >= 140 THEN 5 WHEN length(c) >= 90 THEN 3 ELSE 0 END) AS specificity,
    CASE WHEN hits / w >= 0.15 THEN 20 WHEN hits / w >= 0.08 THEN 14 WHEN hits >= 3 THEN 10 WHEN hits = 2 THEN 6 WHEN hits = 1 THEN 3 ELSE 0 END AS domain_signal,
    CASE WHEN least(10, named) / w >= 0.12 THEN 10 WHEN least(10, named) / w >= 0.06 THEN 6 WHEN named >= 2 THEN 4 WHEN named = 1 THEN 2 ELSE 0 END AS density,
    CASE WHEN confidence >= 0.75 OR (tier IN ('official_docs', 'trusted_docs') AND confidence >= 0.7) THEN 'supported' WHEN confidence >= 0.55 THEN 'weak' ELSE 'unsupported' END AS status FROM n),
t AS (SELECT *, specificity + authority + 5 + domain_signal + density AS total, regexp_matches({low}, '^(click|read|learn|see|visit|go to|check out|find out|skip to)') AS nav FROM s),
scored AS (SELECT *, CASE WHEN nav THEN least(total, 20) ELSE total END AS quality FROM t)"""
_ENT = r"\b[A-Z][A-Za-z0-9.+#-]*(?:\s+[A-Z][A-Za-z0-9.+#-]*){0,4}\b"

_SCORED = _CLAIMS + _SCORED_TAIL.format(tech=_TECH, auth=_AUTH, ent=_ENT, trim=TRIM.format("x"), low=TRIM.format("lower(c)"))

_QUERY_TEXT = r"text || ' ' || ['compare', 'latest pricing', 'oauth error fix', 'how to install sdk', 'version 2025', ''][conv_id % 6 + 1]"
_USE = f"CASE WHEN regexp_matches(q, '{rx(K.COMPARISON)}') THEN 'comparison' WHEN regexp_matches(q, '{rx(K.API_FACTS)}') THEN 'api_facts' WHEN regexp_matches(q, '{rx(K.IMPLEMENTATION)}') THEN 'implementation_help' WHEN regexp_matches(q, '{rx(K.TUTORIAL)}') THEN 'tutorial' ELSE 'general_research' END"

_STATUS = "CASE WHEN confidence >= 0.75 OR (tier IN ('official_docs', 'trusted_docs') AND confidence >= 0.7) THEN 'supported' WHEN confidence >= 0.55 THEN 'weak' ELSE 'unsupported' END"
_TRUST = "CASE tier " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in K.TIER_MEMORY_CONFIDENCE.items()) + " END"

#: Links to follow, from the rules: absolute, no fragment or trailing slash, http(s), own host, none of seven parts.
_LINKS = r"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS origin, unnest(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda x: substring(x, 2, length(x) - 2))) AS href FROM pages),
p AS (SELECT *, regexp_extract(substring(url, length(origin) + 1), '^[^?#]*') AS path FROM h WHERE href <> ''),
f AS (SELECT page_id, origin, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-zA-Z]+:') || href WHEN starts_with(href, '/') THEN origin || href
  WHEN starts_with(href, '?') OR starts_with(href, '#') THEN origin || path || href ELSE origin || regexp_replace(path, '/[^/]*\z', '') || '/' || href END AS link FROM p),
b AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(link, '#.*', ''), '/+\z', '') AS link FROM f
  WHERE regexp_matches(link, '^(?i)https?://') AND regexp_extract(link, '^[a-zA-Z]+://([^/?#]*)', 1) = regexp_extract(origin, '^[a-zA-Z]+://([^/?#]*)', 1)
  AND len(list_filter(['/login', '/signin', '/signup', '/cart', '/checkout', 'utm_', 'mailto:'], lambda x: contains(lower(regexp_replace(regexp_replace(link, '#.*', ''), '/+\z', '')), x))) = 0)
"""

#: Chunks of a text, window by window.
_CHUNKS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {TRIM.format("regexp_replace(@text@, chr(10) || '{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS t FROM documents),
w AS (
  SELECT doc_id, t, 0 AS s, least(700, length(t)) AS hard FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, greatest(0, e - 200), least(greatest(0, e - 200) + 700, length(t)) FROM (
    SELECT doc_id, t, CASE WHEN b > 0 THEN s + 385 + length(x) - b ELSE hard END AS e FROM (
      SELECT *, instr(reverse(x), chr(10) || chr(10)) AS b FROM (SELECT doc_id, t, s, hard, substring(t, s + 387, hard - s - 384) AS x FROM w))) WHERE e < length(t)),
v AS (
  SELECT doc_id, s, CASE WHEN b > 0 THEN s + 385 + length(x) - b ELSE hard END AS e, t FROM (
    SELECT *, instr(reverse(x), chr(10) || chr(10)) AS b FROM (SELECT doc_id, t, s, hard, substring(t, s + 387, hard - s - 384) AS x FROM w))),
c AS (SELECT doc_id, s, e, {TRIM.format('substring(t, s + 1, e - s)')} AS chunk FROM v)"""

ORACLES: dict[str, str] = {
    "source_memories": _CLAIMS + f", s AS (SELECT *, {_STATUS} AS status FROM claims) SELECT pack_id, url, count(*) AS claim_count, count(*) FILTER (status = 'supported') AS supported_count, round(least(0.95, max({_TRUST})::DOUBLE + least(count(*) FILTER (status = 'supported'), 5) * 0.01::DOUBLE), 4) AS confidence FROM s GROUP BY pack_id, url",
    "citations_of_sources": _CLAIMS + f", s AS (SELECT *, {_STATUS} AS status FROM claims) SELECT pack_id, row_number() OVER (PARTITION BY pack_id ORDER BY min(pos)) AS id, url, tier, count(*) AS used_claims FROM s WHERE status <> 'unsupported' GROUP BY pack_id, url, tier",
    "answer_confidences": _CLAIMS + f", s AS (SELECT *, {_STATUS} AS status FROM claims) SELECT pack_id, least(0.98, round(coalesce(avg(confidence) FILTER (status = 'supported'), avg(confidence)) * 0.8 + count(*) FILTER (status = 'supported') / count(*) * 0.2, 2)) AS confidence FROM s GROUP BY pack_id",
    "memory_effects": r"""
WITH p AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\.', '')) AS host, 'a part ' || page_id % 9 || ' of many' AS title FROM pages),
m AS (SELECT min(page_id) AS id, host FROM p GROUP BY host),
n AS (SELECT *, id % 3 AS kind, least(1.0, greatest(0.1, 0.5 + (id % 7) / 20)) AS c FROM m)
SELECT p.page_id, sum(CASE kind WHEN 0 THEN floor(18 * c + 0.5) WHEN 1 THEN -floor(30 * c + 0.5) ELSE floor(5 * c + 0.5) END)::BIGINT AS delta, count(*) AS memories
FROM p JOIN n ON CASE WHEN kind = 2 THEN contains(title, 'part ' || id % 5) ELSE p.host = n.host OR ends_with(p.host, '.' || n.host) OR ends_with(n.host, '.' || p.host) END GROUP BY p.page_id
""",
    "repo_files": r"""
WITH f AS (SELECT lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '')) AS repo, ['docs/', 'apps/api/', '', 'packages/'][page_id % 4 + 1] || regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) || ['/index.ts', '.md', '.py', '.txt', '/package.json'][page_id % 5 + 1] AS path FROM pages),
r AS (SELECT *, lower(path) AS x FROM f),
k AS (SELECT *, CASE WHEN x = 'readme.md' THEN 1000 WHEN x = 'package.json' THEN 950 WHEN ends_with(x, '/package.json') THEN 880 WHEN ends_with(x, 'dockerfile') THEN 820 WHEN starts_with(x, 'docs/') THEN 760
  WHEN regexp_matches(x, '^(apps|packages)/') AND regexp_matches(x, '(main|server|router|service|schema|client|index)\.(ts|tsx|js|py)$') THEN 720 WHEN regexp_matches(x, '\.(ts|tsx|js|py|md|prisma|yml|yaml|json)$') THEN 200 ELSE 0 END AS rank FROM r)
SELECT repo, path, rank::BIGINT AS rank, place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank DESC, path) AS place FROM k WHERE rank > 0) WHERE place <= 5
""",
    "claims_extracted": _CLAIMS
    + rf"""SELECT pack_id, url, no::BIGINT AS no, sha256(c) AS claim_sha, round(confidence, 4) AS confidence, least(10, len(list_distinct(list_filter(list_transform(regexp_extract_all(c, '{_ENT}'), lambda x: {TRIM.format('x')}), lambda x: x <> ''))))::BIGINT AS n_entities FROM claims""",
    "claims_scored": _SCORED
    + rf""" SELECT tier, status, count(*) AS claims, sum(quality)::BIGINT AS total, sum(specificity)::BIGINT AS specificity, sum(domain_signal)::BIGINT AS domain_signal, count(*) FILTER (length({TRIM.format('lower(c)')}) < 60) AS too_short FROM scored GROUP BY tier, status""",
    "evidence_by_source": _SCORED.replace("WITH p AS", "WITH RECURSIVE p AS", 1)
    + rf""", ok AS (SELECT pack_id, row_number() OVER (PARTITION BY pack_id ORDER BY quality DESC, pos, no, url) AS k, url, tier, status, list_distinct(list_filter(regexp_split_to_array(lower(c), '\s+'), lambda w: length(w) > 2)) AS w FROM scored WHERE quality >= 40 AND named0 > 0),
x AS MATERIALIZED (SELECT b.pack_id, b.k, list(a.k) AS near FROM ok a JOIN ok b ON a.pack_id = b.pack_id AND a.k < b.k
  WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.7::DOUBLE GROUP BY ALL),
r AS (
  SELECT DISTINCT pack_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM ok
  UNION ALL
  SELECT r.pack_id, o.k, CASE WHEN list_has_any(coalesce(x.near, []), r.kept) THEN r.kept ELSE list_append(r.kept, o.k) END FROM r JOIN ok o ON o.pack_id = r.pack_id AND o.k = r.k + 1 LEFT JOIN x ON x.pack_id = o.pack_id AND x.k = o.k),
f AS (SELECT pack_id, arg_max(kept, k) AS kept FROM r GROUP BY pack_id),
g AS (SELECT ok.* FROM ok JOIN f USING (pack_id) WHERE list_contains(f.kept, ok.k)),
n1 AS (SELECT pack_id, count(*) AS raw_claims, count(*) FILTER (NOT (quality >= 40 AND named0 > 0)) AS quality_rejected FROM scored GROUP BY pack_id),
n2 AS (SELECT pack_id, count(*) AS kept_claims, count(DISTINCT url) AS unique_sources, count(DISTINCT url) FILTER (tier IN ('official_docs', 'trusted_docs')) AS official_sources, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'weak') AS weak, count(*) FILTER (status = 'unsupported') AS unsupported FROM g GROUP BY pack_id)
SELECT n1.pack_id, raw_claims, coalesce(kept_claims, 0) AS kept_claims, quality_rejected, raw_claims - quality_rejected - coalesce(kept_claims, 0) AS duplicate_rejected, coalesce(unique_sources, 0) AS unique_sources, coalesce(official_sources, 0) AS official_sources, coalesce(supported, 0) AS supported, coalesce(weak, 0) AS weak, coalesce(unsupported, 0) AS unsupported
FROM n1 LEFT JOIN n2 ON n1.pack_id IS NOT DISTINCT FROM n2.pack_id""",
    "ranked_sources": rf"""
WITH q AS (SELECT item_id AS query_id, text || [' latest api', ' compare', ' error', ' guide'][item_id % 4 + 1] AS q FROM benchmark),
u AS (SELECT query_id, lower(q) AS low, {_USE} AS use_case, regexp_matches(q, '{rx(K.FRESH_QUERY)}') AS fresh FROM q),
c AS (SELECT page_id, url, {DEALT_SQL}[page_id % 6 + 1] AS tier, page_id % 3 = 0 AS registry, (152 + page_id % 1500) / 365 AS age, regexp_matches('Page ' || page_id || ' ' || url || ' stored page compare guide', '{rx(K.DEPRECATED)}') AS old FROM pages),
m(use_case, tier, points) AS (VALUES {", ".join(f"('{use}', '{t}', {n})" for t, ns in K.TIER_USE_CASE.items() for use, n in zip(K.USE_CASES, ns))}),
s AS (
  SELECT query_id, page_id, url, points + 25 * (contains(low, 'compare')::INT + contains(low, 'guide')::INT) + 15 * contains(low, 'api')::INT + 10 * registry::INT - 24 * old::INT
    + CASE WHEN age <= 0.75::DOUBLE THEN CASE WHEN fresh THEN 18 ELSE 6 END WHEN age <= 2 THEN CASE WHEN fresh THEN 10 ELSE 3 END WHEN fresh THEN CASE WHEN tier = 'official_docs' THEN -8 ELSE -18 END ELSE 0 END AS score
  FROM u, c JOIN m USING (tier) WHERE m.use_case = u.use_case),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(regexp_replace(url, '#.*', ''), '/(\?|$)', '\1') ORDER BY score DESC, page_id) AS n FROM s WHERE score >= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank, lower(regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\.', '')) AS host FROM k WHERE n = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY rank) > 2 AS deferred FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS place FROM d)
SELECT query_id, place, page_id, score::BIGINT AS score, deferred FROM o WHERE place <= 10
""",
    "links_of_pages": _LINKS + "SELECT page_id, count(*) AS links, min(link) AS first_link FROM b GROUP BY page_id",
    "page_quality_scores": _FEATURES + "SELECT * FROM q",
    "quality_by_label": _FEATURES + "SELECT quality, count(*) AS documents, round(avg(score), 6) AS mean_score, count(*) FILTER (status = 'reject') AS rejected FROM q JOIN labels USING (doc_id) GROUP BY quality",
    "chunked": _CHUNKS.replace("@text@", "replace(text, chr(10), chr(10) || chr(10))") + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s::BIGINT AS start_char, e::BIGINT AS end_char, md5(chunk) AS chunk_md5 FROM c WHERE chunk <> ''
""",
    "content_hashes": rf"""
WITH n AS (SELECT doc_id, text, lower({TRIM.format(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS s, {TRIM.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS one FROM documents),
h AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE list_reduce(list_prepend(0::BIGINT, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + (unicode(c) - 65536)::BIGINT // 1024, 56320 + (unicode(c) - 65536)::BIGINT % 1024] END))), lambda a, c: (a * 31 + c) & 4294967295) END AS h FROM n),
a AS (SELECT *, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS v FROM h)
SELECT doc_id, lpad(list_reduce(list_prepend('', list_transform(range(7), lambda k: substring('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36 ** (6 - k))::BIGINT) % 36 + 1)::INT, 1))), lambda x, y: x || y), 7, '0') AS rolling,
  sha256(text) AS sha256, ceil(length(text) / 4)::BIGINT AS tokens,
  md5(CASE WHEN length(text) <= 240 THEN text ELSE substring(text, 1, 240) || chr(10) || '...[truncated ' || (length(text) - 240) || ' chars]' END) AS preview_md5,
  md5(CASE WHEN length(one) <= 120 THEN one ELSE substring(one, 1, 117) || '...' END) AS short_md5 FROM a
""",
    "canonical_urls": r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'ref', 'source')) AS ps FROM p)
SELECT page_id, lower(scheme) || '://' || regexp_replace(lower(host), '^www\.', '') || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_sort(ps), '&') ELSE '' END AS canonical,
  scheme || '://' || host || regexp_replace(path, '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized, lower(regexp_replace(host, '^www\.', '')) AS host, 'unknown' AS tier FROM q
""",
    "html_titles": rf"SELECT page_id, coalesce(nullif({TRIM.format(chr(114) + 'x')}, ''), url) AS title FROM (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS rx FROM pages)",
    "query_features": f"""
WITH s AS (SELECT conv_id, turn, {_QUERY_TEXT} AS q FROM conversations WHERE role = 'user'),
u AS (SELECT *, {_USE} AS use_case, regexp_matches(q, '{rx(K.FRESH_PLAN)}') AS fresh_plan, regexp_matches(q, '{rx(K.FRESH_QUERY)}') AS fresh, regexp_matches(q, '{rx(K.CODE_QUERY)}') AS code FROM s)
SELECT conv_id, turn, use_case, CASE WHEN code THEN 'code' WHEN fresh THEN 'freshness' ELSE 'docs' END AS route, NOT code AND fresh AS route_fresh, fresh, fresh_plan,
  CASE WHEN use_case = 'comparison' OR regexp_matches(q, '{rx(K.MODE_COMPARISON)}') THEN 'comparison' WHEN use_case IN ('implementation_help', 'tutorial') OR regexp_matches(q, '{rx(K.MODE_HOW_TO)}') THEN 'how_to' WHEN regexp_matches(q, '{rx(K.MODE_SUMMARY)}') THEN 'research_summary' ELSE 'general' END AS mode,
  (CASE WHEN use_case IN ('api_facts', 'comparison') THEN 4 WHEN use_case = 'implementation_help' THEN 3 ELSE 2 END + fresh_plan::INT)::BIGINT AS n_subqueries FROM u
""",
    "context_windows": "SELECT conv_id, turn, role, used::BIGINT AS used, total > 1500 AS truncated FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, sum(cost) OVER (PARTITION BY conv_id) AS total FROM (SELECT *, length(text) + length(role) + 20 AS cost FROM conversations)) WHERE used <= 1500",
    "conversation_counts": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "job_states": """
WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS job_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'RUNNING' ELSE 'QUEUED' END AS status, ts, event_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY job_id) AS transitions, count(*) FILTER (status = 'FAILED') OVER (PARTITION BY job_id) AS failures FROM e)
SELECT job_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, transitions, failures, status IN ('COMPLETED', 'FAILED') AS terminal FROM r WHERE n = 1
""",
    "vector_search": """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
SELECT query_id, place, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5
""",
    "keyword_hits": rf"""
WITH q AS (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS p, text FROM benchmark),
c AS (SELECT item_id, lower(p) AS phrase, {TRIM.format('lower(p)')} AS p, list_filter(regexp_split_to_array(regexp_replace(lower(p), '[^a-z0-9.+#\s-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2) AS a,
  list_filter(regexp_split_to_array(regexp_replace(lower(text || ' "' || p || '"'), '[^a-z0-9.+#\s-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2 AND NOT list_contains({K.STOPWORDS}, t)) AS b FROM q),
l AS (SELECT item_id, p, list_concat(a, b) AS ts FROM c),
u AS (SELECT item_id, p, unnest(ts) AS w, unnest(range(len(ts))) AS i FROM l),
o AS (SELECT item_id, p, w, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS n FROM u GROUP BY item_id, p, w),
t AS (SELECT item_id, w, 8 AS ph, 2 AS pt, 1 AS token FROM o WHERE n <= 12 UNION ALL SELECT DISTINCT item_id, p, 25, 8, 0 FROM o WHERE p <> ''),
d AS (SELECT doc_id, lower(text) AS t, coalesce('document of ' || lower(source), '') AS h FROM documents),
s AS (SELECT item_id, doc_id, sum(ph * contains(h, w)::INT + pt * contains(t, w)::INT) AS score, max(token) AS hit FROM t JOIN d ON contains(h, w) OR contains(t, w) GROUP BY item_id, doc_id),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS n FROM s WHERE hit = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS place FROM n WHERE n <= 40)
SELECT item_id AS query_id, place, doc_id AS chunk_id, score::BIGINT AS score FROM r WHERE place <= 5
""",
    "diverse_pages": r"""
WITH p AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '')) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, host ORDER BY page_id) > 2 AS deferred FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY deferred, page_id) AS place FROM r)
SELECT lang, page_id, place, deferred FROM s WHERE place <= 10
""",
    "pages_deduped": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, (doc_id % 400)::VARCHAR AS u, md5(lower(regexp_replace(regexp_replace(text, '^\s+|\s+\z', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents),
r AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS pos, NULL::VARCHAR AS status, []::VARCHAR[] AS us, []::VARCHAR[] AS hs
  UNION ALL
  SELECT d.k, d.doc_id, CASE WHEN list_contains(us, u) THEN 'duplicate_url' WHEN list_contains(hs, h) THEN 'duplicate_content' ELSE 'new' END,
    CASE WHEN list_contains(us, u) OR list_contains(hs, h) THEN us ELSE list_append(us, u) END, CASE WHEN list_contains(us, u) OR list_contains(hs, h) THEN hs ELSE list_append(hs, h) END
  FROM r JOIN d ON d.k = r.k + 1)
SELECT pos, status FROM r WHERE pos IS NOT NULL
""",
}
