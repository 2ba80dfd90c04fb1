"""From verified claims to answers: the claims to print, citations, confidence and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.checks import numeric_dump  # noqa: F401  (part of this module's interface)
from lodestone.functions.query import answer_mode
from lodestone.functions.scores import by_tier
from lodestone.functions.text import query_tokens, shorten, trim_all


def answer_evidence(queries: DataFrame, claims: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` best claims of each pack for ``queries(pack_id, query)``; unsupported ones go, each url and claim counts once."""
    c = claims.where("status != 'unsupported'").withColumn("key", F.lower(trim_all(F.regexp_replace("claim", r"\s+", " "))))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("pack_id", "url", "key").orderBy("claim_pos"))).where("n = 1").drop("n", "key")
    own = F.concat_ws(" ", "claim", "section", F.array_join("entities", " "))
    overlap = F.size(F.array_intersect(query_tokens(own, 2), query_tokens(F.col("query"), 2)))
    score = F.when(F.col("status") == "supported", 40).otherwise(12) + F.col("confidence") * 35 + by_tier(K.TIER_ANSWER_WEIGHT, F.col("tier")) + overlap * 3
    j = c.join(queries, "pack_id").withColumn("score", score)
    return j.withColumn("place", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.desc("score"), "claim_pos"))).where(F.col("place") <= most)


def source_key() -> Column:
    """What tells sources apart: their url, else title and tier."""
    return F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit(":"), F.coalesce("tier", F.lit(""))))


def keyed_citations(rows: DataFrame, order: str) -> DataFrame:
    g = rows.withColumn("key", source_key()).groupBy("pack_id", "key").agg(F.min_by(F.struct("url", "title", "tier"), order).alias("x"), F.min(order).alias("at"), F.count("*").alias("used_claims"))
    return g.select("pack_id", "key", F.row_number().over(Window.partitionBy("pack_id").orderBy("at")).alias("id"), "x.*", "used_claims")


def citations(rows: DataFrame, order: str = "claim_pos") -> DataFrame:
    """``pack_id, id, url, title, tier, used_claims``: sources in order of first sight, numbered from 1; without a url, by title and tier."""
    return keyed_citations(rows, order).drop("key")


def answer_confidence(rows: DataFrame) -> DataFrame:
    """``pack_id, confidence``: the mean of supported claims (of all without any) for 80 %, their share for 20 %, at most .98."""
    yes = F.col("status") == "supported"
    mean = F.coalesce(F.avg(F.when(yes, F.col("confidence"))), F.avg("confidence"))
    return rows.groupBy("pack_id").agg(F.least(F.lit(0.98), F.round(mean * 0.8 + F.count_if(yes) / F.count("*") * 0.2, 2)).alias("confidence"))


def claim_line(most: int) -> Column:
    """A claim as an answer prints it: shortened, marked where it is weak, with its citation."""
    return F.concat(F.when(F.col("status") == "weak", "Likely: ").otherwise(""), shorten(F.col("claim"), most), F.coalesce(F.concat(F.lit(" ["), F.col("id").cast("string"), F.lit("]")), F.lit("")))


def topic_table(rows: DataFrame, topics: int = 4, each: int = 3) -> DataFrame:
    """``pack_id, body``: a row for each of the first topics (the product, domain, first entity or title) with its first claims; ``rows`` in order of ``place``."""
    said = lambda c: F.nullif(c, F.lit(""))
    topic = F.coalesce(*[said(F.col(c)) for c in ("product", "domain") if c in rows.columns], said(F.get("entities", 0)), said(F.col("title")), F.lit("Other"))
    r = rows.withColumn("topic", topic).withColumn("n", F.row_number().over(Window.partitionBy("pack_id", "topic").orderBy("place"))).where(F.col("n") <= each)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", claim_line(140).alias("t")))), lambda x: x.t), "<br>")
    g = r.groupBy("pack_id", "topic").agg(F.min("place").alias("at"), line.alias("points"))
    g = g.withColumn("k", F.row_number().over(Window.partitionBy("pack_id").orderBy("at"))).where(F.col("k") <= topics)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("| "), "topic", F.lit(" | "), "points", F.lit(" |")).alias("t")))), lambda x: x.t)
    return g.groupBy("pack_id").agg(F.concat(F.lit("| Topic | Evidence-backed points |\n|---|---|\n"), F.array_join(lines, "\n")).alias("body"))


def synthesize_answers(queries: DataFrame, claims: DataFrame, most: int | None = None) -> DataFrame:
    """``pack_id, status, mode, markdown, citations, row_urls, confidence, supported, weak`` for ``queries(pack_id, query, use_case)``.

    ``claims`` are kept, verified ones. The best claims of a pack are printed in the layout of the query's mode: at most ``most``
    (14 for comparisons and 10 for others, by default), so a pack's answer is one row of bounded size. Packs without claims have the status
    insufficient_evidence, and print the gaps in ``missing`` where queries have it. Sources without a url are told apart by title and tier.
    """
    q = queries.withColumn("mode", answer_mode(F.col("query"), F.col("use_case")))
    limit = F.lit(most) if most else F.when(F.col("mode") == "comparison", 14).otherwise(10)
    rows = answer_evidence(q.select("pack_id", "query", "mode"), claims, most or 14).where(F.col("place") <= limit)
    cites = keyed_citations(rows, "place")
    rows = rows.withColumn("key", source_key()).join(cites.select("pack_id", "key", "id"), ["pack_id", "key"], "left")
    in_order = lambda t: F.transform(F.array_sort(F.collect_list(F.struct("place", t.alias("t")))), lambda x: x.t)
    note = F.concat(F.col("status"), F.lit(" evidence from "), F.coalesce("title", F.lit("")), F.when(F.col("section") != "", F.concat(F.lit(', section "'), "section", F.lit('"'))).otherwise(""), F.lit(': "'), shorten(F.col("quote"), 220), F.lit('"'))
    of = lambda n, mode: F.when(F.col("mode") == mode, claim_line(n))
    line = F.coalesce(of(260, "comparison"), of(280, "how_to"), of(260, "research_summary"), claim_line(320))
    g = rows.groupBy("pack_id", "mode").agg(
        in_order(line).alias("lines"), in_order(note).alias("notes"), in_order(F.col("url")).alias("row_urls"), F.count_if(F.col("status") == "supported").alias("supported"), F.count_if(F.col("status") == "weak").alias("weak")
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "title", "url"))), lambda c: c)
    g = g.join(cites.groupBy("pack_id").agg(listed.alias("citations")), "pack_id").join(answer_confidence(rows), "pack_id").join(topic_table(rows), "pack_id")
    answered = F.col("supported") > 0
    intro = F.coalesce(*[F.when(F.col("mode") == m, F.when(answered, a).otherwise(b)) for m, (a, b) in K.INTROS.items()])
    intro = F.when((F.col("mode") == "general") & answered, F.format_string("Based on %d supported claim(s) from %d source(s), here is the grounded answer.", "supported", F.size("citations"))).otherwise(intro)
    numbered = lambda c, n: F.array_join(F.transform(F.slice(c, 1, n), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    bullets = F.array_join(F.transform(F.slice("lines", 1, 6), lambda t: F.concat(F.lit("- "), t)), "\n")
    part = lambda head, body: F.concat(F.lit(f"## {head}\n"), body)
    middle = (
        F.when(F.col("mode") == "comparison", F.concat_ws("\n", part("Comparison table", F.col("body")), part("Key takeaways", numbered("lines", 5))))
        .when(F.col("mode") == "how_to", F.concat_ws("\n", part("Steps / implementation notes", numbered("lines", 8)), part("Things to verify", F.lit("\n".join(K.THINGS_TO_VERIFY)))))
        .when(F.col("mode") == "research_summary", part("Main points", bullets))
        .otherwise(numbered("lines", 10))
    )
    sources = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c.id.cast("string"), F.lit("] "), F.coalesce(c.title, F.lit("")), F.lit(" — "), F.coalesce(c.url, F.lit("")))), "\n")
    markdown = F.concat_ws("\n", part("Answer", intro), middle, part("Evidence notes", numbered("notes", 6)), part("Sources", sources))
    made = g.select("pack_id", F.when(answered, "answered").otherwise("partial").alias("status"), markdown.alias("markdown"), "citations", "row_urls", "confidence", "supported", "weak")
    gaps = F.lit("- No supported or weak claim-level evidence was available.")
    if "missing" in queries.columns:
        gaps = F.when(F.size("missing") > 0, F.array_join(F.transform("missing", lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(gaps)
    none = F.concat(F.lit("## Answer\n\nI do not have enough verified evidence to answer this confidently.\n\n## Evidence gaps\n\n"), gaps)
    out = q.withColumn("none", none).select("pack_id", "mode", "none").join(made, "pack_id", "left")
    filled = {"status": F.lit("insufficient_evidence"), "markdown": F.col("none"), "citations": F.array().cast(made.schema["citations"].dataType), "row_urls": F.array().cast("array<string>"), "confidence": F.lit(0.0), "supported": F.lit(0), "weak": F.lit(0)}
    return out.select("pack_id", "mode", *[F.coalesce(c, x).alias(c) for c, x in filled.items()])
