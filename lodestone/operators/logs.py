"""Conversations, job logs, pages' links and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import hrefs, resolved, to_follow, trim_all


def conversation_context(turns: DataFrame, max_chars: int = 24_000) -> DataFrame:
    """The newest turns of each conversation whose running cost stays within ``max_chars``; a turn costs text, role and 20."""
    t = turns.withColumn("cost", F.length("text") + F.length("role") + 20)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("used", F.sum("cost").over(newest)).withColumn("truncated", F.sum("cost").over(whole) > max_chars)
    return t.where(F.col("used") <= max_chars)


def message_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.max("turn").alias("last_turn"))


def job_status(events: DataFrame) -> DataFrame:
    """The latest status of each job in ``events(job_id, status, ts, seq)``."""
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("x")
    out = events.groupBy("job_id").agg(last, F.count("*").alias("transitions"), F.count_if(F.col("status") == "FAILED").alias("failures"))
    return out.select("job_id", F.col("x.status").alias("status"), F.col("x.ts").alias("updated_at"), "transitions", "failures", F.col("x.status").isin("COMPLETED", "FAILED").alias("terminal"))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct links ``(page_id, link)`` of ``pages(page_id, url, html)`` that a crawl follows: absolute, on their own host."""
    found = pages.select("page_id", "url", F.explode(hrefs(F.col("html"))).alias("href")).select("page_id", "url", resolved(F.col("url"), F.col("href")).alias("link"))
    return found.where(to_follow(F.col("url"), F.col("link"))).select("page_id", "link").distinct()


def html_title(html: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(trim_all(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), url)


def grounding_audit(answers: DataFrame) -> DataFrame:
    """``answers(answer_id, markdown, citations array<struct<id, url>>, row_urls array<string>)`` with the citation ids referenced,
    declared, missing, unused and ungrounded (their url is in no evidence row), the issues and the status.

    An answer with evidence rows and no marker fails; one with neither passes.
    """
    body = F.regexp_replace("markdown", r"(?s)\n## Sources.*", "")
    ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    a = answers.withColumn("referenced", ids).withColumn("declared", F.array_sort(F.transform("citations", lambda c: c.id)))
    a = a.withColumn("missing", F.array_except("referenced", "declared")).withColumn("unused", F.array_except("declared", "referenced"))
    a = a.withColumn("ungrounded", F.transform(F.filter("citations", lambda c: ~F.coalesce(F.array_contains("row_urls", c.url), F.lit(False))), lambda c: c.id))
    said = lambda text, x: F.when(F.size(x) > 0, F.concat(F.lit(text), F.array_join(F.transform(x, lambda i: i.cast("string")), ", ")))
    issues = F.array_compact(
        F.array(
            said("Citation IDs referenced but not declared: ", "missing"),
            said("Citation IDs declared but not referenced in body: ", "unused"),
            said("Citations do not map back to any kept evidence row: ", "ungrounded"),
            F.when((F.size("referenced") == 0) & (F.size("row_urls") > 0), F.lit("Answer has evidence rows but no inline citation markers found in body.")),
        )
    )
    return a.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") == 0, "pass").otherwise("fail"))


def dedupe_memory_drafts(drafts: DataFrame) -> DataFrame:
    """The first draft of each (project, user, scope, kind, collapsed lower-case text, sorted distinct urls)."""
    text = F.lower(trim_all(F.regexp_replace("text", r"\s+", " ")))
    w = Window.partitionBy("project_id", "user_id", "scope", "kind", text, F.array_sort(F.array_distinct("source_urls"))).orderBy("pos")
    return drafts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
