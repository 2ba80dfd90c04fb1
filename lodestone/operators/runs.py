"""Job runs as tables: views of a job, its last output, sources that an answer names, and benchmark verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import host_matches, hostname, trim_all

# Hosts that sources of an answer are ranked by, or dropped for.
STRONG_HOSTS = ["developers.facebook.com", "developers.google.com", "business-api.tiktok.com", "ads.tiktok.com"]
WEAK_HOSTS = ["youtube.com", "youtu.be", "postman.com", "stackoverflow.com", "reddit.com", "medium.com"]


def last_useful_stdout(steps: DataFrame) -> DataFrame:
    """``run_id, stdout`` from ``steps(run_id, step, stdout)``: of the last step that printed and has no error mark, else of the last that printed."""
    text = trim_all(F.coalesce("stdout", F.lit("")))
    said = steps.withColumn("t", text).where("t != ''")
    fine = ~F.lower("t").contains("an error occurred: 0")
    return said.groupBy("run_id").agg(F.coalesce(F.max_by(F.when(fine, F.col("t")), F.when(fine, F.col("step"))), F.max_by("t", "step")).alias("stdout"))


def named_sources(steps: DataFrame, most: int = 8) -> DataFrame:
    """``run_id, place, url``: the distinct addresses that a run's steps printed, without weak hosts, strong hosts first, then by first sight."""
    urls = steps.select("run_id", "step", F.posexplode(F.regexp_extract_all(F.coalesce("stdout", F.lit("")), F.lit(r"""https?://[^\s'",}]+"""), F.lit(0))).alias("i", "url"))
    first = urls.groupBy("run_id", "url").agg(F.min(F.struct("step", "i")).alias("at"))
    host = hostname(F.col("url"))
    any_of = lambda domains: F.exists(F.array(*map(F.lit, domains)), lambda d: host_matches(host, d))
    rank = F.when(any_of(STRONG_HOSTS), 100).when(host == "", 0).otherwise(40)
    ordered = F.array_sort(F.collect_list(F.struct((-rank).alias("r"), "at", "url")))
    kept = first.where(~any_of(WEAK_HOSTS)).groupBy("run_id").agg(F.slice(ordered, 1, most).alias("x"))
    return kept.select("run_id", F.posexplode("x").alias("place", "s")).select("run_id", (F.col("place") + 1).alias("place"), "s.url")


def job_views(jobs: DataFrame, messages: DataFrame, runs: DataFrame) -> DataFrame:
    """``jobs(job_id, ...)`` with their newest reports and runs as counts and last values; jobs without any stay."""
    m = messages.groupBy("job_id").agg(F.count("*").alias("reports"), F.max_by("content", "pos").alias("last_report"))
    r = runs.groupBy("job_id").agg(F.count("*").alias("runs"), F.max_by("status", "pos").alias("last_status"))
    out = jobs.join(m, "job_id", "left").join(r, "job_id", "left")
    return out.withColumn("reports", F.coalesce("reports", F.lit(0))).withColumn("runs", F.coalesce("runs", F.lit(0)))


def research_status(documents, failed, answered):
    """error without documents; partial with failures or without an answer; else ok."""
    return F.when(documents == 0, "error").when((failed > 0) | ~answered, "partial").otherwise("ok")


def benchmark_verdicts(runs: DataFrame) -> DataFrame:
    """``runs(contract_version, grounding_status, grounding_issues, citations, accepted_pages, filtered_claims, min_citations, min_pages, min_claims)`` with ``failures`` and ``passed``."""
    said = lambda name, value, bad: F.when(bad, F.concat(F.lit(name + ":"), value.cast("string")))
    at_least = lambda name, value, least, by: said(name, F.col(value), F.coalesce(value, F.lit(0)) < F.coalesce(least, F.lit(by)))
    grounding = F.coalesce("grounding_status", F.lit("missing"))
    failures = F.array_compact(
        F.array(
            F.when(F.coalesce("contract_version", F.lit("")) != "research-response-v1", F.lit("missing_contract_version")),
            said("grounding_not_pass", grounding, grounding != "pass"),
            said("grounding_issues", F.col("grounding_issues"), F.col("grounding_issues") > 0),
            at_least("low_citations", "citations", "min_citations", 1),
            at_least("low_accepted_pages", "accepted_pages", "min_pages", 1),
            at_least("low_filtered_claims", "filtered_claims", "min_claims", 3),
        )
    )
    return runs.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


#: The columns of a benchmark's summary, in order: from a run's own name, where it has another.
SUMMARY = {
    "id": "id", "category": "category", "passed": "passed", "failures": "said", "status": "status", "answerMode": "mode", "groundingStatus": "grounding", "groundingIssueCount": "issues", "citationsLength": "citations",
    "acceptedPages": "accepted", "skippedPages": "skipped", "retryCount": "retries", "rejectedByQuality": "rejected_by_quality", "rejectedByDuplicateUrl": "duplicate_url", "rejectedByDuplicateContent": "duplicate_content",
    "rawClaimCount": "raw_claims", "filteredClaimCount": "kept_claims", "qualityRejectedClaimCount": "quality_rejected", "duplicateRejectedClaimCount": "duplicate_rejected", "supportedClaimCount": "supported", "weakClaimCount": "weak", "unsupportedClaimCount": "unsupported",
    "warningsLength": "n_warnings", "resourcesPlanned": "resources", "selectedProviders": "providers", "routeKinds": "routes", "durationMs": "duration_ms",
}


def benchmark_rows(runs: DataFrame, suite: DataFrame) -> DataFrame:
    """The summary's columns for every question of ``suite(id, category, minAcceptedPages, minFilteredClaims, minCitations)``; a question without a run has failed.

    ``runs(run_id, ...)`` as research gives them, with ``providers`` and ``routes`` (arrays), ``duration_ms`` and ``error`` where they are known.
    """
    r = runs.withColumn("n_warnings", F.size("warnings")).withColumn("ran", F.lit(True))
    for name, kind in (("providers", "array<string>"), ("routes", "array<string>"), ("duration_ms", "bigint"), ("error", "string")):
        r = r if name in runs.columns else r.withColumn(name, F.lit(None).cast(kind))
    j = suite.join(r.drop("id", "category"), F.col("id") == F.col("run_id"), "left")
    counts = {"grounding_status": "grounding", "grounding_issues": "issues", "accepted_pages": "accepted", "filtered_claims": "kept_claims", "min_citations": "minCitations", "min_pages": "minAcceptedPages", "min_claims": "minFilteredClaims"}
    j = benchmark_verdicts(j.withColumns({k: F.col(v) for k, v in counts.items()}).withColumn("contract_version", F.when(F.col("ran"), F.lit("research-response-v1"))))
    error = F.coalesce("error", F.when(F.col("ran").isNull(), F.lit("no response")))
    failures = F.when(error.isNotNull(), F.array(F.concat(F.lit("request_error:"), error))).otherwise(F.col("failures"))
    j = j.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0).withColumn("said", F.array_join("failures", "; "))
    j = j.withColumn("providers", F.array_join(F.coalesce("providers", F.array().cast("array<string>")), "|")).withColumn("routes", F.array_join(F.coalesce("routes", F.array().cast("array<string>")), "|"))
    return j.select(*[F.col(v).alias(k) for k, v in SUMMARY.items()])


def benchmark_markdown(rows: DataFrame, started: str, finished: str, api: str, project: str, title: str = "Research Benchmark Summary") -> DataFrame:
    """One row ``markdown``: the aggregate, a table of the questions and the failed cases; a suite has some hundreds of questions."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    line = F.concat(F.lit("| "), "id", F.lit(" | "), F.when(F.col("passed"), "✅").otherwise("❌"), F.lit(" | "), F.coalesce(F.nullif("groundingStatus", F.lit("")), F.lit("—")), *[F.concat(F.lit(" | "), cell(c)) for c in ("filteredClaimCount", "citationsLength", "acceptedPages", "retryCount")], F.lit(" | "), F.coalesce("failures", F.lit("")), F.lit(" |"))
    bad = F.when(~F.col("passed"), F.concat(F.lit("- **"), "id", F.lit("**: "), "failures"))
    g = rows.agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"), F.array_sort(F.collect_list(F.struct("id", line.alias("line"), bad.alias("bad")))).alias("x"))
    of = lambda a, b: F.concat(F.lit(a), b.cast("string"), F.lit("/"), F.col("n").cast("string"))
    head = [F.lit(x) for x in (f"# {title}", "", f"- Started: {started}", f"- Finished: {finished}", f"- API: {api}", f"- Project: {project}")]
    table = [F.lit(x) for x in ("", "| Query | Pass | Grounding | Claims | Citations | Pages | Retries | Failures |", "| --- | --- | --- | ---: | ---: | ---: | ---: | --- |")]
    failed = F.filter(F.transform("x", lambda r: r.bad), lambda b: b.isNotNull())
    cases = F.when(F.size(failed) > 0, failed).otherwise(F.array(F.lit("No failed cases.")))
    lines = F.concat(F.array(*head, of("- Passed: ", F.col("ok")), of("- Failed: ", F.col("n") - F.col("ok")), *table), F.transform("x", lambda r: r.line), F.array(F.lit(""), F.lit("## Failed cases"), F.lit("")), cases)
    return g.select(F.array_join(lines, "\n").alias("markdown"))


def nested_job_views(jobs: DataFrame, reports: DataFrame, runs: DataFrame, steps: DataFrame, most_reports: int = 20) -> DataFrame:
    """``jobs(job_id, ...)`` with ``reports``, the newest ``most_reports``, newest first, and ``runs``, newest first, each with its ``steps`` in order.

    ``reports(job_id, pos, content)``, ``runs(job_id, run, pos, status)``, ``steps(run, step, stdout)``. What is gathered is one job's.
    """
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("pos")))
    kept = reports.withColumn("n", newest).where(F.col("n") <= most_reports).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("r"))
    kept = kept.select("job_id", F.transform("r", lambda x: x.content).alias("reports"))
    s = steps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "stdout"))).alias("steps"))
    r = runs.join(s, "run", "left").withColumn("steps", F.coalesce("steps", F.array().cast(s.schema["steps"].dataType)))
    r = r.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("pos", "run", "status", "steps")), asc=False).alias("runs"))
    out = jobs.join(kept, "job_id", "left").join(r, "job_id", "left")
    return out.withColumn("reports", F.coalesce("reports", F.array().cast("array<string>"))).withColumn("runs", F.coalesce("runs", F.array().cast(r.schema["runs"].dataType)))
