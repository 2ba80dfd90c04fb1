"""URL filters (operator 5): rules by host and path, and for the rest trust and distrust along host links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: on to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule ``(host/path, verdict)`` that fits as ``struct<rule, verdict>``, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct edges ``(src, dst)`` between different hosts, from the links of ``pages(host, html)``; relative links stay on their host."""
    hrefs = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))).alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    dst, _ = host_and_path(full)
    return hrefs.where(full.contains("://")).select("src", dst.alias("dst")).where("src != '' and dst != '' and src != dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-4, damping: float = 0.85) -> DataFrame:
    """Personalised PageRank ``(host, score)`` over ``edges(src, dst)`` from ``seeds(host)``, until a round moves no more than ``tolerance`` in all.

    Each round a host passes ``damping`` of its score on in equal parts and the seeds share the rest, with what
    hosts without links keep back. A round is a join and a partial aggregation; every fourth is written to the shared folder
    and compared with the one before. What a round moves shrinks by ``damping`` each time, so that scores end within
    6 times ``tolerance`` of their limit.
    """
    seeds = written(seeds.distinct())
    n = seeds.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    out = written(edges.join(degree, "src"))
    now = written(seeds.select("host", F.lit(1.0 / max(n, 1)).alias("score")))
    if not n or out.isEmpty():
        return now

    def step(now: DataFrame) -> DataFrame:
        moved = now.join(out, now.host == out.src).select(F.col("dst").alias("host"), (F.col("score") / F.col("degree") * damping).alias("score"))
        passed = moved.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("passed"))
        back = seeds.crossJoin(F.broadcast(passed)).select("host", ((1 - F.col("passed")) / F.lit(float(n))).alias("score"))  # passed is one row
        return moved.unionAll(back).groupBy("host").agg(F.sum("score").alias("score"))

    for _ in range(math.ceil(math.log(tolerance / 2) / math.log(damping)) // 4 + 1):  # enough in any case
        was = written(step(step(step(now))))
        now = written(step(was))
        gap = F.abs(F.coalesce(now.score, F.lit(0.0)) - F.coalesce(was.score, F.lit(0.0)))
        if (now.join(was, now.host == was.host, "full").agg(F.sum(gap)).first()[0] or 0.0) <= tolerance:
            break
    return now


def judge(pages: DataFrame, rules: list[tuple[str, str]], bar: float = 0.0, tolerance: float = 1e-4) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages(page_id, url, html)``.

    A page that a rule fits has the rule's verdict. Hosts of allowed pages are the trusted seeds, those of blocked pages
    the blocked ones. Trust flows along links, distrust against them, as who links to a bad host is suspect. Other pages
    are blocked if their host's distrust exceeds its trust by more than ``bar``; hosts that neither reaches are allowed.
    Null urls and such without ``://`` have an empty host and path, no rule and the verdict allow.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    edges = written(host_links(found.select("host", "html")))
    marked = written(found.where("r is not null").groupBy("host").agg(F.max(F.col("r.verdict") == "allow").alias("good"), F.max(F.col("r.verdict") == "block").alias("bad")))
    # a host with rules of both kinds is no seed
    trust = propagate(edges, marked.where("good and not bad").select("host"), tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(back, marked.where("bad and not good").select("host"), tolerance)
    scores = written(trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    out = found.drop("html").join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    verdict = F.coalesce("r.verdict", F.when(F.col("distrust") - F.col("trust") > bar, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
