"""Crawls over stored pages, retries and traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import is_blocked_reason, page_features, page_quality, should_retry
from lodestone.functions.text import canonicalize_url, content_hash, hostname, hrefs, page_key, resolved, to_follow, trim_all
from lodestone.operators.evidence import checkpointed


def link_table(pages: DataFrame) -> DataFrame:
    """``key, link, pos``: the links of ``pages(url, html)`` that a crawl follows, in order of first sight."""
    found = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href")).select(page_key(F.col("url")).alias("key"), "url", resolved(F.col("url"), F.col("href")).alias("link"), "pos")
    return found.where(to_follow(F.col("url"), F.col("link"))).groupBy("key", "link").agg(F.min("pos").alias("pos"))


def bounded_crawl(pages: DataFrame, roots: DataFrame, max_depth: int = 1, max_pages: int = 25, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Breadth-first from ``roots(root_id, url)`` over ``pages(url, html)``: ``root_id, key, parent, depth, place, found``.

    First come, first served; a url is visited once a root. Missing pages are reported with ``found`` false and don't use the
    budget; nothing after the ``max_pages``-th page is visited. A depth is one round of joins; the rounds are cut by ``checkpoint``.
    """
    if not 0 <= max_depth <= 3 or not 1 <= max_pages <= 25:
        raise ValueError("max_depth is 0 to 3, max_pages 1 to 25")
    cut = checkpoint or checkpointed
    stored = pages.select(page_key(F.col("url")).alias("key")).distinct().withColumn("found", F.lit(True))
    links = cut(link_table(pages))
    level = roots.select("root_id", page_key(F.col("url")).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("order"))
    seen = None
    for depth in range(max_depth + 1):
        level = cut(level.join(stored, "key", "left").withColumn("found", F.coalesce("found", F.lit(False))))
        seen = level if seen is None else cut(seen.unionByName(level))
        if depth == max_depth:
            break
        # no more than the first pages up to the budget send links on
        reach = F.sum(F.col("found").cast("int")).over(Window.partitionBy("root_id").orderBy("depth", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        parents = seen.withColumn("n", reach).where(F.col("found") & (F.col("n") <= max_pages) & (F.col("depth") == depth))
        nexts = parents.select("root_id", F.col("key").alias("parent"), "order").join(links.withColumnRenamed("key", "parent"), "parent")
        first = nexts.groupBy("root_id", "link").agg(F.min(F.struct("order", "pos", "parent")).alias("x"))
        fresh = first.join(seen.select("root_id", F.col("key").alias("link")), ["root_id", "link"], "left_anti")
        order = F.row_number().over(Window.partitionBy("root_id").orderBy("x.order", "x.pos", "link")).cast("long")
        level = fresh.select("root_id", F.col("link").alias("key"), F.col("x.parent").alias("parent"), F.lit(depth + 1).alias("depth"), order.alias("order"))
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("depth", "order"))
    before = F.coalesce(F.sum(F.col("found").cast("int")).over(Window.partitionBy("root_id").orderBy("depth", "order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.withColumn("place", place).withColumn("before", before).where(F.col("before") < max_pages).select("root_id", "key", "parent", "depth", "place", "found")


def crawl_trace(pages: DataFrame) -> DataFrame:
    """Counts by resource of ``pages(resource, status, reason, attempt)``; status is accepted, rejected, duplicate_url, duplicate_content or failed."""
    of = lambda s: F.count_if(F.col("status") == s)
    return pages.groupBy("resource").agg(F.count("*").alias("crawled"), of("accepted").alias("accepted"), of("rejected").alias("rejected_by_quality"), of("duplicate_url").alias("duplicate_url"), of("duplicate_content").alias("duplicate_content"), of("failed").alias("failed"), F.count_if(F.col("attempt") > 1).alias("retried"))


def fallback_mode(mode: Column) -> Column:
    """What to try next: auto, dynamic, stealth; null at the end."""
    return F.when(mode.isin("auto", "static"), "dynamic").when(mode == "dynamic", "stealth")


def mode_for_tier(tier: Column) -> Column:
    return F.when(tier.isin("community", "media"), "dynamic").otherwise("auto")


def page_budget(pages: DataFrame, most: int) -> DataFrame:
    """Pages in order of ``pos`` until ``most`` were accepted; later ones vanish."""
    n = F.coalesce(F.sum(F.col("accepted").cast("int")).over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("before", n).where(F.col("before") < most).drop("before")


ATTEMPTS = ("accepted", "rejected", "duplicate_url", "duplicate_content", "empty")


def crawl_events(resources: DataFrame, fetched: DataFrame, per_source: int) -> DataFrame:
    """The events ``(run_id, at, event)`` of crawls in order: each attempt begins, gives its first ``per_source`` pages, and ends."""
    tries = resources.select("run_id", F.col("pos").alias("resource"), hostname(F.col("url")).alias("host"), mode_for_tier(F.col("tier")).alias("first"), "url")
    tries = tries.select("run_id", "resource", "host", "url", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), F.col("first").alias("mode")), F.struct(F.lit(2).alias("attempt"), fallback_mode(F.col("first")).alias("mode")))).alias("t"))
    tries = tries.select("run_id", "resource", "host", "url", "t.attempt", "t.mode")
    got = fetched.withColumnsRenamed({"url": "page_url", "pos": "page"}).join(tries.select("run_id", "resource", "attempt", "mode", F.col("url").alias("root_url")), ["root_url", "mode"])
    key = ["run_id", "resource", "attempt"]
    blocked = F.coalesce(is_blocked_reason(F.col("reason")), F.lit(False))
    failed = got.where("failure = 'url'").groupBy(*key).agg(F.count("*").alias("n_failed"), F.bool_and(blocked).alias("all_blocked"))
    error = got.where("failure = 'attempt'").groupBy(*key).agg(F.min("reason").alias("error"))
    pages = got.where("failure is null")
    n = pages.groupBy(*key).agg(F.count("*").alias("n_pages"))
    t = tries.join(failed, key, "left").join(error, key, "left").join(n, key, "left")
    nothing = lambda kind: F.lit(None).cast(kind)
    mark = F.struct(
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("all_blocked", F.lit(False)).alias("all_blocked"), F.col("error").alias("error"), is_blocked_reason(F.col("error")).alias("error_blocked"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"), fallback_mode(F.col("mode")).isNotNull().alias("fallback"), F.col("host").alias("host"),
    )
    page = F.struct(F.col("page").alias("page"), F.col("url_key").alias("url_key"), F.col("content_key").alias("content_key"), F.col("outcome").alias("outcome"))
    bounds = t.select("run_id", "resource", "attempt", mark.alias("mark")).withColumn("step", F.explode(F.array(F.lit(0), F.lit(per_source + 1)))).withColumn("page", nothing("struct<page:bigint,url_key:string,content_key:string,outcome:string>"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("page"))
    rows = pages.select(*key, F.col("page").cast("long").alias("page"), "page_url", "markdown", number.alias("step")).where(F.col("step") <= per_source)
    empty = trim_all(F.coalesce("markdown", F.lit(""))) == ""
    fails = page_quality(F.col("markdown"), page_features(F.col("markdown")))["status"] == "reject"
    rows = rows.withColumn("outcome", F.when(empty, "empty").when(fails, "rejected")).withColumn("url_key", canonicalize_url(F.col("page_url"))).withColumn("content_key", content_hash(F.coalesce("markdown", F.lit(""))))
    rows = rows.select("run_id", "resource", "attempt", "step", page.alias("page")).withColumn("mark", nothing(bounds.schema["mark"].dataType))
    return bounds.unionByName(rows)


def settle(state: Column, e: Column, per_source: int, most: int) -> Column:
    """What a crawl knows after an event: a state machine over its accepted pages, blocked hosts and the attempt that runs."""
    s = lambda name: state[name]
    begins, ends = e["step"] == 0, e["step"] == per_source + 1
    m, p = e["mark"], e["page"]
    # an attempt is open if pages may still come, its host isn't blocked, and the first attempt asked for a second
    blocked = F.coalesce((m["host"] != "") & F.array_contains(s("blocked"), m["host"]), F.lit(False))
    reached = F.when(e["attempt"] == 1, s("accepted") < most).otherwise(s("again"))
    opens = reached & F.when(e["attempt"] == 1, ~blocked).otherwise(True)
    limit = F.least(F.lit(per_source), F.lit(most) - s("accepted"))
    # a page counts if it lies within what the attempt may fetch
    counted = s("open") & (e["step"] <= s("limit")) & (s("accepted") < most)
    status = F.when(p["outcome"].isNotNull(), p["outcome"]).when(F.array_contains(s("urls"), p["url_key"]), "duplicate_url").when(F.array_contains(s("hashes"), p["content_key"]), "duplicate_content").otherwise("accepted")
    status = F.when(counted, status)
    new = ~begins & ~ends & F.coalesce(status == "accepted", F.lit(False))
    one = new.cast("int")
    add = lambda name, value, when: F.when(when, F.concat(s(name), F.array(value))).otherwise(s(name))
    # an end decides on a second attempt and on the host
    failed = m["error"].isNotNull()
    returned = F.least(m["n_pages"], s("limit"))
    retry = should_retry(s("got"), s("rejected"), m["n_failed"], returned, F.lit(None).cast("string")) & m["fallback"]
    wants = s("open") & F.when(failed, (e["attempt"] == 1) & m["fallback"]).otherwise(retry)
    bars = s("open") & (m["host"] != "") & F.when(failed, m["error_blocked"]).otherwise((s("got") == 0) & (m["n_failed"] > 0) & m["all_blocked"])
    made = F.struct(
        e["resource"].alias("resource"), e["attempt"].alias("attempt"), p["page"].alias("page"), F.when(begins, F.lit("blocked")).when(ends, F.lit("attempt")).otherwise(status).alias("status"),
        F.when(ends, s("got")).alias("accepted"), F.when(ends, s("rejected")).alias("rejected"), F.when(ends & ~failed, m["n_failed"]).otherwise(0).alias("failed"), F.when(ends & ~failed, returned).otherwise(0).alias("returned"), F.when(ends, wants).otherwise(False).alias("retried"), F.when(ends, m["error"]).alias("error"),
    )
    tells = F.when(begins, reached & (e["attempt"] == 1) & blocked).when(ends, s("open")).otherwise(status.isNotNull())
    return F.struct(
        (s("accepted") + one).alias("accepted"), add("urls", p["url_key"], new).alias("urls"), add("hashes", p["content_key"], new).alias("hashes"), add("blocked", m["host"], ends & bars).alias("blocked"),
        F.when(begins, opens).when(ends, False).otherwise(s("open")).alias("open"), F.when(begins, F.when(failed, 0).otherwise(limit)).otherwise(s("limit")).cast("int").alias("limit"),
        F.when(begins, 0).otherwise(s("got") + one).alias("got"), F.when(begins, 0).otherwise(s("rejected") + F.coalesce((status == "rejected").cast("int"), F.lit(0))).alias("rejected"),
        F.when(ends, wants & (e["attempt"] == 1)).when(begins, False).otherwise(s("again")).alias("again"), add("out", made, tells).alias("out"),
    )


def crawl_sources(resources: DataFrame, fetched: DataFrame, memories: DataFrame | None = None, per_source: int = 3, most: int = 20, resources_at_once: int = 64) -> tuple[DataFrame, DataFrame]:
    """What becomes of the pages that ranked resources give, for many crawls at once: ``pages`` and ``attempts``.

    ``resources(run_id, pos, url, tier)`` in order of ``pos``; ``fetched(root_url, mode, pos, url, markdown, failure, reason)``: what a fetch of a root in
    a mode gave: pages in order (``failure`` null), addresses that failed (``url``), or the error of a whole attempt (``attempt``).
    ``memories(run_id, kind, domain_blocked, source_urls)`` block hosts from the start.

    A crawl takes resources in turn until ``most`` pages are accepted. The first ``per_source`` pages of an attempt count, fewer if fewer may still be
    accepted; each is empty, rejected by quality, a duplicate of an accepted page by url or content, or accepted. An attempt without an accepted page is
    tried again in the next mode if there is reason to; a host all of whose failures say that it blocks is passed over from
    then on. ``pages`` has ``run_id, resource, attempt, page, status``; ``attempts`` has a row for each attempt or blocked resource with its
    counts, ``retried`` and ``error``.

    The order matters, and what a crawl must remember is bounded by ``most``: crawls are folded, side by side, over ``resources_at_once`` resources a row;
    a crawl of more resources goes on in the next round with its state.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("pos")) - 1
    turns = resources.withColumn("turn", F.floor(place / resources_at_once).cast("int"))
    rounds = turns.agg(F.max("turn")).first()[0]
    events = crawl_events(resources, fetched, per_source).join(turns.select("run_id", F.col("pos").alias("resource"), "turn"), ["run_id", "resource"])
    events = events.groupBy("run_id", "turn").agg(F.array_sort(F.collect_list(F.struct("resource", "attempt", "step", "page", "mark"))).alias("events"))
    events = checkpointed(events)
    result = "array<struct<resource:bigint,attempt:int,page:bigint,status:string,accepted:int,rejected:int,failed:bigint,returned:bigint,retried:boolean,error:string>>"
    kind = f"struct<accepted:int,urls:array<string>,hashes:array<string>,blocked:array<string>,open:boolean,limit:int,got:int,rejected:int,again:boolean,out:{result}>"
    none = lambda k: F.array().cast(k)
    runs = resources.select("run_id").distinct().withColumn("barred", none("array<string>"))
    if memories is not None:
        hosts = memories.where("kind = 'source_failure' and domain_blocked").select("run_id", F.explode("source_urls").alias("u")).select("run_id", hostname(F.col("u")).alias("host")).where("host != ''")
        runs = runs.drop("barred").join(hosts.groupBy("run_id").agg(F.collect_set("host").alias("barred")), "run_id", "left").withColumn("barred", F.coalesce("barred", none("array<string>")))
    start = lambda blocked: F.struct(F.lit(0), none("array<string>"), none("array<string>"), blocked, F.lit(False), F.lit(0), F.lit(0), F.lit(0), F.lit(False), none(result)).cast(kind)
    state, out = runs.select("run_id", start(F.col("barred")).alias("state")), None
    for turn in range((rounds if rounds is not None else -1) + 1):
        now = events.where(F.col("turn") == turn).select("run_id", "events")
        fresh = F.struct(*[none(result).alias("out") if f == "out" else F.col(f"state.{f}").alias(f) for f in ("accepted", "urls", "hashes", "blocked", "open", "limit", "got", "rejected", "again", "out")]).cast(kind)
        state = checkpointed(state.join(now, "run_id").select("run_id", F.aggregate("events", fresh, lambda s, e: settle(s, e, per_source, most).cast(kind)).alias("state")))
        made = state.select("run_id", F.explode("state.out").alias("x")).select("run_id", "x.*")
        out = made if out is None else out.unionAll(made)
    if out is None:
        out = state.select("run_id", F.explode("state.out").alias("x")).select("run_id", "x.*")
    pages = out.where(F.col("status").isin(*ATTEMPTS)).select("run_id", "resource", "attempt", "page", "status")
    attempts = out.where("status in ('attempt', 'blocked')").select("run_id", "resource", "attempt", (F.col("status") == "blocked").alias("blocked"), "accepted", "rejected", "failed", "returned", "retried", "error")
    return pages, attempts


def source_crawl_trace(pages: DataFrame, attempts: DataFrame) -> DataFrame:
    """Counts by run of ``crawl_sources``: pages returned, accepted, skipped and why, sources with and without pages, retries, blocked hosts, failures."""
    of = lambda s: F.count_if(F.col("status") == s)
    p = pages.groupBy("run_id").agg(of("accepted").alias("accepted"), of("rejected").alias("rejected_by_quality"), of("duplicate_url").alias("duplicate_url"), of("duplicate_content").alias("duplicate_content"))
    r = attempts.groupBy("run_id", "resource").agg(F.sum(F.coalesce("accepted", F.lit(0))).alias("accepted"), F.sum("returned").alias("returned"), F.count_if("retried").alias("retries"), F.count_if("blocked").alias("blocked"), F.sum("failed").alias("failed"), F.max_by("error", "attempt").alias("error"), F.max_by("retried", "attempt").alias("last_retried"))
    lost = F.col("failed") + F.col("blocked") + F.col("error").isNotNull().cast("int")
    r = r.groupBy("run_id").agg(F.sum("returned").alias("crawled"), F.count_if(F.col("accepted") > 0).alias("sources_with_content"), F.count_if(F.col("accepted") == 0).alias("sources_skipped"), F.sum("retries").alias("retries"), F.sum("blocked").alias("blocked_hosts"), F.sum(lost).alias("failures"))
    names = ("accepted", "rejected_by_quality", "duplicate_url", "duplicate_content")
    return r.join(p, "run_id", "left").select("run_id", "crawled", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], "sources_with_content", "sources_skipped", "retries", "blocked_hosts", "failures")
