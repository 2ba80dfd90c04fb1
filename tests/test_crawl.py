import random

from pyspark.sql import functions as F

from lodestone.operators import crawl

SITE = {"/": ["/a", "b/", "/a#x", "https://other.org/z", "/Login?next=c"], "/a": ["/d", "/"], "/b": ["/missing", "/d", "/e"], "/d": ["/f"], "/e": [], "/f": []}


def slow(root, depth, most):
    seen, queue, out, n = {root}, [(root, None, 0)], [], 0
    while queue and n < most:
        key, parent, d = queue.pop(0)
        path = key.removeprefix("https://x.org") or "/"
        found = path in SITE
        out.append((key, parent, d, found))
        n += found
        if found and d < depth:
            for h in SITE[path]:
                link = ("https://x.org" + ("" if h.startswith("/") else "/") + h if not h.startswith("http") else h).split("#")[0].rstrip("/")
                if link.startswith("https://x.org") and "/login" not in link.lower() and link not in seen:
                    seen.add(link)
                    queue.append((link, key, d + 1))
    return out


def test_bounded_crawl(spark):
    rows = [("https://x.org" + p, " ".join(f'<a class="k" href="{h}">t</a>' for h in ls)) for p, ls in SITE.items()]
    pages = spark.createDataFrame(rows, "url string, html string")
    roots = spark.createDataFrame([("r", "https://x.org/"), ("s", "https://x.org/gone")], "root_id string, url string")
    for depth, most in ((0, 5), (1, 25), (2, 3), (3, 25)):
        got = crawl.bounded_crawl(pages, roots, depth, most).where("root_id = 'r'").orderBy("place").collect()
        assert [(r.key, r.parent, r.depth, r.found) for r in got] == slow("https://x.org", depth, most), (depth, most)
    assert [r.found for r in crawl.bounded_crawl(pages, roots, 1, 5).where("root_id = 's'").collect()] == [False]


def test_modes_budget_and_trace(spark):
    m = spark.createDataFrame([("auto",), ("static",), ("dynamic",), ("stealth",)], "m string").select(crawl.fallback_mode(F.col("m")).alias("x")).collect()
    assert [r.x for r in m] == ["dynamic", "dynamic", "stealth", None]
    p = spark.createDataFrame([("r", k, k % 2 == 0) for k in range(6)], "run_id string, pos int, accepted boolean")
    assert sorted(r.pos for r in crawl.page_budget(p, 2).collect()) == [0, 1, 2]
    t = crawl.crawl_trace(spark.createDataFrame([("u", "accepted", None, 1), ("u", "failed", "403", 2)], "resource string, status string, reason string, attempt int")).first()
    assert (t.crawled, t.accepted, t.failed, t.retried) == (2, 1, 1, 1)


GOOD = "# Guide\n## Use\n" + "The service supports every client that sends a token with each call it makes. " * 4


def slow_crawls(resources, fetched, barred, per_source, most):
    """The crawl of each run, one resource after the other."""
    nexts = {"auto": "dynamic", "dynamic": "stealth"}
    bad = lambda r: any(x in (r or "").lower() for x in ("403", "blocked", "forbidden"))
    host = lambda u: u.split("/")[2].removeprefix("www.")
    pages, tries = [], []
    for run, rs in resources.items():
        accepted, urls, hashes, blocked = 0, set(), set(), set(barred.get(run, ()))
        for pos, url, tier in rs:
            if accepted >= most:
                break
            if host(url) in blocked:
                tries.append((run, pos, 1, True, None, None, 0, 0, False, None))
                continue
            mode = "dynamic" if tier in ("community", "media") else "auto"
            for attempt in (1, 2):
                rows = fetched.get((url, mode), [])
                error = min((r["reason"] for r in rows if r["failure"] == "attempt"), default=None)
                if error is not None:
                    if bad(error):
                        blocked.add(host(url))
                    again = attempt == 1 and mode in nexts
                    tries.append((run, pos, attempt, False, 0, 0, 0, 0, again, error))
                else:
                    limit = min(per_source, most - accepted)
                    got = [r for r in rows if r["failure"] is None][:limit]
                    lost = [r["reason"] for r in rows if r["failure"] == "url"]
                    new = rejected = 0
                    for r in got:
                        text = r["markdown"]
                        if not (text or "").strip():
                            status = "empty"
                        elif text.startswith("short"):
                            status, rejected = "rejected", rejected + 1
                        elif r["url"] in urls:
                            status = "duplicate_url"
                        elif text.lower() in hashes:
                            status = "duplicate_content"
                        else:
                            status, new, accepted = "accepted", new + 1, accepted + 1
                            urls.add(r["url"])
                            hashes.add(text.lower())
                        pages.append((run, pos, attempt, r["pos"], status))
                    if not new and lost and all(map(bad, lost)):
                        blocked.add(host(url))
                    again = not new and bool(rejected or lost or got) and mode in nexts
                    tries.append((run, pos, attempt, False, new, rejected, len(lost), len(got), again, None))
                if not again:
                    break
                mode = nexts[mode]
    return sorted(pages), sorted(tries, key=str)


def test_crawl_sources_against_one_after_the_other(spark):
    r = random.Random(7)
    resources, fetched, rows, barred = {}, {}, [], {}
    for run in range(150):
        resources[run] = [(k, f"https://{r.choice(['', 'www.'])}h{r.randrange(6)}.org/r{run}-{k}", r.choice(["official_docs", "community", "media", "unknown"])) for k in range(r.randrange(1, 9))]
        if run % 9 == 0:
            barred[run] = [f"h{r.randrange(6)}.org"]
        for _, url, _ in resources[run]:
            for mode in ("auto", "dynamic", "stealth"):
                own = []
                kind = r.random()
                for k in range(r.randrange(5)):
                    n = r.randrange(8)
                    text = r.choice([GOOD + f"Number {n} of them.", GOOD.upper() + f"NUMBER {n} OF THEM.", "short", "", None, GOOD + f"Number {n} of them."]) if kind < 0.6 else "short"
                    own.append({"url": f"https://p.org/{run}/{r.randrange(12)}", "pos": k, "markdown": text, "failure": None, "reason": None})
                for k in range(r.choice([0, 0, 1, 2])):
                    own.append({"url": f"{url}/f{k}", "pos": 50 + k, "markdown": None, "failure": "url", "reason": r.choice(["HTTP 403", "blocked by site", "timeout"])})
                if r.random() < 0.15:
                    own.append({"url": url, "pos": 99, "markdown": None, "failure": "attempt", "reason": r.choice(["Forbidden", "socket closed"])})
                fetched[url, mode] = own
                rows += [(url, mode, x["pos"], x["url"], x["markdown"], x["failure"], x["reason"]) for x in own]
    rs = spark.createDataFrame([(run, *x) for run, xs in resources.items() for x in xs], "run_id long, pos long, url string, tier string")
    fs = spark.createDataFrame(rows, "root_url string, mode string, pos long, url string, markdown string, failure string, reason string")
    ms = spark.createDataFrame([(run, "source_failure", True, [f"https://www.{h}/x" for h in hs]) for run, hs in barred.items()], "run_id long, kind string, domain_blocked boolean, source_urls array<string>")
    for per_source, most, at_once in ((3, 6, 64), (2, 4, 3)):
        pages, tries = crawl.crawl_sources(rs, fs, ms, per_source, most, at_once)
        want_pages, want_tries = slow_crawls(resources, fetched, barred, per_source, most)
        assert sorted(map(tuple, pages.collect())) == want_pages
        assert sorted(map(tuple, tries.collect()), key=str) == want_tries
        seen = {x[4] for x in want_pages}
        assert seen == {"accepted", "rejected", "empty", "duplicate_url", "duplicate_content"} and any(t[3] for t in want_tries)
    trace = {x.run_id: x for x in crawl.source_crawl_trace(pages, tries).collect()}
    for run in resources:
        own = [t for t in want_tries if t[0] == run]
        assert trace[run].accepted == sum(1 for p in want_pages if p[0] == run and p[4] == "accepted") and trace[run].retries == sum(t[8] for t in own) and trace[run].blocked_hosts == sum(t[3] for t in own)
    none = crawl.crawl_sources(rs.where("pos < 0"), fs, ms)
    assert none[0].count() == 0 and none[1].count() == 0
