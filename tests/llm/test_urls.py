import re

from lodestone.llm import urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)(/[^?#]*)?", url.split("://", 1)[1])
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2] or ""


def rule(host, path):
    best = None
    for r, v in RULES:
        name, tail = r.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best


def rank(edges, seeds, rounds=300, damping=0.85):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    now = {s: 1 / len(seeds) for s in seeds}
    for _ in range(rounds if seeds and edges else 0):
        new = {}
        for h, x in now.items():
            for b in out.get(h, []):
                new[b] = new.get(b, 0) + damping * x / len(out[h])
        rest = 1 - sum(new.values())
        for s in seeds:
            new[s] = new.get(s, 0) + rest / len(seeds)
        now = new
    return now


PAGES = [
    (1, "http://a.net/x", '<a href="http://b.com/">'),
    (2, "HTTP://B.com/y?q#f", '<p><a class=x href=http://c.com/1>t</a><A HREF=\'//a.net\'>'),
    (3, "http://c.com", '<a href="http://good.org/fr/a">'),
    (4, "http://Good.ORG/fr/a", '<a href="https://D.com/p">x</a><a href="/own">'),
    (5, "https://d.com/p", None),
    (6, "http://sub.example.net/en/1", '<a href="http://d.com">'),
    (7, "http://xnet/", ""),
    (8, "http://net", ""),
    (9, "http://www.net/", ""),
    (10, "no url", "<a href=http://a.net/>"),
    (11, None, None),
    (12, "http://example.com/de/x", ""),
    (13, "http://example.com/den", ""),
    (14, "x://e.com?://y/z", ""),
    (15, "http://b.com/z", '<a href="http://c.com/2">'),
    (15, "http://b.com/z", '<a href="http://c.com/2">'),
    (16, "http://ÀB.com/É?x", ""),
    (17, "http://lone.com/" + "p" * 5000, ""),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(*p, "h", 0) for p in PAGES], "page_id long, url string, html string, host string, trust int")
    got = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    hosts = {p[0]: parse(p[1]) for p in PAGES}
    rules = {p[0]: rule(*hosts[p[0]]) for p in PAGES}
    edges = {("a.net", "b.com"), ("b.com", "c.com"), ("b.com", "a.net"), ("c.com", "good.org"), ("good.org", "d.com"), ("sub.example.net", "d.com")}
    good = {hosts[i][0] for i, r in rules.items() if r and r[1] == "allow"}
    bad = {hosts[i][0] for i, r in rules.items() if r and r[1] == "block"}
    trust, distrust = rank(edges, good - bad), rank({(b, a) for a, b in edges}, bad - good)
    for i, (h, p) in hosts.items():
        r = got[i]
        assert (r.host, r.path, r.rule) == (h, p, rules[i][0] if rules[i] else None), i
        assert abs(r.trust - trust.get(h, 0)) < 6e-4 and abs(r.distrust - distrust.get(h, 0)) < 6e-4
        assert r.verdict == (rules[i][1] if rules[i] else "block" if r.distrust > r.trust else "allow")
    assert got[2].verdict == "block" and got[5].verdict == "allow"
    assert urls.judge(df, RULES).count() == len(PAGES)
    assert urls.judge(df.where("page_id < 0"), RULES).count() == 0


def test_scores_reach_the_end_of_a_chain(spark):
    edges = [(f"h{k}", f"h{k + 1}") for k in range(20)] + [("h20", "h3"), ("h5", "h0")]
    got = {r.host: r.score for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("h0",)], "host string")).collect()}
    want = rank(set(edges), {"h0"})
    assert set(got) == set(want) and sum(abs(got[h] - want[h]) for h in want) <= 6e-4 and got["h20"] > 0
