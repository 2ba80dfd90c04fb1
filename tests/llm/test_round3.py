import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, manifest, runs
from lodestone.llm.queries import ORACLES

from . import data

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(t):
    return PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow_hits(docs, items, size):
    found = []
    wins = defaultdict(set)
    for i, t in items:
        w = plain(t)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            wins[tuple(w[k : k + size])].add(i)
    for i, t, *_ in docs:
        w, hit, ids = plain(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(x) for x in own if x is not None}
        found.append((str(i), len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return Counter(found)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "alpha, beta!"), (3, "Gamma"), (4, None), (5, ""), (None, "the of and x"), (10, "one two three four five six seven eight nine ten"), (2, "alpha, beta!"), (6, "x " * 30)]


def contaminated_rows():
    r = random.Random(5)
    rows = data.rows()
    for k in range(60):
        w = [r.choice(["one", "two", "x", "y", "z"]) for _ in range(r.randrange(30))]
        at = r.randrange(len(w) + 1)
        w[at:at] = ITEMS[0][1].split()[r.randrange(3) : 12 - r.randrange(3)] if k % 2 else "three four five six seven eight nine ten eleven".split()
        rows.append((4000 + k, r.choice([" ", ", ", "-"]).join(w), "en", "s", 1))
    return [*rows, rows[-1], rows[-1]]


@pytest.mark.parametrize(("size", "part"), [(10, 1 << 25), (4, 1 << 25), (10, 900)])
def test_decontamination_against_brute_force(spark, monkeypatch, size, part):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    rows = contaminated_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(rows, data.SCHEMA)
    got = decontaminate.decontaminate(df, items, size).collect()
    assert Counter((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == slow_hits(rows, ITEMS, size)
    for r in got:
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_hit and all(a["to"] < b["from"] for a, b in zip(r.spans, r.spans[1:]))


def test_decontamination_of_awkward_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wide = data.docs(spark, extra=True).withColumn("at", F.lit(1)).withColumn("token", F.lit(1)).withColumn("from", F.lit("x"))
    assert decontaminate.decontaminate(wide, items.withColumn("win", F.lit(1))).count() == len(data.rows())
    assert decontaminate.decontaminate(data.empty(spark), items).count() == 0
    got = decontaminate.decontaminate(data.docs(spark), items.where("item_id = 99")).collect()
    assert len(got) == len(data.rows()) and not any(r.contaminated for r in got)
    plan = decontaminate.decontaminate(data.docs(spark), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def slow_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            b = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - b + q >= max(least, times * q):
                out.setdefault((b - q, i - b + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(r, k):
    w = []
    while len(w) < r.choice([10, 40, 90, 200]):
        if r.random() < 0.5:
            w += [r.randrange(k) for _ in range(r.randrange(1, 20))]
        else:
            w += ([r.randrange(k) for _ in range(r.randrange(1, 12))] * r.randrange(2, 9))[: r.randrange(1, 80)]
    return w


def test_runs_of_words_against_brute_force():
    r, n = random.Random(1), 0
    for _ in range(1500):
        w, least = repetitive(r, r.choice([1, 2, 3, 5, 50])), r.choice([6, 9, 12, 24])
        want = slow_runs(w, least)
        n += len(want)
        assert sorted(runs.runs_within(w, least, 3), key=lambda x: (x[0], x[2])) == want
        assert runs.runs_of([b"%d" % x for x in w], least, 3) == want  # the stretches lose none
        assert runs.runs_of([b"%d" % x for x in w], least, 4) == slow_runs(w, least, 4)
    assert n > 1000


def test_automaton_recolours_last_occurrences():
    r = random.Random(2)
    for _ in range(60):
        w = [r.randrange(2) for _ in range(40)]
        seen = runs.Occurrences()
        for i, c in enumerate(w):
            met = {last: common for last, common in seen.append(c, i) if last >= 0}
            want = {}
            for n in range(1, i + 2):  # for each suffix, where it ended last
                last = max((e for e in range(n - 1, i) if w[e - n + 1 : e + 1] == w[i - n + 1 : i + 1]), default=None)
                if last is not None:
                    want[last] = n
            assert met == want


def test_runs_of_a_table(spark):
    r = random.Random(3)
    rows = data.rows() + [(6000 + k, ["\n", " ", " \t"][k % 3].join(f"w{x}" for x in repetitive(r, 4)), "en", "s", 1) for k in range(60)]
    rows += [(7000, " ".join(["a"] * 300_000), "en", "s", 1), (7001, " ".join(f"u{k % 9000}" for k in range(40_000)), "en", "s", 1)]
    got = runs.find(spark.createDataFrame(rows, data.SCHEMA)).collect()
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = [(0, 300_000, 1)] if i == 7000 else [(0, 40_000, 9000)] if i == 7001 else slow_runs(w)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        want[(str(i), len(w), tuple(found), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert Counter((str(x.doc_id), x.n_words, tuple(map(tuple, x.runs)), x.collapsed) for x in got) == want
    assert runs.find(data.empty(spark)).count() == 0
    assert runs.find(data.docs(spark, extra=True).withColumn("runs", F.lit(1))).count() == len(data.rows())
    best = spark.createDataFrame([([(0, 24, 8), (3, 30, 10), (9, 31, 10), (20, 62, 20)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [x[0] and tuple(x[0]) for x in best.select(runs.steepest(F.col("runs"))).collect()] == [(9, 31, 10), None]


def slow_tree(nodes):
    """The root, and the siblings of each node on its way up: left and right, by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, j in enumerate(at):
            g = level[3 * (j // 3) : 3 * (j // 3) + 3]
            ways[k].append(("".join(g[: j % 3]), "".join(g[j % 3 + 1 :])))
            at[k] = j // 3
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], ways


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def test_manifest_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, t, None if k % 7 == 0 else lang, src, n) for k, (i, t, lang, src, n) in enumerate(data.rows())]
    rows += [(r.choice([k, k // 3, -k, r.getrandbits(63), -r.getrandbits(63), 5, None]), f"t{r.randrange(9)}\nx", "en", r.choice(["big", "big", "big", "", "é", None]), k % 5) for k in range(1500)]
    rows += [(77, "same", "en", "big", 1)] * 300 + [(77, f"other {k}", "en", "big", 1) for k in range(300)]
    by = defaultdict(list)
    for i, t, lang, src, n in rows:
        by[src].append((i is not None, i or 0, sha(*map(field, (i, src, lang, n, t)))))
    order, want, ways = sorted(by, key=lambda s: (s is not None, (s or "").encode())), Counter(), {}
    for s in order:
        by[s].sort()
        ways[s] = slow_tree([x[2] for x in by[s]])
    root, tops = slow_tree([ways[s][0] for s in order])
    for s, top in zip(order, tops):
        for pos, ((known, i, leaf), way) in enumerate(zip(by[s], ways[s][1])):
            want[(str(i if known else None), leaf, pos, ways[s][0], root, tuple(way + top))] += 1
    df = spark.createDataFrame(rows, data.SCHEMA).repartition(5)
    leaf = manifest.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    got = manifest.manifest(df.select("doc_id", "source", leaf.alias("leaf"))).withColumn("fold", manifest.folded(F.col("leaf"), F.col("path"))).withColumn("sib", manifest.siblings(F.col("path"))).collect()
    assert Counter((str(x.doc_id), x.leaf, x.pos, x.subroot, x.root, tuple((y.left, y.right) for y in x.path)) for x in got) == want
    assert all(x.fold == x.root and x.sib == "".join(y.left + y.right for y in x.path) for x in got)


def test_manifest_of_awkward_tables(spark):
    leaf = manifest.leaf_hash(F.col("doc_id"), F.col("text")).alias("leaf")
    assert manifest.manifest(data.empty(spark).select("doc_id", "source", leaf)).count() == 0
    one = manifest.manifest(data.docs(spark).where("doc_id = 20").select("doc_id", "source", leaf)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == [] and one[0].pos == 0
    wide = data.docs(spark, extra=True).select("*", leaf).withColumn("g", F.lit(1)).withColumn("pos0", F.lit(2)).withColumn("m", F.lit(1)).withColumn("row", F.lit(1))
    assert manifest.manifest(wide).count() == len(data.rows())


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_runs", "op13_manifest"])
def test_queries_agree_with_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from lodestone.llm.queries import QUERIES

    r = random.Random(6)
    rows = [x for x in contaminated_rows() if x[0] is not None] + [(8000 + k, " ".join(f"w{x}" for x in repetitive(r, 4)), "en", "s", 1) for k in range(40)]
    spark.createDataFrame(rows, data.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert Counter(tuple(x) for x in got) == Counter(want.fetchall())
