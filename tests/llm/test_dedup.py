import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, embeddings, lines, simhash, substring

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 540)] + [(600, k) for k in range(601, 700)] + [(5, 5)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: t for n, t in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_covering_masks_miss_no_pair():
    tables, r = [m % 2**64 for m in simhash.masks(4)], random.Random(2)
    assert len(tables) == 31
    for _ in range(5000):
        x = sum(1 << b for b in r.sample(range(64), r.randrange(5)))
        assert any(x & m == 0 for m in tables)


def words_of(t):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")]


def slow_fingerprint(t):
    from xxhash import xxh64_intdigest

    w = words_of(t)
    h = [xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    r = random.Random(8)
    rows = data.rows()
    base = " ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(300))
    for k in range(60):
        w = base.split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "new"
        rows.append((1000 + k, " ".join(w), "en", "s", 1))
    got = simhash.near_duplicates(spark.createDataFrame(rows, data.SCHEMA)).collect()
    fp = [slow_fingerprint(t) for _, t, *_ in rows]
    up = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    ids = {}
    for k, t in up.items():
        if rows[k][0] is not None:
            ids[t] = min(ids.get(t, 10**9), rows[k][0])
    assert Counter((str(x.doc_id), x.fp % 2**64, x.component_id) for x in got) == Counter((str(r[0]), fp[k], ids.get(up[k])) for k, r in enumerate(rows))
    kept = simhash.one_of_each(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert len(kept) == len(set(up.values())) and kept[0].asDict().keys() == set(data.SCHEMA.names)
    assert simhash.near_duplicates(data.empty(spark)).count() == 0 and simhash.one_of_each(data.empty(spark)).count() == 0
    assert simhash.near_duplicates(data.docs(spark, extra=True)).count() == len(data.rows())


@pytest.mark.parametrize("block", [2048, 8])
def test_links_in_blocks_connect_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(4)
    fps = {0}
    for _ in range(6):
        c = r.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(40)}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((e.u ^ e.v) % 2**64).bit_count() <= 4 for e in got)
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4]
    assert roots(signed, [(e.u, e.v) for e in got]) == roots(signed, want)


def slow_substrings(rows, window):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    first, out = {}, {}
    for r in sorted(rows, key=key):
        w = WORD.findall(r[1] or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (key(r), k))
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (key(r), k) for j in range(window)}
        out.setdefault(key(r), (r[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return [out[key(r)] for r in rows]


@pytest.mark.parametrize("chunk", [250_000, 150])
def test_substrings_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    r = random.Random(6)
    rows = data.rows()
    vocab = [f"w{k}" for k in range(50)]
    passage, other = (" ".join(r.choice(vocab) for _ in range(n)) for n in (60, 25))
    for k in range(60):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randrange(40))), r.choice([passage, other, " ".join(passage.split()[r.randrange(20) :]), "", "x " * r.randrange(60), "p q " * r.randrange(30)]), " ".join(r.choice(vocab) for _ in range(r.randrange(30)))]
        r.shuffle(parts)
        rows.append((r.randrange(2000, 2040), "\n".join(parts), "en", "s", 1))
    df = spark.createDataFrame(rows, data.SCHEMA)
    hashed = [(x.doc_id, x.text, x.h) for x in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    got = substring.dedupe(df).collect()
    assert Counter((str(x.doc_id), x.n_words, x.n_removed, x.kept_text) for x in got) == Counter((str(i), *rest) for i, *rest in slow_substrings(hashed, 20))
    assert all(sum(s["to"] - s["from"] for s in x.removed) == x.n_removed for x in got)
    if chunk > 1000:
        assert substring.dedupe(data.empty(spark)).count() == 0
        assert substring.dedupe(data.docs(spark, extra=True)).count() == len(data.rows())


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    g = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        c = g.normal(size=16)
        rows += [(c + g.normal(size=16) * s).astype(np.float32).tolist() for s in g.uniform(0, 0.35, g.integers(1, 8))]
    rows += [rows[0]] * 40 + [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], []]
    ids = [None if k == 3 else 5 if k == 9 else k for k in range(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df.withColumn("row", F.lit(0)).withColumn("t", F.lit("x"))).collect()
    ok = lambda v: bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(v) if ok(v) else None for v in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n = Counter(k for p in pairs for k in p)
    found = sum(r.n_links for r in got) / 2
    assert len(got) == len(rows) and 0.97 * len(pairs) <= found <= len(pairs)
    up = roots(range(len(rows)), pairs)
    least = {}
    for k, t in up.items():
        if ids[k] is not None:
            least[t] = min(least.get(t, 10**9), ids[k])
    want = Counter((str(ids[k]), n[k], least.get(up[k]), ids[k] is not None and ids[k] == least.get(up[k])) for k in range(len(rows)))
    same = sum((want & Counter((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got)).values())
    assert same >= 0.95 * len(rows)
    none = embeddings.near_duplicates(df.where("vec_id is null and vec_id = 1"))
    assert none.count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def test_lines_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"word{k}" for k in range(80)]
    shared = [" ".join(r.choice(vocab) for _ in range(40)) for _ in range(6)]
    rows = data.rows()
    for k in range(50):
        ls = []
        for _ in range(r.randrange(1, 6)):
            w = r.choice(shared).split() if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randrange(1, 30))]
            if r.random() < 0.4:
                w[r.randrange(len(w))] = "Changed"
            ls.append("  ".join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((3000 + k, "\n".join(ls), "en", "s", 1))
    df = spark.createDataFrame(rows, data.SCHEMA)
    key = {(x.doc_id, x.text): x.h for x in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    places = sorted({(i is None, i or 0, key[i, t], p, line) for i, t, *_ in rows if t is not None for p, line in enumerate(t.split("\n"))})
    norm = lambda x: tuple(w.lower() for w in WORD.findall(x))
    first, gone = {}, set()
    got = lines.dedupe(df).collect()
    for *at, line in places:  # equal lines for sure go
        if len(norm(line)) >= 3:
            if norm(line) in first:
                gone.add(tuple(at))
            first.setdefault(norm(line), tuple(at))
    kept_words = {}
    for x in got:
        assert (x.text is None) == (x.kept_text is None) and x.n_lines == (0 if x.text is None else len(x.text.split("\n")))
        if x.text is None:
            continue
        at = (x.doc_id is None, x.doc_id or 0, key[x.doc_id, x.text])
        old, new, removed = x.text.split("\n"), x.kept_text.split("\n") if x.n_removed < x.n_lines else [], []
        k = 0
        for p, line in enumerate(old):
            if k < len(new) and new[k] == line and len(old) - p > 0 and (*at, p) not in gone:
                k += 1
                kept_words.setdefault(norm(line), at)
            else:
                removed.append(p)
        assert len(removed) == x.n_removed
        for p in removed:  # equal to an earlier line, or near another
            n = norm(old[p])
            assert len(n) >= 3 and ((*at, p) in gone or any(o != n and edit(n, o) <= 0.2 * max(len(n), len(o)) for o in first))
    # the near lines are mostly found
    near = [n for n in first if any(o != n and edit(n, o) <= 2 for o in first) and len(n) > 30]
    assert len(near) > 20 and sum(n in kept_words for n in near) < 0.8 * len(near)
    assert lines.dedupe(data.empty(spark)).count() == 0
    assert lines.dedupe(data.docs(spark, extra=True).withColumn("line", F.lit(1)).withColumn("root", F.lit(1))).count() == len(data.rows())


def test_every_near_line_is_linked(spark):
    r = random.Random(12)
    rows = []
    for size in [*range(1, 28), 40, 75, 120] * 2:
        base = [f"v{r.randrange(4000)}" for _ in range(size)]
        rows.append(base)
        for _ in range(4):  # up to the edits that the similarity allows, and one more
            w = list(base)
            for _ in range(r.randrange(1, size // 5 + 2)):
                k, new = r.randrange(len(w)), f"n{r.randrange(4000)}"
                w[k : k + 1] = r.choice([[new], [], [w[k], new]]) if len(w) > 1 else [new]
            rows.append(w)
    hot = [f"h{k}" for k in range(12)]  # a bucket of many lines: a few near each other, most not
    rows += [hot[:5] + [f"o{r.randrange(10**6)}" for _ in range(7)] for _ in range(60)]
    rows += [[*hot[:k], f"c{j}", *hot[k + 1 :]] for k in range(12) for j in range(5)]
    rows += [[f"a{k}"] * k + [f"b{j}"] for k in range(3, 12) for j in range(4)] + [["t", "u"] * 6 + [f"e{j}"] for j in range(40)]  # words that come again
    rows = sorted({tuple(w) for w in rows})
    codes = [lines.coded([x.encode() for x in w]) for w in rows]
    df = spark.createDataFrame([(k, len(w), bytearray(a.tobytes()), bytearray(b.tobytes())) for k, (w, (a, b)) in enumerate(zip(rows, codes))], "line long, size int, a binary, b binary")
    got = lines.links(df, 0.8).collect()
    sizes = [len(w) for w in rows]
    close = lambda a, b: abs(sizes[a] - sizes[b]) <= (m := int(0.2 * max(sizes[a], sizes[b]) + 1e-9)) and edit(rows[a], rows[b]) <= m
    want = [(a, b) for b in range(len(rows)) for a in range(b) if set(rows[a]) & set(rows[b]) and close(a, b)]
    assert len(want) > 1000 and all(close(x.u, x.v) for x in got)
    assert roots(range(len(rows)), [(x.u, x.v) for x in got]) == roots(range(len(rows)), want)


def test_near_lines_of_a_table_all_go(spark):
    r = random.Random(13)
    rows = []
    for k in range(40):
        base = [f"v{r.randrange(4000)}" for _ in range(20)]
        for j in range(3):
            w = list(base)
            for at in r.sample(range(20), 2 * (j > 0)):
                w[at] = f"n{r.randrange(4000)}"
            rows.append((10 * k + j, " ".join(w), "en", "s", 1))
    got = {x.doc_id: x.n_removed for x in lines.dedupe(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    assert got == {k: int(k % 10 > 0) for k in got} and len(got) == 120


@pytest.mark.parametrize("n", [50_000, 10**6, 10**7, 10**8])
def test_embedding_tables_reach_the_recall(n):
    length, tables = embeddings.plan(n, 64, 0.95, 0.995)
    masks = np.array(embeddings.substrings(64, length, tables), np.uint64)
    g = np.random.default_rng(7)
    x, y = g.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1)[:, None]  # pairs at the threshold, in any direction
    code = [np.packbits(v >= 0, axis=1, bitorder="little").view(np.uint64).ravel() for v in (x, y)]
    met = ((code[0] ^ code[1])[:, None] & masks == 0).any(axis=1)
    assert met.mean() >= 0.992
    assert embeddings.plan(n, 2, 0.95, 0.995) == (0, 1) and embeddings.substrings(2, 0, 1) == [0]


def test_vectors_follow_near_codes_only(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(2000, 64))
    pairs = x[:40] + g.normal(size=(40, 64)) * 0.1
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, pairs]))]
    moved = []
    real = embeddings.written

    def counted(df):
        out = real(df)
        if set(out.columns) >= {"t", "block", "code"}:
            moved.append(out.count())
        return out

    embeddings.written = counted
    try:
        got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    finally:
        embeddings.written = real
    assert sum(r.n_links for r in got) == 80 and sum(not r.kept for r in got) == 40
    length, tables = embeddings.plan(2040, 64, 0.95, 0.995)
    assert moved and moved[0] < 0.1 * 2040 * tables
    assert embeddings.radius(64, 0.95) < 20 and embeddings.radius(1, 0.95) <= 1
