import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, mixing, quality, sharding
from lodestone.llm.queries import ORACLES

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(spark):
    got = sharding.shard(data.docs(spark, extra=True), 4).collect()
    key = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in got) == Counter(key(r[0], r[1]) for r in data.rows())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(data.empty(spark)).count() == 0


def test_shards_are_even_with_a_hot_row(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "same").otherwise(F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("text"))
    sums = [r.b for r in sharding.shard(df, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) < 1.05 * min(sums)


def test_mix_comes_near_its_targets(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = mixing.mix(df).collect()
    assert len(got) == 5000 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, target, size = Counter(), {}, {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    names = sorted((s for s in size if s is not None)) + [None]
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full, goal = 1.5 * sum(size.values()), set(), {}
    while True:  # reshare until none is above
        open_ = [s for s in names if s not in full]
        goal = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if goal[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            left -= 2 * size[s]
    assert all(target[s] == pytest.approx(goal.get(s, 2 * size[s])) for s in names)
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)


def test_mix_awkward_rows(spark):
    got = mixing.mix(data.docs(spark, extra=True)).collect()
    assert Counter((str(r.doc_id), r["size"]) for r in got) == Counter((str(r[0]), len(WORD.findall(r[1] or ""))) for r in data.rows())
    assert mixing.mix(data.empty(spark)).count() == 0 and mixing.mixed_documents(data.empty(spark)).count() == 0
    only = mixing.mix(data.docs(spark).where("text is null"))
    assert [r.taken for r in only.collect()] == [0, 0]


def test_quality_counts(spark):
    rows = data.rows() + [(900, "a b c d e f a b c d e g h i j a b c d e", "en", "s", 1), (901, "x " * 40, "en", "s", 1)]
    got = quality.clean(spark.createDataFrame(rows, data.SCHEMA)).collect()
    want = Counter()
    for i, t, *_ in rows:
        w, t = WORD.findall(t or ""), t or ""
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        rep = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(str(i), len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))] += 1
    assert Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.cleaned is None or len(r.cleaned) <= len(r.text) for r in got)
    assert quality.clean(data.empty(spark)).count() == 0
    assert quality.clean(data.docs(spark, extra=True)).count() == len(data.rows())


def test_quality_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    documents = data.docs(spark).toPandas()  # noqa: F841
    c.register("documents", documents)
    got = quality.clean(data.docs(spark)).selectExpr("cast(doc_id as double) doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").toPandas()
    want = c.execute(ORACLES["op9_quality"]).df()
    show = lambda d: sorted(map(str, d.astype(str).values.tolist()))
    assert show(got) == show(want[list(got.columns)])


def test_scratch_is_discarded(spark):
    common.discard_scratch(spark)
    made = common.written(spark.range(5))
    spark.range(3).write.parquet(f"{common.SCRATCH[-1]}-named")
    assert made.count() == 5 and spark.read.parquet(f"{common.SCRATCH[-1]}-named").count() == 3
    where = spark._jvm.org.apache.hadoop.fs.Path(common.SCRATCH[-1])
    assert common.discard_scratch(spark) == 2 and common.SCRATCH == []
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) and common.discard_scratch(spark) == 0
