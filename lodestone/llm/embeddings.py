"""Embedding near-dedup (operator 10): iterative quantisation, multi-index Hamming tables, and a rerank by the vectors.

A rotation is learned on a bounded sample so that the signs of the rotated unit vectors are balanced binary codes. Tables
are keyed by substrings of the code; how long and how many follows from the number of vectors and the recall asked for.
Tables hold codes only: of a bucket's members those come with their vectors whose whole code is near another's, and these are
compared by cosine in double precision. A pair that several tables hold counts in
the first of them. Equal vectors are one vector with a count before they are dealt, so copies cost no comparison. A bucket
yields each member's number of links and a spanning forest, never pairs; buckets over ``BLOCK`` members are divided into
blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import components, iter_runs, run_starts, written

BLOCK = 2048
#: Tables to choose from, and how many comparisons a row costs that is moved.
MOST, MOVE = 4096, 100
#: The longest substring.
LONGEST = 40
#: The most vectors (about) on which a rotation is learned.
SAMPLE = 20_000


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Iterative quantisation: principal directions, then a rotation that brings the projections close to their signs."""
    d = x.shape[1]
    if len(x) < 2:
        return np.eye(d)[:, :bits]
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :bits]
    v = x @ basis
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return basis @ r


def substrings(bits: int, length: int, tables: int) -> list[int]:
    """Bit masks of the tables: slices of the code, then of shuffled codes."""
    if not length:
        return [0]
    out, n = [], 0
    while len(out) < tables:
        order = np.arange(bits) if n == 0 else np.random.default_rng(n).permutation(bits)
        out += [sum(1 << int(b) for b in order[k : k + length]) for k in range(0, bits - length + 1, length)]
        n += 1
    return out[:tables]


def missed(bits: int, length: int, tables: int, threshold: float) -> float:
    """The share of pairs at the threshold that meet in none of ``substrings``: a sum over the number of bits in which they differ.

    Slices of one order of the bits share no bit, so that none of them is free of k differing bits follows by
    inclusion and exclusion; the orders are independent of each other given k.
    """
    p, each, out = math.acos(threshold) / math.pi, bits // length, 0.0
    for k in range(bits + 1):
        none = lambda s: sum((-1) ** j * math.comb(s, j) * math.comb(bits - j * length, k) for j in range(s + 1)) / math.comb(bits, k)  # noqa: E731, B023
        out += math.comb(bits, k) * p**k * (1 - p) ** (bits - k) * none(each) ** (tables // each) * none(tables % each)
    return out


def plan(n: int, bits: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, tables): the cheapest by rows moved and vectors compared of which a pair at the threshold is missed with 1 - recall; (0, 1), one table of all vectors, where none does."""
    best = (math.inf, 0, 1)
    for length in range(1, min(bits, LONGEST) + 1):
        if missed(bits, length, MOST, threshold) > 1 - recall:
            continue
        low, high = 1, MOST
        while low < high:
            at = (low + high) // 2
            low, high = (low, at) if missed(bits, length, at, threshold) <= 1 - recall else (at + 1, high)
        best = min(best, (low * (MOVE + n / 2**length), length, low))
    return best[1:]


def radius(bits: int, threshold: float, lost: float = 1e-4) -> int:
    """The number of bits in which all but ``lost`` of the pairs at the threshold differ at most."""
    p, left = math.acos(threshold) / math.pi, 1.0
    for k in range(bits + 1):
        left -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if left <= lost:
            return k
    return bits


def worth(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The members of a bucket, or pair of blocks of one, whose code is within ``most`` bits of another member's: their vectors are needed."""
    keys = ["t", "key", "i", "j"]
    for table in iter_runs(batches, keys):
        starts = run_starts(table, keys)
        code, block, i_, j_ = (table.column(k).to_numpy() for k in ("code", "block", "i", "j"))
        code, keep = code.view(np.uint64), np.zeros(table.num_rows, bool)
        for a, b in zip(starts.tolist(), np.r_[starts[1:], table.num_rows].tolist()):
            for k in range(a, b, 256) if b - a > 1 else ():  # some rows of the matrix at a time
                near = np.bitwise_count(code[k : min(k + 256, b), None] ^ code[None, a:b]) <= most
                near[np.arange(len(near)), np.arange(k - a, k - a + len(near))] = False
                if i_[a] != j_[a]:
                    near &= block[k : min(k + 256, b), None] != block[None, a:b]
                keep[k : k + len(near)] = near.any(axis=1)
        yield from table.filter(pa.array(keep)).to_batches()


def search(batches: Iterator[pa.RecordBatch], masks: list[int], threshold: float, kind: type) -> Iterator[pa.RecordBatch]:
    """For each bucket, or pair of blocks of one: how many links count here, by row, and edges that connect them."""
    keys, marks = ["t", "key", "i", "j"], np.array(masks, np.uint64)
    for table in iter_runs(batches, keys):
        starts = run_starts(table, keys)
        sizes = np.diff(np.r_[starts, table.num_rows])
        table = table.filter(pa.array(np.repeat(sizes > 1, sizes)))
        if not table.num_rows:
            continue
        starts = run_starts(table, keys)
        rows, block, code, ts = (table.column(k).to_numpy() for k in ("row", "block", "code", "t"))
        i_, j_, copies = (table.column(k).to_numpy() for k in ("i", "j", "copies"))
        code = code.view(np.uint64)
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(len(rows), -1).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        out: list[np.ndarray] = []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(rows)].tolist()):
            near = x[a:b] @ x[a:b].T >= threshold
            np.fill_diagonal(near, False)
            if i_[a] != j_[a]:  # a pair of blocks: links within a block count where the block is alone
                near &= block[a:b, None] != block[None, a:b]
            p, q = np.nonzero(near)
            if not len(p):
                continue
            first = np.ones(len(p), bool)
            differ = code[a:b][p] ^ code[a:b][q]
            for m in marks[: ts[a]]:
                first &= (differ & m) != 0
            n = np.bincount(p[first], weights=copies[a:b][q[first]], minlength=b - a).astype(np.int64)
            at = np.flatnonzero(n)
            out.append(np.stack([rows[a:b][at], np.full(len(at), -1), n[at]]))
            edges, left, frontier = [], np.arange(b - a), []
            while len(left):
                if not frontier:
                    frontier, left = [int(left[0])], left[1:]
                    continue
                k = frontier.pop()
                hit = near[k, left]
                edges += [(k, v) for v in left[hit].tolist()]
                frontier += left[hit].tolist()
                left = left[~hit]
            if edges:
                u, v = rows[a:b][np.array(edges).T]
                out.append(np.stack([u, v, np.zeros(len(u), np.int64)]))
        if out:
            u, v, n = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, zero or hold null or non-finite components link with nothing; so do vectors of different
    length with each other. Rows of one vec_id are vectors of their own. Cosines are in double precision. component_id is the smallest vec_id reachable, the
    own one included; null ids count for connection only. An empty table gives an empty result.
    """
    e, kind = F.col("embedding"), "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    same = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("b")).alias("same")  # 128 bits stand for a vector
    rows = vectors.select("vec_id", F.when(ok, e.cast(f"array<{kind}>")).alias("embedding")).select("vec_id", "embedding", same)
    rows = written(rows.withColumn("same", F.when(F.col("embedding").isNotNull(), F.col("same"))))
    each = rows.where("same is not null").groupBy("same").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("id"))
    each = written(each.withColumn("row", F.monotonically_increasing_id()))
    found = []
    for r in each.groupBy(F.size("embedding").alias("d")).count().collect():  # a row for each length of vector
        found.append(of_length(each.where(F.size("embedding") == r.d), r.d, r["count"], threshold, recall, sample))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found[0]
    for x in found[1:]:
        links = links.unionAll(x)
    counts = links.where("v < 0").groupBy("u").agg(F.sum("n").alias("n_links"))
    roots = written(components(links.where("v >= 0").select("u", "v")))
    at = each.drop("embedding").join(roots, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row"))
    ids = at.groupBy("root").agg(F.min("id").alias("component_id"))
    of = at.join(ids, "root").join(counts, F.col("row") == F.col("u"), "left").select(F.col("same").alias("of"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "same").join(of, F.col("same") == F.col("of"), "left")
    least = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(False)).alias("kept"))


def of_length(valid: DataFrame, d: int, n: int, threshold: float, recall: float, sample: int) -> DataFrame:
    """The links among ``n`` vectors of length ``d``, written: ``(u, -1, n)`` counts and ``(u, v, 0)`` edges of rows."""
    part = valid.where(F.pmod(F.xxhash64("row"), F.lit(2**31)) < F.lit(int(min(1.0, sample / n) * 2**31))).limit(2 * sample)
    x = np.array([r.embedding for r in part.select("embedding").collect()], np.float64).reshape(-1, d)  # a bounded sample
    x /= np.linalg.norm(x, axis=1)[:, None]
    bits, kind = min(64, d), np.float32 if valid.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    rotation = learn_rotation(x, bits)
    length, tables = plan(n, bits, threshold, recall)
    masks = substrings(bits, length, tables)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("embedding").flatten().to_numpy().reshape(-1, d)
            u = v.astype(np.float64)
            signs = (u / np.linalg.norm(u, axis=1)[:, None]) @ rotation >= 0
            packed = np.zeros((len(v), 64), bool)
            packed[:, :bits] = signs
            code = np.packbits(packed, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("copies"), pa.array(code), pa.array([x.tobytes() for x in v], pa.binary())], ["row", "copies", "code", "vec"])

    coded = written(valid.select("row", "copies", "embedding").mapInArrow(codes, "row long, copies long, code long, vec binary"))
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keyed = [F.struct(F.lit(k).alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)]
    members = coded.withColumn("x", F.explode(F.array(*keyed))).select("x.t", "x.key", "row", "copies", "code")
    large = written(members.groupBy("t", "key").count().where(F.col("count") > BLOCK).select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = members.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "row", "copies", "code")
    near = radius(bits, threshold)
    groups = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    found = written(groups.mapInArrow(lambda b: worth(b, near), "t int, key long, i int, j int, block int, row long, copies long, code long"))
    groups = found.join(coded.select("row", "vec"), "row").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return written(groups.mapInArrow(lambda b: search(b, masks, threshold, kind), "u long, v long, n long"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.v, r.root FROM r JOIN l ON r.vec_id = l.u),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.u
"""
