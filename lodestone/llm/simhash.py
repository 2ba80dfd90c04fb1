"""SimHash near-duplicates by covering locality-sensitive hashing (operator 7).

Every bit position gets a nonzero vector of radius + 1 bits. A table belongs to each nonzero vector v of that space; its
mask holds the positions whose vector has an odd product with v. Positions in which two fingerprints differ, at most
`radius` of them, span too little to reach every v, so some table's mask avoids them all: the pair meets there for sure.

Fingerprints are linked once each, however many documents carry them. In a table's bucket a search through the
remaining members yields a spanning forest of the links, never all pairs; buckets over ``BLOCK`` members are divided into
blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, iter_runs, run_starts, written

BLOCK = 2048
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text: each bit is the majority of that bit over the hashes of its word shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    whole = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks, as signed 64-bit numbers: 2^(radius + 1) - 1 tables."""
    n = 2 ** (radius + 1) - 1
    out = [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]
    return [x - 2**64 if x >= 2**63 else x for x in out]


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints ``x``: each member searches only what isn't reached yet."""
    edges, left = [], np.arange(1, len(x))
    frontier = [0]
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        i = frontier.pop()
        near = np.bitwise_count(x[left] ^ x[i]) <= radius
        hit = left[near].tolist()
        edges += [(i, j) for j in hit]
        frontier += hit
        left = left[~near]
    return edges


def linked(table: pa.Table, keys: list[str], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the key groups of a table with a column ``fp``."""
    x = table.column("fp").to_numpy().view(np.uint64)
    starts = run_starts(table, keys)
    sizes = np.diff(np.r_[starts, len(x)])
    head = np.repeat(starts, sizes)
    near = np.bitwise_count(x ^ x[head]) <= radius
    star = np.logical_and.reduceat(near, starts)  # all of the group is near its first member
    pick = np.repeat(star, sizes) & (np.arange(len(x)) != head)
    us, vs = [x[head[pick]]], [x[pick]]
    for a, n in zip(starts[~star].tolist(), sizes[~star].tolist()):
        if edges := forest(x[a : a + n], radius):
            i, j = np.array(edges).T
            us.append(x[a + i])
            vs.append(x[a + j])
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fps(fp)``, distinct, to edges ``(u, v)`` that connect what links of at most ``radius`` bits connect."""
    tables = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))]
    rows = fps.select("fp", F.explode(F.array(*tables)).alias("x")).select("x.t", "x.key", "fp")
    schema = "t int, key long, c int, u long, v long"

    def batch(t, key, c, u, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(key, pa.int64()), pa.array(c, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["t", "key", "c", "u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole groups up to BLOCK members are linked here; of larger ones, members are passed on with a block's number
        held: list[pa.Table] = []
        big, block = None, 0  # the key of a group that is being passed on

        def pass_on(table: pa.Table) -> pa.RecordBatch:
            n = table.num_rows
            return batch(table.column("t").combine_chunks(), table.column("key").combine_chunks(), np.full(n, block, np.int32), table.column("fp").combine_chunks(), pa.nulls(n, pa.int64()))

        def edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = run_starts(table, ["t", "key"])
            sizes = np.diff(np.r_[starts, table.num_rows])
            table = table.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if table.num_rows:
                u, v = linked(table, ["t", "key"], radius)
                yield batch(pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int32()), u, v)

        for got in batches:
            table = pa.Table.from_batches([got])
            for k in range(0, table.num_rows, BLOCK):
                part = table.slice(k, BLOCK)
                starts = run_starts(part, ["t", "key"])
                first, last = [(part.column("t")[i].as_py(), part.column("key")[i].as_py()) for i in (0, int(starts[-1]))]
                if big is not None:
                    if first == big:
                        end = int(starts[1]) if len(starts) > 1 else part.num_rows
                        block += 1
                        yield pass_on(part.slice(0, end))
                        if end == part.num_rows:
                            continue
                        part, starts = part.slice(end), starts[1:] - end
                    big = None
                whole = pa.concat_tables([*held, part])
                starts = run_starts(whole, ["t", "key"])
                tail = int(starts[-1])
                if tail:
                    yield from edges(whole.slice(0, tail))
                whole = whole.slice(tail)
                held = [whole]
                if whole.num_rows > BLOCK:
                    big, block, held = last, 0, []
                    yield pass_on(whole)
        if held:
            yield from edges(pa.concat_tables(held))

    found = written(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(search, schema))
    out = found.where("v is not null").select("u", "v")
    large = found.where("v is null").select("t", "key", "c", F.col("u").alias("fp"))
    blocks = large.groupBy("t", "key").agg((F.max("c") + 1).alias("n"))
    pairs = large.join(blocks, ["t", "key"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in iter_runs(batches, ["t", "key", "i", "j"]):
            u, v = linked(table, ["t", "key", "i", "j"], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    more = pairs.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(block_pairs, "u long, v long")
    return out.unionAll(more).distinct()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fp``, the signed 64-bit SimHash of the whole text (0 without words or for null)."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, text_key, root, component_id``.

    Fingerprints within ``radius`` bits are linked, those of empty and null texts (zero) like any other. component_id is the
    smallest doc_id reachable; rows without a doc_id count for connection only, and a component of such rows alone has none.
    Repeated rows stay repeated; an empty table gives an empty result.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = written(fingerprints(named).drop("text"))
    roots = written(components(links(rows.select("fp").distinct(), radius)))
    # a row a fingerprint first, however many rows have it; then rows look up their own
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    own = written(own.join(roots, own.fp == roots.node, "left").select(F.col("fp").alias("of"), "least", F.coalesce("root", "fp").alias("root")))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(least, "root").select("of", "root", "component_id")
    return rows.join(own, rows.fp == own.of).select("doc_id", "fp", "text_key", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id (null last), then of the smallest text hash."""
    found = near_duplicates(docs, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x")
    heads = found.groupBy("root").agg(first).select(F.col("x.doc_id").alias("__d"), F.col("x.text_key").alias("__t"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__t"))
    kept = docs.withColumn("__k", F.xxhash64("text")).join(heads, same, "left_semi").drop("__k")
    return kept.dropDuplicates(["doc_id", "text"])
