"""Substring dedup (operator 1): repeats of at least 20 words, by prefix-partitioned suffix trees.

A suffix starts at every word. Those that may repeat are dealt to groups by a variable-length prefix (1, 2, 4, 8, 16 or 20
words, as short as its share of all suffixes allows). The number of groups follows from the size of the texts, so that each
fits a task's memory; a task works them off one after another. In a group the suffixes that share their first 20 words
stand together: a node of depth 20 with two or more leaves is a repeat; all but its first leaf's words are removed.
Neighbouring repeats of a document merge to maximal ones. Nodes are told apart, and ordered, by a 128-bit fingerprint of
their path, as the words themselves would not fit the disk budget; nothing needs the order of the words.

Which suffixes may repeat: of the 8-word grams in a 20-word window, the one of the smallest hash is the same wherever the
window occurs. Windows whose smallest gram occurs at one place only are unique, and most are.

What a batch of texts repeats within itself is settled in it; only its first occurrences are compared with other
batches. So a passage that very many documents share costs a group no more than one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

GRAM = 8
LEVELS = (1, 2, 4, 8, 16, 20)
#: Words that are worked on at once.
CHUNK = 250_000
#: Characters of text for each group of suffixes: some 16 MB of suffixes, if all may repeat.
GROUP = 4_000_000
U64 = np.uint64
MAX = U64(2**64 - 1)


def mixed(a: np.ndarray, b: np.ndarray | int, seed: int) -> np.ndarray:
    """A hash of two 64-bit hashes, in order."""
    with np.errstate(over="ignore"):
        c = [U64((0x9E3779B97F4A7C15 * (2 * seed + k) + 0xD1B54A32D192ED03) % 2**64 | 1) for k in (1, 2, 3)]
        x = a * c[0] + (b * c[1] if isinstance(b, np.ndarray) else U64(b))
        x = (x ^ (x >> U64(29))) * c[2]
        return x ^ (x >> U64(32))


def shifted(a: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([a[k:], np.zeros(min(k, len(a)), a.dtype)])


def sequence_hashes(h: np.ndarray, window: int, seed: int) -> dict[int, np.ndarray]:
    """Hashes of the first 1, 2, 4, ... words of every suffix, and of ``window`` words."""
    out, k = {1: h}, 1
    while 2 * k <= window:
        out[2 * k] = mixed(out[k], shifted(out[k], k), seed + k)
        k *= 2
    x, at = out[k], k
    while at < window:
        step = max(n for n in out if n <= window - at)
        x = mixed(x, shifted(out[step], at), seed + 64 + at)
        at += step
    out[window] = x
    return out


def least(a: np.ndarray, n: int) -> np.ndarray:
    """The least of a[i : i + n] for each i; entries past the end don't count."""
    k = 1
    while 2 * k <= n:
        a = np.minimum(a, np.concatenate([a[k:], np.full(min(k, len(a)), MAX)]))
        k *= 2
    if k < n:
        a = np.minimum(a, np.concatenate([a[n - k :], np.full(min(n - k, len(a)), MAX)]))
    return a


class Chunk:
    """The words of some whole documents as hashes, with the order of the documents."""

    def __init__(self, ids: list, xs: list, texts: list[list[bytes]], window: int):
        from xxhash import xxh3_64_intdigest

        self.ids, self.xs, self.window = ids, xs, window
        lens = np.array([len(t) for t in texts], np.int64)
        n = int(lens.sum())
        h = np.fromiter((x for t in texts for x in map(xxh3_64_intdigest, t)), U64, n)
        self.doc = np.repeat(np.arange(len(ids)), lens)
        first = np.cumsum(lens) - lens
        self.pos = np.arange(n) - first[self.doc]
        room = lens[self.doc] - self.pos
        self.hash = sequence_hashes(h, window, 0)
        self.h = h
        self.start = room >= window  # a window starts here
        gram = mixed(self.hash[GRAM], 0, 400)
        gram[room < GRAM] = MAX
        self.gram = np.minimum(gram, MAX - U64(1))
        self.gram[room < GRAM] = MAX
        self.low = least(self.gram, window - GRAM + 1)  # the least gram of the window; no window reaches past its text

    def rank(self) -> np.ndarray:
        """The documents' places by (doc_id, null last; text hash); equal ones share a place."""
        order = sorted(range(len(self.ids)), key=lambda k: self.key(k))
        out, at = np.zeros(len(order), np.int64), -1
        for n, k in enumerate(order):
            at += n == 0 or self.key(k) != self.key(order[n - 1])
            out[k] = at
        return out

    def key(self, k: int) -> tuple:
        return (self.ids[k] is None, self.ids[k] or 0, self.xs[k])


def chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Chunk, list]]:
    """Documents (doc_id, x, text, ...) gathered to about CHUNK words; with the rest of the columns."""
    rows, n = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            words = row[2].encode().split() if row[2] else []
            if len(words) >= window:
                rows.append((*row[:2], words, row[3:]))
                n += len(words)
            if n >= CHUNK:
                yield Chunk(*map(list, list(zip(*rows))[:3]), window), [r[3] for r in rows]
                rows, n = [], 0
    if rows:
        yield Chunk(*map(list, list(zip(*rows))[:3]), window), [r[3] for r in rows]


def pack(arrays: list[np.ndarray], chunk: Chunk, doc: np.ndarray) -> bytes:
    """Columns of equal length, and the documents they name, as one value."""
    used, at = np.unique(doc, return_inverse=True)
    ids = np.array([chunk.ids[k] or 0 for k in used.tolist()], np.int64)
    none = np.array([chunk.ids[k] is None for k in used.tolist()], np.int64)
    xs = np.array([chunk.xs[k] for k in used.tolist()], np.int64)
    head = np.array([len(used), len(doc)], np.int64)
    return b"".join(x.tobytes() for x in (head, ids, none, xs, at.astype(np.uint32), *arrays))


def unpack(blobs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """Of many packed values: doc_id, null, text hash and the columns, each as one array."""
    parts: list[list[np.ndarray]] = [[] for _ in range(3 + len(kinds))]
    for data in blobs:
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        docs = np.frombuffer(data, np.int64, 3 * n, 16).reshape(3, n)
        at = np.frombuffer(data, np.uint32, m, 16 + 24 * n)
        for k in range(3):
            parts[k].append(docs[k][at])
        off = 16 + 24 * n + 4 * m
        for k, kind in enumerate(kinds):
            parts[3 + k].append(np.frombuffer(data, kind, m, off))
            off += m * np.dtype(kind).itemsize
    kinds = [np.int64] * 3 + list(kinds)
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds)]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def place_bucket(ids: np.ndarray, xs: np.ndarray, n: int) -> np.ndarray:
    return (mixed(ids.view(U64), xs.view(U64), 500) % U64(n)).astype(np.int64)


def known_places(c: Chunk, at: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows of kind 2 that bring the positions ``at`` of a chunk to their documents' buckets."""
    ids, xs = np.array([i or 0 for i in c.ids], np.int64), np.array(c.xs, np.int64)
    of = place_bucket(ids, xs, n_buckets)[c.doc[at]]
    return [(b, 2, None, None, pack([c.pos[at[part]].astype(np.uint32)], c, c.doc[at[part]]), None) for b, part in by_bucket(of)]


def to_documents(ids: np.ndarray, none: np.ndarray, xs: np.ndarray, pos: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows of kind 2 that bring positions to their documents' buckets, a row for each bucket."""
    out = []
    for b, part in by_bucket(place_bucket(ids, xs, n_buckets)):
        head = np.array([len(part), len(part)], np.int64)
        out.append((b, 2, None, None, b"".join(x.tobytes() for x in (head, ids[part], none[part], xs[part], np.arange(len(part), dtype=np.uint32), pos[part].astype(np.uint32))), None))
    return out


def groups(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[pa.RecordBatch | None, list[bytes]]]:
    """From batches in order of the bucket: the rows of other kinds as they come, and the packed values of each bucket's rows of ``kind``."""
    now, blobs = None, []
    for b in batches:
        kinds = b.column("kind").to_numpy()
        if (kinds != kind).any():
            yield b.filter(pa.array(kinds != kind)), []
        mine = b.filter(pa.array(kinds == kind))
        for bucket, data in zip(mine.column("bucket").to_pylist(), mine.column("data").to_pylist()):
            if bucket != now and blobs:
                yield None, blobs
                blobs = []
            now = bucket
            blobs.append(data)
    if blobs:
        yield None, blobs


class Outgoing:
    """Positions on their way to documents' buckets, sent on when many have come together, over groups."""

    def __init__(self, n_buckets: int, most: int = 1_000_000):
        self.n_buckets, self.most, self.parts, self.n = n_buckets, most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield batch(to_documents(*map(np.concatenate, zip(*self.parts)), self.n_buckets))
        self.parts, self.n = [], 0


def dealt(rows: DataFrame, n_parts: int) -> DataFrame:
    """Rows by bucket, each bucket's together."""
    return rows.repartition(n_parts, "bucket").sortWithinPartitions("bucket")


def gathered(rows: DataFrame, n_parts: int) -> DataFrame:
    """Rows of kind 2, packed by bucket, to one row for each document; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, blobs in groups(batches, 2):
            if other is not None:
                yield other
                continue
            out = [(0, 2, i, x, places, None) for i, x, places in by_document(*unpack(blobs, [np.uint32]))]
            for k in range(0, len(out), 10_000):
                yield batch(out[k : k + 10_000])

    return dealt(rows, n_parts).mapInArrow(run, SCHEMA)


def by_document(ids: np.ndarray, none: np.ndarray, xs: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
    """(doc_id, x, positions) for each document."""
    if not len(ids):
        return
    order = np.lexsort((xs, ids, none))
    ids, none, xs, pos = ids[order], none[order], xs[order], pos[order]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(none) != 0) | (np.diff(xs) != 0)) + 1
    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist()):
        yield None if none[a] else int(ids[a]), int(xs[a]), pos[a:b].astype(np.uint32).tobytes()


SCHEMA = "bucket long, kind int, doc_id long, x long, data binary, counts array<long>"


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "kind", "doc_id", "x", "data", "counts"])


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The repeated windows of ``docs(doc_id, x, text)``: ``doc_id, x, starts``, word positions as packed 32-bit numbers.

    ``x`` is a hash of the text; it tells apart documents of one doc_id, or of none, and orders them.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(4 * n_parts, -(-chars // GROUP))
    bins = min(2**20, max(4096, 1 << (8 * n_buckets).bit_length()))
    levels = [n for n in LEVELS if n < window] + [window]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(levels), bins), np.int64)
        for c, _ in chunks(batches, window):
            for k, n in enumerate(levels):
                counts[k] += np.bincount((c.hash[n][c.start] >> U64(44)).astype(np.int64) % bins, minlength=bins)
            # a gram is an anchor if it is the least of some window
            top = np.where(c.start, c.low, U64(0))
            span = window - GRAM + 1
            back = MAX - least((MAX - top)[::-1], span)[::-1]
            at = np.flatnonzero((back == c.gram) & (c.gram != MAX))
            g = c.gram[at]
            order = np.argsort(g, kind="stable")
            same = np.r_[False, np.diff(g[order]) == 0] if len(g) else np.zeros(0, bool)
            head = order[~same]
            known = np.zeros(len(g), bool)  # met twice in this batch
            known[order[same]] = True
            nxt = np.r_[same[1:], False] if len(g) else same
            known[order[nxt]] = True
            rows = []
            some = at[known]
            rows += known_places(c, some, n_buckets)
            once = at[head]
            for b, part in by_bucket((c.gram[once] % U64(n_buckets)).astype(np.int64)):
                sel = once[part]
                rows.append((b, 0, None, None, pack([c.gram[sel], c.pos[sel].astype(np.uint32)], c, c.doc[sel]), None))
            yield batch(rows)
        yield batch([(k, 1, None, None, None, n.tolist()) for k, n in enumerate(counts)])

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, out = {}, Outgoing(n_buckets)
        for other, blobs in groups(batches, 0):
            if other is not None:
                part = other.filter(pa.array(other.column("kind").to_numpy() == 1))
                for k, n in zip(part.column("bucket").to_pylist(), part.column("counts").to_pylist()):
                    counts[k] = counts.get(k, 0) + np.array(n, np.int64)
                yield other.filter(pa.array(other.column("kind").to_numpy() == 2))
                continue
            ids, none, xs, g, pos = unpack(blobs, [U64, np.uint32])
            order = np.argsort(g, kind="stable")
            same = np.diff(g[order]) == 0
            twice = order[np.r_[same, False] | np.r_[False, same]] if len(g) else order
            yield from out.add(ids[twice], none[twice], xs[twice], pos[twice])
        yield from out.rest()
        yield batch([(k, 1, None, None, None, n.tolist()) for k, n in counts.items()])

    # counts and candidate places are written: what follows reads them, whatever executors are lost
    first = written(gathered(dealt(docs.mapInArrow(grams, SCHEMA), n_parts).mapInArrow(hot, SCHEMA), n_parts))
    heavy = np.zeros((len(levels), bins), bool)
    for r in first.where("kind = 1").select("bucket", "counts").collect():  # a row of `bins` numbers for each level
        n = np.array(r.counts)
        heavy[r.bucket] = n > n.sum() / (4 * n_buckets)

    p = first.where("kind = 2").select(F.col("doc_id").alias("__d"), F.col("x").alias("__x"), F.col("data").alias("places"))
    found = docs.join(p, docs.doc_id.eqNullSafe(F.col("__d")) & (docs.x == F.col("__x"))).select("doc_id", "x", "text", "places")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, more in chunks(batches, window):
            first_of = np.searchsorted(c.doc, np.arange(len(c.ids)))
            value = np.full(len(c.h), MAX)
            for k, (places,) in enumerate(more):
                at = np.frombuffer(places, np.uint32).astype(np.int64) + first_of[k]
                value[at] = c.gram[at]
            may = np.flatnonzero(c.start & (least(value, window - GRAM + 1) == c.low) & (c.low != MAX))
            f1 = c.hash[window][may]
            f2 = sequence_hashes(mixed(c.h, 1, 900), window, 1000)[window][may]
            place = (c.rank()[c.doc[may]] << 32) + c.pos[may]
            order = np.lexsort((place, f2, f1))
            same = (np.diff(f1[order]) == 0) & (np.diff(f2[order]) == 0) if len(order) else np.zeros(0, bool)
            head = np.r_[True, ~same] if len(order) else np.zeros(0, bool)
            group = np.cumsum(head) - 1
            later = place[order] > place[order][head][group] if len(order) else head
            rows = []
            gone = may[order[later]]
            rows += known_places(c, gone, n_buckets)
            stay = order[head | ~later]
            w = may[stay]
            prefix = c.hash[window][w].copy()
            open_ = np.ones(len(w), bool)
            for k, n in enumerate(levels[:-1]):
                h = c.hash[n][w]
                light = open_ & ~heavy[k][(h >> U64(44)).astype(np.int64) % bins]
                prefix[light] = mixed(h[light], n, 77)
                open_ &= ~light
            for b, part in by_bucket((prefix % U64(n_buckets)).astype(np.int64)):
                sel = stay[part]
                rows.append((b, 0, None, None, pack([f1[sel], f2[sel], c.pos[may[sel]].astype(np.uint32)], c, c.doc[may[sel]]), None))
            yield batch(rows)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outgoing(n_buckets)
        for other, blobs in groups(batches, 0):
            if other is not None:
                yield other
                continue
            ids, none, xs, f1, f2, pos = unpack(blobs, [U64, U64, np.uint32])
            order = np.lexsort((pos, xs, ids, none, f2, f1))
            f1, f2, ids, none, xs, pos = (a[order] for a in (f1, f2, ids, none, xs, pos))
            node = np.r_[True, (np.diff(f1) != 0) | (np.diff(f2) != 0)]
            lead = np.flatnonzero(node)[np.cumsum(node) - 1]
            later = (ids != ids[lead]) | (none != none[lead]) | (xs != xs[lead]) | (pos != pos[lead])
            yield from out.add(ids[later], none[later], xs[later], pos[later])
        yield from out.rest()

    later = dealt(found.mapInArrow(suffixes, SCHEMA), n_parts).mapInArrow(trees, SCHEMA)
    return gathered(later, n_parts).select("doc_id", "x", F.col("data").alias("starts"))


def dedupe(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` for every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller doc_id (null last; equal
    ids by a hash of the text) or earlier in the same document. Rows of equal doc_id and text are one document and
    share their result. ``removed`` has the maximal repeats as ``[from, to)`` word positions. Null texts have no words; an
    empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
    r = repeats(d, window).select(F.col("doc_id").alias("__d"), F.col("x").alias("__x"), "starts")
    both = d.join(r, d.doc_id.eqNullSafe(F.col("__d")) & (d.x == F.col("__x")), "left").select("doc_id", "x", "text", "starts")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, out, spans = [], [], [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist()):
                words = text.encode().split() if text else []
                n.append(len(words))
                found = []
                if starts:
                    at = np.unique(np.frombuffer(starts, np.uint32)).astype(np.int64)
                    new = np.r_[True, np.diff(at) > window]
                    ends = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]] + window
                    found = list(zip(at[new].tolist(), ends.tolist()))
                    for a, z in reversed(found):
                        del words[a:z]
                gone.append(sum(z - a for a, z in found))
                out.append(b" ".join(words))
                spans.append([{"from": a, "to": z} for a, z in found])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return both.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<from: long, to: long>>")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM d, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n
  FROM w ANTI JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
