"""Periodic run detection (operator 12): a suffix automaton whose last occurrences are recoloured by link-cut access.

Words are appended one by one. The suffixes that end at the new word are the way from its state to the root of the suffix links; each
state there has a colour, the place where it ended last. An access recolours that way: it meets one segment for each earlier
place, whose deepest state is the longest common suffix of both places. Where that is at least twice as long as the places are apart,
the distance is a period of the words up to here; such a stretch is extended to the right until the period breaks.

A word far from any repetition can't be in a run: runs lie in stretches of word grams that recur near by, which sorted gram
hashes show; only these stretches get an automaton. Memory is linear in the longest of them, some 700 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.manifest import CRC32

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Occurrences:
    """The suffix automaton of a growing word sequence, its link tree held as splayed paths of equal last occurrence.

    State 0 is the root. ``lo`` and ``hi`` are the shallower and deeper children within a path's splay tree, ``up`` its parent there or,
    at the splay root, the state to which the path's top links; ``colour`` holds for splay roots.
    """

    def __init__(self) -> None:
        self.length, self.link, self.to = [0], [-1], [{}]
        self.up, self.lo, self.hi, self.colour = [-1], [-1], [-1], [-1]
        self.last = 0

    def state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.to.append(to)
        for column in (self.up, self.lo, self.hi, self.colour):
            column.append(-1)
        return len(self.length) - 1

    def splay(self, x: int) -> None:
        """Make x the root of its path's splay tree."""
        up, lo, hi, colour = self.up, self.lo, self.hi, self.colour
        while (p := up[x]) >= 0 and (lo[p] == x or hi[p] == x):
            g = up[p]
            inner = g >= 0 and (lo[g] == p or hi[g] == p)
            for y in ((p, x) if (lo[g] == p) == (lo[p] == x) else (x, x)) if inner else (x,):
                z = up[y]
                above = up[z]
                if above >= 0 and lo[above] == z:
                    lo[above] = y
                elif above >= 0 and hi[above] == z:
                    hi[above] = y
                else:
                    colour[y] = colour[z]
                if lo[z] == y:
                    lo[z] = child = hi[y]
                    hi[y] = z
                else:
                    hi[z] = child = lo[y]
                    lo[y] = z
                if child >= 0:
                    up[child] = z
                up[z], up[y] = y, above

    def append(self, word: int, place: int) -> list[tuple[int, int]]:
        """Add the word at ``place``; for each segment recoloured, its last occurrence and the length of its deepest state."""
        length, link, to, up, lo, hi, colour = self.length, self.link, self.to, self.up, self.lo, self.hi, self.colour
        new, p = self.state(place + 1, 0, {}), self.last
        while p >= 0 and word not in to[p]:
            to[p][word] = new
            p = link[p]
        x = 0
        if p >= 0:
            x = q = to[p][word]
            if length[p] + 1 != length[q]:
                x = self.state(length[p] + 1, link[q], to[q].copy())
                while p >= 0 and to[p].get(word) == q:
                    to[p][word] = x
                    p = link[p]
                link[q] = x
                self.splay(q)  # the copy stands above q on q's own path
                lo[x] = lo[q]
                if lo[x] >= 0:
                    up[lo[x]] = x
                lo[q], up[x] = x, q
        link[new] = up[new] = x
        self.last, below, met = new, new, []
        while x > 0:
            self.splay(x)
            met.append((colour[x], length[x]))
            if hi[x] >= 0:
                colour[hi[x]] = colour[x]
            hi[x] = below
            below, x = x, up[x]
        colour[below] = place
        return met


def runs_within(words: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of at least ``times`` periods and ``least`` words; ``times`` is 3 or more."""
    seen, until, found, n = Occurrences(), {}, [], len(words)
    for place, word in enumerate(words):
        for last, common in seen.append(word, place):
            period = place - last
            if common >= (times - 1) * period and until.get(period, -1) < place:
                end = place + 1
                while end < n and words[end] == words[end - period]:
                    end += 1
                until[period] = end - 1
                start = place - common - period + 1
                if end - start >= least:
                    found.append((start, end - start, period))
    return found


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of words that hold all runs: their grams of least / 3 words recur within a third of the stretch."""
    gram = least // 3
    n = len(ids) - gram + 1
    if len(ids) < least:
        return []
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    grams, factor = np.zeros(n, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(gram):
            grams += h[k : k + n] * factor
            factor *= np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    far = len(ids)
    gap = np.where(same, np.diff(order), far)
    near = np.full(n, far)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    marked = near < far
    for _ in range(4):
        edge = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        fits = end - begin >= least - gram + 1
        begin, end = begin[fits], end[fits]
        if not len(begin):
            return []
        most = np.zeros(n, np.int64)
        for a, b in zip(begin.tolist(), end.tolist()):
            most[a:b] = (b - a + gram - 1) // times
        kept = marked & (near <= most)
        if (kept == marked).all():
            break
        marked = kept
    return [(a, b + gram - 1) for a, b in zip(begin.tolist(), end.tolist())]


def runs_of(words: list[bytes], least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if 2 * len(number) > 2 * len(words) - least:  # too few words come again
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = [(a + s, n, p) for a, b in stretches(ids, least, times) for s, n, p in runs_within(ids[a:b].tolist(), least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([w for w, k in zip(words, np.cumsum(change).tolist()) if not k])


def find(docs: DataFrame, least: int = 24, times: int = 3, text: str = "text") -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, runs, collapsed``.

    A run is a stretch of at least ``least`` words and ``times`` (3 or more) of its smallest period that neither neighbour extends. ``runs``
    holds its start (word number), length and period, by start, then period; ``collapsed`` the text without each run's
    repetitions, words joined by one space. Null and empty texts have no words and no runs; repeated rows stay repeated; an empty
    table gives an empty result; ``docs`` may have further columns of any name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, rest = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().split()
                n.append(len(words))
                found.append(runs_of(words, least, times))
                rest.append(collapsed(words, found[-1]).decode())
            columns = [pa.array([r[k] for rs in found for r in rs], pa.int64()) for k in range(3)]
            offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), runs, pa.array(rest, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def steepest(runs: Column) -> Column:
    """The run of the greatest length in periods, the first of equal ones; null if there is none."""
    more = lambda best, x: F.when(x.length * best.period > best.length * x.period, x).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.lit(0)), more)


def replanted(doc_id: Column, words: str) -> Column:
    """The words of a column, which in one of ten documents repeat from some word on, as the crc32 of its number says; else null."""
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.concat(F.slice(words, F.lit(1), a), F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p)))
    return F.when((h % 10 == 0) & (F.size(words) > 0), again)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    {CRC32.format("doc_id")}::BIGINT AS h FROM documents),
e AS (SELECT rid, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (
  SELECT rid, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x, n
  FROM f, unnest(range(0, n)) AS u(i)),
m AS (SELECT y.rid, y.i - x.i AS q, y.i FROM t x JOIN t y ON x.rid = y.rid AND x.x = y.x AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS z FROM m),
s AS (SELECT rid, q, min(i) - q AS start, count(*) + q AS length FROM k GROUP BY rid, q, z HAVING count(*) >= 2 * q AND count(*) + q >= 24),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
gone AS (SELECT DISTINCT rid, j AS i FROM r, unnest(range(start + period, start + length)) AS u(j)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS txt FROM t ANTI JOIN gone USING (rid, i) GROUP BY rid),
o AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM r GROUP BY rid),
best AS (
  SELECT rid, start, length, period FROM r
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(o.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN best USING (rid)
"""
