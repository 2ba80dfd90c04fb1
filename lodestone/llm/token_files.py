"""Token-id files with a minimal perfect hash index (operator 2).

A shard file holds the raw ids of its documents one after another; its index file maps a document key in constant
time to the place of its ids. The index is a minimal perfect hash: keys are put into bit tables level by level
(a key settles where no other key of the level falls), and the rank of its bit is its slot. A slot stores a 64-bit
fingerprint of its key, one-to-one with it, so that foreign keys are refused without a look at the data, and the first row
of the key. A reader of single keys opens the one shard that may hold them, its index and the bytes of their ids only.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir

MAGIC = b"LSIDX001"
U64 = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function that is one-to-one for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys."""

    GAMMA = 1.5

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate(([0], np.cumsum(bits[:-1], dtype=np.int64))) if len(bits) else np.zeros(0, np.int64))
            total += int(bits.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(U64), []
        while len(left):
            size = max(8, int(len(left) * cls.GAMMA))
            at = (mix(left, len(levels)) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key of the set; any slot or -1 for other keys."""
        keys = keys.astype(np.int64).view(U64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = (mix(keys[left], k) % U64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """64 bits that are one-to-one with the key: equal ones prove it."""
    return mix(keys.astype(np.int64).view(U64), 977)


def index_bytes(keys: np.ndarray, n_null: int, starts: np.ndarray, id_bytes: int) -> bytes:
    """The index of one shard. ``keys``: of the rows after the ``n_null`` rows without a key, ascending; ``starts``: of all rows, and the end."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    unique = keys[first]
    mph = PerfectHash.build(unique)
    slots = mph.slots(unique)
    prints, rows = np.zeros(len(unique), U64), np.zeros(len(unique), np.int64)
    prints[slots], rows[slots] = fingerprint(unique), first + n_null
    sizes = np.array([len(b) for b in mph.levels], np.int64)
    head = np.array([id_bytes, n_null, len(keys), len(unique), len(sizes)], np.int64)
    bits = [np.packbits(b).tobytes() for b in mph.levels]
    return b"".join([MAGIC, head.tobytes(), sizes.tobytes(), *bits, prints.tobytes(), rows.tobytes(), starts.astype(np.int64).tobytes()])


class ShardIndex:
    """Reads an index file; ``find`` gives the row of a key, ``span`` the ids' place of a row."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        at = 8

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        self.id_bytes, self.n_null, n, n_unique, n_levels = map(int, take(np.int64, 5))
        levels = []
        for size in take(np.int64, n_levels).tolist():
            levels.append(np.unpackbits(take(np.uint8, (size + 7) // 8), count=size).astype(bool))
        self.mph = PerfectHash(levels)
        self.prints, self.rows = take(U64, n_unique), take(np.int64, n_unique)
        self.starts = take(np.int64, n + self.n_null + 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key; -1 where the shard lacks it."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slots = self.mph.slots(keys)
        ok = (slots >= 0) & (self.prints[slots] == fingerprint(keys))
        return np.where(ok, self.rows[slots], -1)

    def span(self, row: int) -> tuple[int, int]:
        return int(self.starts[row]), int(self.starts[row + 1])

    def ids(self, file: pa.NativeFile, a: int, b: int) -> np.ndarray:
        """The ids a to b of the shard's file, the only bytes that are read."""
        file.seek(a * self.id_bytes)
        return np.frombuffer(file.read((b - a) * self.id_bytes), "<u2" if self.id_bytes == 2 else "<u4")


#: Words of these letters alone are one pre-token, and no normaliser changes them but for their case.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words(dict):
    """Ids of words, as bytes of little-endian ids; a word that isn't there yet is encoded, and all go at ``limit`` entries.

    ``before`` stands before every word (a space, for vocabularies with spaces at the words' start). Plain words go to the
    tokenizer's model at once, other ones through all of the tokenizer.
    """

    def __init__(self, tok, kind: np.dtype, before: str, lower: bool, limit: int):
        super().__init__()
        self.tok, self.model, self.kind, self.before, self.lower, self.limit = tok, tok.model, kind, before, lower, limit
        self.shown = byte_characters()
        self.marks = {c: self.ids(tok.encode(c, add_special_tokens=False).ids) for c in ".,"}

    def ids(self, x: list[int]) -> bytes:
        return np.array(x, self.kind).tobytes()

    def plain(self, word: str) -> bytes:
        text = self.before + (word.lower() if self.lower else word)
        return self.ids([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.shown))])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if PLAIN.match(word):
            out = self.plain(word)
        elif word[-1:] in self.marks and PLAIN.match(word[:-1]):
            out = self[word[:-1]] + self.marks[word[-1]]
        else:
            out = self.ids(self.tok.encode(self.before + word, add_special_tokens=False).ids)
        self[word] = out
        return out


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space and lower-cases: each distinct word is encoded once."""

    def __init__(self, path: str, id_bytes: int, limit: int = 800_000):
        self.kind = np.dtype("<u2" if id_bytes == 2 else "<u4")
        self.words = Words(load(path), self.kind, "", True, limit)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


@lru_cache(maxsize=4)
def word_encoder(path: str, id_bytes: int) -> WordEncoder:
    """One for each worker process, which serves many tasks."""
    return WordEncoder(path, id_bytes)


def put(where: str, data) -> None:
    """Write one file at a URI of any store that pyarrow knows: first under a name of this attempt, then renamed."""
    store, path = pafs.FileSystem.from_uri(where)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        for x in data:
            f.write(x)
    store.move(part, path)


def opened(where: str) -> pa.NativeFile:
    """A file to read at any place."""
    store, path = pafs.FileSystem.from_uri(where)
    return store.open_input_file(path)


def get(where: str) -> bytes:
    with opened(where) as f:
        return f.read()


def qualified(spark, folder: str) -> str:
    """A folder with its file system's scheme, which is the session's default where it names none, as for Spark's own tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, vocab: int, folder: str | None = None, shard_chars: int = 2**28) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards in ascending order of doc_id.

    Returns the manifest ``(shard, path, n_rows, n_ids, last_key)``, one row per shard. A null text is empty; a null doc_id
    sorts first and has no index entry; equal doc_ids stand next to each other, by text, and the index leads to
    the first. Ids of a vocabulary of at most 65,536 take two bytes, others four. Shards are ranges of doc_id and the
    text's beginning, of about ``shard_chars`` characters at most, or as many as there are shuffle partitions; a doc_id of
    very many rows has several. A lost task writes the same bytes again under the same name. A shard has the ids of its
    documents (``.ids``), the index (``.idx``) and its doc_ids in order (``.keys``), which only whole readings need.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    folder = qualified(spark, folder)
    id_bytes = 2 if vocab <= 65_536 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = word_encoder(tokenizer_path, id_bytes)
        end = np.array([end_id], enc.kind).tobytes()
        keys, lens, n_null = [], [], 0

        def payload():
            nonlocal n_null
            for batch in batches:
                got = batch.column(0)
                n_null += got.null_count
                keys.append(got.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                for k in range(0, batch.num_rows, 256):  # few texts at a time
                    for x in map(enc.encode, batch.column(1).slice(k, 256).to_pylist()):
                        lens.append(len(x) // id_bytes + 1)
                        yield x + end

        path = f"{folder}/shard-{shard:06d}"
        rows = payload()
        if (one := next(rows, None)) is None:
            return
        put(f"{path}.ids", (x for part in ([one], rows) for x in part))
        starts = np.concatenate(([0], np.cumsum(np.array(lens, np.int64))))
        known = np.concatenate(keys)
        put(f"{path}.idx", [index_bytes(known, n_null, starts, id_bytes)])
        put(f"{path}.keys", [known.tobytes()])
        last = int(known[-1]) if len(known) else None
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_rows": pa.array([len(lens)], pa.int64()), "n_ids": pa.array([int(starts[-1])], pa.int64()), "last_key": pa.array([last], pa.int64())})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // shard_chars))
    ordered = d.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    kinds = "shard int, path string, n_rows long, n_ids long, last_key long"
    return spark.createDataFrame(sorted(ordered.mapInArrow(write, kinds).collect()), kinds)  # a row for each shard


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read every document back through the index: ``(doc_id, start, n_tokens, ids_crc32)``.

    ``start`` counts the ids of all documents before it, over all shards; the crc is over 32-bit ids.
    """
    spark = manifest.sparkSession
    base, shards = 0, []
    for r in sorted(manifest.collect()):
        shards.append((r.path, base))
        base += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index, known = ShardIndex(get(f"{path}.idx")), np.frombuffer(get(f"{path}.keys"), np.int64)
                first = index.find(known)
                assert (first >= 0).all(), f"{path}: the index lacks a key"
                # the hash leads to the first row of a key; rows of an equal key follow it
                run = np.flatnonzero(np.r_[True, known[1:] != known[:-1]]) if len(first) else np.zeros(0, np.int64)
                nth = np.arange(len(first)) - np.repeat(run, np.diff(np.r_[run, len(first)]))
                rows = np.concatenate([np.arange(index.n_null), first + nth]).astype(np.int64)
                keys = [None] * index.n_null + known.tolist()
                with opened(f"{path}.ids") as f:
                    for k in range(0, len(rows), 1024):
                        spans = [index.span(r) for r in rows[k : k + 1024].tolist()]
                        crc = [zlib.crc32(index.ids(f, a, b).astype("<u4").tobytes()) for a, b in spans]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[k : k + 1024], pa.int64()), "start": pa.array([base + a for a, _ in spans], pa.int64()), "n_tokens": pa.array([b - a for a, b in spans], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    table = spark.createDataFrame(shards, "path string, base long")
    if shards:
        table = table.repartition(min(len(shards), 100_000))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: the ids ``(doc_id, ids)`` of the documents named in ``keys(doc_id)``; absent keys give no row.

    Each key goes to the first shard whose last key isn't below it, the only one that is opened for it: there hash and
    fingerprint lead to its row, and its ids alone are read. Keys of one shard meet in one task.
    """
    shards = sorted(r for r in manifest.collect() if r.last_key is not None)
    paths, lasts = [r.path for r in shards], np.array([r.last_key for r in shards], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(lasts, wanted, "left")
            yield pa.RecordBatch.from_pydict({"shard": pa.array(at[at < len(lasts)], pa.int32()), "doc_id": pa.array(wanted[at < len(lasts)])})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = -1, None
        for b in batches:
            at, wanted = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(at).tolist():
                if k != now:  # batches come in order of the shard
                    now, index = k, ShardIndex(get(f"{paths[k]}.idx"))
                rows = index.find(wanted[at == k])
                with opened(f"{paths[k]}.ids") as f:
                    for key, r in zip(wanted[at == k][rows >= 0].tolist(), rows[rows >= 0].tolist()):
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key], pa.int64()), "ids": pa.array([index.ids(f, *index.span(r)).astype(np.int32)], pa.list_(pa.int32()))})

    routed = keys.select(F.col("doc_id").cast("long")).distinct().mapInArrow(route, "shard int, doc_id long")
    return routed.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(find, "doc_id long, ids array<int>")
