"""Byte-level BPE encoding and decoding of whole texts (operator 6), by tree concatenation.

Every text is cut into halves again and again until the pieces have at most ``leaf`` characters; the pieces are encoded, and
neighbours are joined pairwise up the tree. The pieces of a text over ``spread`` characters are rows of their own, so that
tasks encode them in parallel; those of a shorter text are encoded where it is. A join keeps the exact standalone encoding
of its text:

* Pre-tokens. Matching goes from left to right and looks at most two pre-tokens past what it has, so all but the last
  three pre-tokens of the left side stay. From there a window into the right side is cut anew and grows until one of
  its boundaries meets a boundary of the right side, well before the window's end; from that place on the right
  side's pre-tokens hold.
* A long pre-token across the join. BPE of a concatenation equals the two sides' tokens but for some around the join.
  A window of tokens around it is encoded anew and grows until its first and last token agree with the left and the
  right side's; then every neighbouring pair of tokens occurs in a valid encoding, which makes the whole valid and
  hence the one encoding of the text.

Special tokens in a text are taken as the tokenizer takes them; a text is first divided at them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_files import Words, byte_characters, load

LEAF = 2_048
#: Characters of a text from which its pieces are dealt to tasks.
SPREAD = 32_768
#: Pre-tokens of more characters than this are joined token by token.
LONG = 512
CUT = re.compile(r" (?=\S)")
#: Texts without a match have single spaces and line ends only, each between other characters.
ODD = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")
#: Characters at either end of a leaf that are held as single pre-tokens.
EDGE = 48


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to a few rows, which bounds what Python holds at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Codec:
    """One tokenizer file: pieces to ids and ids to bytes. Words met before are looked up in tables of ``limit`` entries."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.run = load(path), load(path)
        self.run.encode_special_tokens = True  # one pre-token at a time
        self.run.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        kind = np.dtype("<u4")
        self.first, self.later = Words(self.tok, kind, "", False, limit // 4), Words(self.tok, kind, " ", False, limit)
        self.newline = self.first["\n"]
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {c: b for b, c in byte_characters().items()}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = t.encode() if i in self.special.values() else bytes(byte[c] for c in t)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The parts between special tokens, and these with their ids."""
        if not self.by_special or not any(s in text for s in self.special):
            return [(text, None)]
        return [(x, self.special.get(x) if k % 2 else None) for k, x in enumerate(self.by_special.split(text)) if x]

    def text(self, text: str | None) -> bytes:
        """Ids as bytes. A pre-token always begins at a space before something else, so texts fall apart there.

        A line end between two other characters is a pre-token by itself.
        """
        if not text:
            return b""
        first, later = self.first.__getitem__, self.later.__getitem__
        if ODD.search(text):
            a, *rest = CUT.split(text)
            return b"".join([first(a), *map(later, rest)])
        out = []
        for line in text.split("\n"):
            a, *rest = line.split(" ")
            out.append(b"".join([first(a), *map(later, rest)]))
        return self.newline.join(out)

    def ids(self, pre_token: str) -> list[int]:
        return self.run.encode(pre_token, add_special_tokens=False).ids

    def pre_tokens(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def node(self, text: str) -> Node:
        """A leaf: pre-tokens near its ends, and what lies between two safe boundaries as one piece."""
        a, b = CUT.search(text, EDGE), None
        if a:
            for b in CUT.finditer(text, max(a.start() + 1, len(text) - 2 * EDGE)):
                break
        if not b:
            pre = self.pre_tokens(text)
            return Node(pre, [self.ids(p) for p in pre])
        a, b = a.start(), b.start()
        left, right = self.pre_tokens(text[:a]), self.pre_tokens(text[b:])
        middle = np.frombuffer(self.text(text[a:b]), "<u4").tolist()
        return Node([*left, text[a:b], *right], [*map(self.ids, left), middle, *map(self.ids, right)])

    def grown(self, text: str, leaf: int) -> Node:
        """A text without special tokens through the tree: leaves, joined level by level."""
        return tree(self, [self.node(x) for x in halves(text, leaf)])

    def whole(self, text: str | None, leaf: int) -> bytes:
        """Ids of a whole text as bytes, through the tree; a tree of one leaf is that leaf."""
        if not text or len(text) <= leaf:
            return self.text(text)
        out = []
        for part, special in self.segments(text):
            if special is not None:
                out.append(special)
            else:
                out += [i for x in self.grown(part, leaf).ids for i in x]
        return np.array(out, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Node:
    """The exact encoding of a piece of text: its pre-tokens and the ids of each."""

    __slots__ = ("ids", "pre")

    def __init__(self, pre: list[str], ids: list[list[int]]):
        self.pre, self.ids = pre, ids


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def join_run(c: Codec, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """Ids of one pre-token ``left + right`` from the ids of its two parts."""
    k = 4
    while k < max(len(left_ids), len(right_ids)):
        a, b = left_ids[-k:], right_ids[:k]
        try:
            text = b"".join(c.bytes[i] for i in a + b).decode()
        except UnicodeDecodeError:  # a window's edge is inside a character
            k += 1
            continue
        got = c.ids(text)
        first = k < len(left_ids)
        last = k < len(right_ids)
        if (not first or got[0] == a[0]) and (not last or got[-1] == b[-1]):
            return left_ids[:-k] * first + got + right_ids[k:]
        k *= 2
    return c.ids(left + right)


def join(c: Codec, a: Node, b: Node) -> Node:
    """The exact node of the concatenated texts."""
    keep = max(0, len(a.pre) - 3)
    tail = a.pre[keep:]
    ends = np.cumsum([0] + [len(p) for p in b.pre])
    take = 4
    while True:
        whole = take >= len(b.pre)
        window = c.pre_tokens("".join(tail) + "".join(b.pre[:take]))
        at, met = -sum(map(len, tail)), None
        marks = set(ends[: take + 1].tolist())
        sure = len(window) if whole else len(window) - 3
        for k, p in enumerate(window[: max(sure, 0)]):
            at += len(p)
            if at > 0 and at in marks:
                met = (k + 1, int(np.searchsorted(ends, at)))
                break
        if met or whole:
            break
        take *= 2
    n_new, n_old = met or (len(window), len(b.pre))
    new = window[:n_new]
    known = dict(zip(tail, a.ids[keep:])) | dict(zip(b.pre[:n_old], b.ids[:n_old]))
    made = []
    for p in new:
        if p in known:
            made.append(known[p])
        elif tail and b.pre and len(p) > LONG and p == tail[-1] + b.pre[0]:
            made.append(join_run(c, tail[-1], a.ids[-1], b.pre[0], b.ids[0]))
        else:
            made.append(c.ids(p))
    return Node(a.pre[:keep] + new + b.pre[n_old:], a.ids[:keep] + made + b.ids[n_old:])


def halves(text: str, leaf: int) -> list[str]:
    """The text as leaves of the tree of halves, from left to right: 2^depth pieces."""
    depth = 0
    while (len(text) >> depth) > leaf:
        depth += 1
    cuts = [len(text) * k >> depth for k in range((1 << depth) + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def tree(c: Codec, nodes: list[Node]) -> Node:
    """Join neighbours level by level."""
    while len(nodes) > 1:
        nodes = [join(c, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0]


def encode(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, text: str = "text", keep_text: bool = True, spread: int = SPREAD) -> DataFrame:
    """``docs`` with a column ``ids``, the token ids as little-endian unsigned 32-bit integers; other columns stay (the text if ``keep_text``).

    Null and empty texts have no ids. Every text is encoded whole, through its tree. Texts over ``spread`` characters are
    dealt to tasks in pieces, each distinct text once, by a 128-bit key of the text and the piece's number; the pieces' nodes
    come together by that key, and rows, repeated ones too, take the ids of their text. One task holds the tokens of one
    text, some 40 bytes each.
    """
    names = [c for c in docs.columns if keep_text or c != text]
    held = docs.withColumn("__n", F.length(F.coalesce(F.col(text), F.lit(""))))
    short, long = held.where(F.col("__n") <= spread).drop("__n"), held.where(F.col("__n") > spread).drop("__n")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in pieces_of(batches):
            got = [c.whole(t, leaf) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            keep = [k for k in range(batch.num_columns) if batch.schema.names[k] in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(got, pa.binary())], [*(batch.schema.names[k] for k in keep), "ids"])

    from pyspark.sql import types as T

    out = T.StructType([*(f for f in docs.schema.fields if f.name in names), T.StructField("ids", T.BinaryType())])
    return short.mapInArrow(plain, out).unionAll(encode_long(long, tokenizer_path, leaf, spread, text, names))


def encode_long(long: DataFrame, tokenizer_path: str, leaf: int, spread: int, text: str, names: list[str]) -> DataFrame:
    """The tree over the texts of ``long``: its columns ``names`` and ``ids``."""
    # every long text once, under its 128-bit key; rows take the ids of their text by that key
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.reverse(F.col(text))).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            for a, b, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n = 0
                rows = []
                for s, (part, special) in enumerate(c.segments(t)):
                    leaves = [part] if special is not None else halves(part, spread)
                    rows += [(a, b, s, n + k, special, x) for k, x in enumerate(leaves)]
                    n += len(leaves)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["a", "b", "segment", "leaf", "special", "part"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            pre, n, ids = [], [], []
            for special, part in zip(batch.column("special").to_pylist(), batch.column("part").to_pylist()):
                node = Node([part], [[special]]) if special is not None else c.grown(part, leaf)
                pre.append([len(p) for p in node.pre])
                n.append([len(x) for x in node.ids])
                ids.append(np.array([i for x in node.ids for i in x], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pre, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), pa.array(ids, pa.binary())], [*batch.schema.names, "pre", "n", "leaf_ids"])

    def joined(table: pa.Table) -> pa.Table:
        c = codec(tokenizer_path)
        rows = sorted(table.to_pylist(), key=lambda r: r["leaf"])
        parts: dict[int, list] = {}
        for r in rows:
            flat, at, i, pre, ids = np.frombuffer(r["leaf_ids"], "<u4").tolist(), 0, 0, [], []
            for size, n in zip(r["pre"], r["n"]):
                pre.append(r["part"][at : at + size])
                ids.append(flat[i : i + n])
                at, i = at + size, i + n
            parts.setdefault(r["segment"], []).append(Node(pre, ids))
        whole = [tree(c, nodes) for _, nodes in sorted(parts.items())]
        flat = [i for node in whole for x in node.ids for i in x]
        return pa.table({"a": pa.array([rows[0]["a"]], pa.int64()), "b": pa.array([rows[0]["b"]], pa.int64()), "ids": pa.array([np.array(flat, "<u4").tobytes()], pa.binary())})

    texts = long.select(key.alias("k"), F.col(text).alias("t")).dropDuplicates(["k"]).select("k.a", "k.b", "t")
    schema = "a long, b long, segment int, leaf int, special int, part string"
    pieces = texts.mapInArrow(cut, schema).repartition("a", "b", "leaf").mapInArrow(leaves, schema + ", pre array<int>, n array<int>, leaf_ids binary")
    ids = pieces.groupBy("a", "b").applyInArrow(joined, "a long, b long, ids binary")
    rows = long.withColumn("__k", key)
    return rows.join(ids, (F.col("__k.a") == ids.a) & (F.col("__k.b") == ids.b)).select(*[rows[c] for c in names], ids.ids)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(c: Codec, doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def digests(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Decode ``encoded(doc_id, ids)``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in pieces_of(batches):
            yield digested(c, batch.column("doc_id"), batch.column("ids").to_pylist())

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, DIGESTS)


def encode_and_decode(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``digests`` of ``encode`` for ``docs(doc_id, text)``, with both in one pass over the shorter texts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.length(F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in pieces_of(batches):
            yield digested(c, batch.column("doc_id"), [c.whole(t, leaf) for t in batch.column("text").to_pylist()])

    long = encode_long(d.where(n > spread), tokenizer_path, leaf, spread, "text", ["doc_id"])
    return d.where(n <= spread).mapInArrow(run, DIGESTS).unionAll(digests(long, tokenizer_path))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text of its ids."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            got = [None if x is None else c.decode(x) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
