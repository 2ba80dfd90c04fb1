import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, token_files
from lodestone.llm.queries import tokenizer

from . import data

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def test_perfect_hash_is_minimal_and_refuses():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    starts = np.arange(len(keys) + 1)
    index = token_files.ShardIndex(token_files.index_bytes(keys, 0, starts, 2))
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (token_files.ShardIndex(token_files.index_bytes(np.zeros(0, np.int64), 2, np.arange(3), 2)).find(keys[:3]) == -1).all()


@pytest.mark.parametrize("vocab", [49_408, 70_000])
def test_token_files_round_trip(spark, vocab):
    path = tokenizer("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    manifest = token_files.write_token_files(data.docs(spark, extra=True), path, 1, vocab)
    got = [tuple(r) for r in token_files.read_token_files(manifest).collect()]
    start, want = 0, []
    for i, x in sorted(((r[0], r[1]) for r in data.rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    keys = spark.createDataFrame([(3,), (7,), (10**9,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_files.lookup(manifest, keys).collect()}
    assert set(found) == {3, 7} and found[3] == [1]
    lasts = [r.last_key for r in manifest.sort("shard").collect()]
    assert lasts == sorted(lasts) and len(lasts) > 1
    # other shards than the key's aren't opened: theirs may be missing
    far = manifest.withColumn("path", F.when(F.col("shard") == min(s for s, k in enumerate(lasts) if k >= 3), F.col("path")).otherwise("file:///nowhere"))
    assert [r.ids for r in token_files.lookup(far, spark.createDataFrame([(3,)], "doc_id long")).collect()] == [[1]]
    small = token_files.write_token_files(data.docs(spark), path, 1, vocab, shard_chars=2000)
    assert small.count() > len(lasts) and small.agg(F.sum("n_ids")).first()[0] == start
    none = token_files.write_token_files(data.empty(spark), path, 1, vocab)
    assert token_files.read_token_files(none).count() == 0 and token_files.lookup(none, keys).count() == 0


@pytest.mark.parametrize("leaf, spread", [(16_384, 32_768), (64, 4096), (32, 256)])
def test_bpe_equals_the_library(spark, leaf, spread):
    path = tokenizer("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    encoded = bpe.encode(data.docs(spark).select("doc_id", "text"), path, leaf, spread=spread)
    got = sorted((tuple(r) for r in bpe.digests(encoded, path).collect()), key=str)
    want = []
    for i, x, *_ in data.rows():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted((tuple(r) for r in bpe.encode_and_decode(data.docs(spark, extra=True), path, leaf, spread).collect()), key=str) == got
    more = bpe.encode(data.docs(spark, extra=False).selectExpr("*", "1 a", "2 b", "3 special"), path, leaf, spread=spread)
    assert more.count() == len(data.rows()) and bpe.decode(more, path).where("coalesce(text, '') != decoded").count() == 0
    assert bpe.encode(data.empty(spark), path, leaf).count() == 0


def test_tree_of_halves_is_exact_for_any_text():
    path = tokenizer("byte_bpe_50k.json")
    c, r = bpe.codec(path), random.Random(5)
    pieces = ["a", "ing", "tion", " ", "  ", "\n", "'", "'re", "'ll", "s", "é", "東", "🙂", "1", "23", "!", "...", " ", "　", "\x85", "the", " the", "X", "\t"]
    for n in range(400):
        text = "".join(r.choice(pieces[: r.randrange(1, len(pieces)) + 1]) for _ in range(r.randrange(1, 300)))
        if n % 4 == 0:
            text = "".join(r.choice("abcdeingth") for _ in range(2500)) + text
        node = bpe.tree(c, [c.node(x) for x in bpe.halves(text, r.choice([1, 3, 16, 100]))])
        assert [i for x in node.ids for i in x] == c.tok.encode(text, add_special_tokens=False).ids
        assert c.decode(c.text(text)) == text and c.text(text) == np.array(c.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_very_long_texts_take_the_tree_as_it_is(spark):
    path = tokenizer("byte_bpe_50k.json")
    t, r = tokenizers.Tokenizer.from_file(path), random.Random(3)
    vocab = ["alpha", "Beta,", "the", "of", "naïve", "東京", "they'll", "42", "x" * 40, "\n", "  ", "end."]
    texts = [" ".join(r.choice(vocab) for _ in range(250_000)), "ab" * 40_000, " ".join(r.choice(vocab) for _ in range(9_000)) + "<|endoftext|>" + "é" * 20_000]
    assert len(texts[0]) > 10**6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_tokens, x.ids_sha256) for x in bpe.encode_and_decode(df, path).collect()}
    ids = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4") for x in texts]
    assert got == {k: (len(x), hashlib.sha256(x.tobytes()).hexdigest()) for k, x in enumerate(ids)}
