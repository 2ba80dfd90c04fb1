"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, other white space."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def texts(seed=1):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "délta", "the", "of", "and", "naïve", "x", "42", "it's", "東京", "end.", "🙂", "A b", "they'll"]

    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))

    base = prose(60)
    out = [None, "", " ", "\n\n", "one", "a  b\t\tc \n d", prose(30), base, base, base + " tail", "head " + base, prose(9), "<|endoftext|>mid<|endoftext|> end", "x" * 3000, " " * 700 + "y", "!!??" * 500, prose(2500), "ab" * 2000 + " " + prose(300) + "\n" * 600 + "z", "one\x85two three four", "line one here.\nline one here.\nmenu\nhome | about | contact | more\n" + prose(20) + "."]
    out += [prose(r.randrange(5, 80)) + "." for _ in range(30)]
    return out


def rows(seed=1):
    out = [(k, t, "en", [None, "s1", "s2", "s2", "s2"][k % 5], None if t is None else len(t)) for k, t in enumerate(texts(seed))]
    return [*out, out[7], out[7], (None, "no id here at all", None, None, 5), (None, None, None, None, None), (7, "another text of an old id", "en", "s1", 3)]


def docs(spark, seed=1, extra=False):
    df = spark.createDataFrame(rows(seed), SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "range", "size", "h", "ids", "w", "u", "v", "a", "b", "n", "bin", "taken", "shard"):
            df = df.withColumn(name, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
