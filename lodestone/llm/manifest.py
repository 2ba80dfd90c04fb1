"""Merkle dataset manifest (operator 13): bitmap ranks give leaves their places, slot arrays reduce the levels.

A group's doc_ids are kept as a bitmap in 64-bit words, of which only those with a bit exist; tasks build theirs and Spark merges
them with OR. Directories of counts stand above the words, for 2^10 words, then twice for 2^16 of the level below, so that no window
holds more than 2^16 rows. A document's place is the sum of four directory entries and of the bits below its own: the documents
themselves are never sorted. Every ``FANOUT ** DEPTH`` leaves with consecutive places then meet in a slot array, which gives ``DEPTH``
levels at once; the arrays' roots are the leaves of the next round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

FANOUT, DEPTH = 3, 5
SPAN = FANOUT**DEPTH
#: Bits of the word number that each directory resolves, from below.
DIRECTORIES = (10, 16, 16)
#: Hex digits of a leaf by which leaves of equal doc_id are dealt out.
DIGITS = 4

STEP = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x.left, h, x.right).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """The path's hashes, level by level, left to right, in one string."""
    return F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right)), "")


def places(rows: DataFrame) -> DataFrame:
    """``rows(g, known, id, leaf, m, ...)``, distinct, with ``pos``, the place of the first of its m copies in its group, and the group's size ``n``.

    Places ascend by id, unknown ids first, then by leaf.
    """
    head = F.substring("leaf", 1, DIGITS)
    before = lambda keys, order, of: F.coalesce(F.sum(of).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # equal ids: counts by the leaf's first digits, then within these
    digits = rows.groupBy("g", "known", "id", head.alias("d")).agg(F.sum("m").alias("m"))
    digits = digits.withColumn("ahead", before(["g", "known", "id"], ["d"], "m"))
    rows = rows.withColumn("d", head).withColumn("within", before(["g", "known", "id", "d"], ["leaf"], "m"))
    rows = rows.join(digits.where("ahead > 0").drop("m"), ["g", "known", "id", "d"], "left")
    word, bit = F.shiftright("id", 6), F.col("id").bitwiseAND(F.lit(63)).cast("int")
    ids = digits.groupBy("g", "known", "id").agg(F.sum("m").alias("n"))
    more = F.collect_list(F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("more"))))
    words = ids.groupBy("g", "known", word.alias("at0")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 AS int))")).alias("bits"), F.sum("n").alias("n"), more.alias("more"))
    directory, level = words, words.select("g", "known", "at0", "n")
    for k, width in enumerate(DIRECTORIES):
        up = F.shiftright(f"at{k}", width)
        above = level.groupBy("g", "known", up.alias(f"at{k + 1}")).agg(F.sum("n").alias("n"))
        level = level.withColumn(f"before{k}", before(["g", "known", up], [f"at{k}"], "n")).drop("n")
        directory, level = directory.join(level, ["g", "known", f"at{k}"]).withColumn(f"at{k + 1}", up), above
    k = len(DIRECTORIES)
    level = level.withColumn(f"before{k}", before(["g"], ["known", f"at{k}"], "n")).withColumn("all", F.sum("n").over(Window.partitionBy("g"))).drop("n")
    directory = directory.join(level, ["g", "known", f"at{k}"])
    base = reduce(lambda a, b: a + b, [F.col(f"before{k}") for k in range(len(DIRECTORIES) + 1)])
    directory = directory.select("g", "known", "at0", "bits", "more", base.alias("base"), "all")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, cast(id & 63 AS int))"))))
    extra = F.when(F.size("more") > 0, F.aggregate(F.filter("more", lambda x: x.bit < bit), F.lit(0).cast("long"), lambda a, x: a + x.more)).otherwise(0)
    found = rows.withColumn("at0", word).join(directory, ["g", "known", "at0"])
    found = found.withColumn("pos", F.col("base") + below + extra + F.coalesce("ahead", F.lit(0)) + F.col("within"))
    return found.withColumnRenamed("all", "n").drop("at0", "bits", "more", "base", "d", "within", "ahead")


def parents(level: str) -> Column:
    """The next level above an array of hashes: the hash of every ``FANOUT`` joined ones."""
    joined = lambda i: F.array_join(F.slice(F.col(level), i * FANOUT + 1, FANOUT), "")
    return F.transform(F.expr(f"sequence(0, cast((size({level}) - 1) div {FANOUT} AS int))"), lambda i: F.sha2(joined(i).cast("binary"), 256))


def tree(nodes: DataFrame) -> DataFrame:
    """``nodes(g, pos, n, h, row)``, the n nodes of each group by place, to ``(g, h, row, path, top)``: the way to the group's root ``top``."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    slots = nodes.groupBy("g", "n", F.expr(f"pos div {SPAN}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "h", "row"))).alias("slots"))
    depth = reduce(lambda c, k: c.when(F.col("n") <= FANOUT**k, k), range(1, DEPTH), F.when(F.col("n") <= 1, 0)).otherwise(DEPTH)
    slots = slots.withColumn("depth", depth).withColumn("l0", F.transform("slots", lambda x: x.h))
    for k in range(DEPTH):
        slots = slots.withColumn(f"l{k + 1}", F.when(F.col("depth") > k, parents(f"l{k}")).otherwise(F.col(f"l{k}")))
    levels = [f"l{k}" for k in range(DEPTH)]
    blocks = written(slots.select("g", "n", "block", "slots", "depth", *levels[1:], F.get(f"l{DEPTH}", F.lit(0)).alias("top")))
    if most > SPAN:
        above = tree(blocks.select("g", F.col("block").alias("pos"), F.expr(f"(n - 1) div {SPAN} + 1").alias("n"), F.col("top").alias("h"), F.struct("block").alias("row")))
        above = above.select("g", "row.block", F.col("path").alias("rest"), F.col("top").alias("root"))
        blocks = blocks.drop("top").join(above, ["g", "block"])
    else:
        blocks = blocks.withColumn("rest", F.array().cast(STEP)).withColumnRenamed("top", "root")
    blocks = blocks.withColumn("l0", F.transform("slots", lambda x: x.h))
    each = blocks.select("g", "depth", "rest", "root", *levels, F.posexplode("slots").alias("slot", "x"))

    def step(k: int) -> Column:
        j = F.expr(f"slot div {FANOUT**k}")
        at = j % FANOUT
        left = F.slice(F.col(f"l{k}"), j - at + 1, at)
        right = F.slice(F.col(f"l{k}"), j + 2, FANOUT - 1 - at)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    path = F.concat(F.slice(F.array(*[step(k) for k in range(DEPTH)]), F.lit(1), F.col("depth")), F.col("rest"))
    return each.select("g", "x.h", "x.row", path.alias("path"), F.col("root").alias("top"))


def manifest(leaves: DataFrame, group: str = "source", key: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """``leaves`` with ``pos`` (place within the group), ``subroot``, ``root`` and ``path`` (the siblings to the left and right, level by level).

    A group's leaves ascend by ``key`` (a long; null first), then by leaf; equal rows take places side by side. While nodes remain,
    each ``FANOUT`` consecutive ones become the SHA-256 of their joined hashes. Groups, null first and then bytewise, give the root
    in the same way. Null is a group of its own; an empty table gives an empty result; all columns of ``leaves`` must
    be comparable and pass through. The list of groups is ordered in one task: it is meant for up to some millions of them.
    """
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    own = F.struct(*leaves.columns)
    rows = leaves.select(g.alias("g"), F.col(key).isNotNull().alias("known"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(leaf).alias("leaf"), own.alias("row"))
    rows = written(rows.groupBy("g", "known", "id", "leaf", "row").agg(F.count("*").alias("m")))
    copies = places(rows).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    placed = copies.select("g", (F.col("pos") + F.col("copy")).alias("pos"), "n", F.col("leaf").alias("h"), F.struct((F.col("pos") + F.col("copy")).alias("pos"), "row").alias("row"))
    found = tree(placed)
    tops = written(found.groupBy("g").agg(F.first("top").alias("top")))
    order = Window.orderBy("g")
    roots = tops.select(F.lit("").alias("g"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.count("*").over(Window.partitionBy()).alias("n"), F.col("top").alias("h"), F.struct("g").alias("row"))
    roots = written(tree(roots).select(F.col("row.g").alias("g"), F.col("path").alias("higher"), F.col("top").alias("root")))
    out = found.join(roots, "g")
    return out.select("row.row.*", "row.pos", F.col("top").alias("subroot"), "root", F.concat("path", "higher").alias("path"))


#: DuckDB's form of crc32 over the decimal digits of a number.
CRC32 = """xor(list_reduce(list_transform(range(length({0}::VARCHAR)), lambda i: ascii(({0}::VARCHAR)[i + 1])::BIGINT),
  lambda c, b: list_reduce(list_transform(range(8), lambda i: 0::BIGINT), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"""


def _leaf(text: str) -> str:
    fields = (f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


def _tree(name: str, first: str) -> str:
    """CTEs over ``first(g, pos, h, n)``: the nodes of every level, and the siblings of each node on its way up."""
    return f"""
{name}(k, g, pos, h, n) AS (
  SELECT 0, g, pos, h, n FROM {first}
  UNION ALL SELECT k + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY k, g, pos // 3, n),
{name}_way AS (
  SELECT a.k, a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.k = b.k AND a.g = b.g AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.k, a.g, a.pos),
{name}_path AS (
  SELECT f.g, f.pos, coalesce(list({{'l': w.l, 'r': w.r}} ORDER BY w.k) FILTER (WHERE w.k IS NOT NULL), []) AS path
  FROM {first} f LEFT JOIN {name}_way w ON w.g = f.g AND w.pos = f.pos // (3 ** w.k)::BIGINT GROUP BY f.g, f.pos)"""


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf("text")} AS leaf,
    CASE WHEN {CRC32.format("doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("up", "leaves")},
subroots AS (SELECT g AS sub, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_tree("top", "subroots")},
f AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, u.path || t.path AS path, other
  FROM leaves JOIN up_path u USING (g, pos) JOIN subroots s ON s.sub = leaves.g JOIN top_path t ON t.pos = s.pos),
r AS (
  SELECT *, list_reduce(list_prepend({{'l': other, 'r': ''}}, path), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM r
"""
