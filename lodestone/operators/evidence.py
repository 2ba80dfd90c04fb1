"""From documents to chunks, claims and evidence; duplicates in order of position."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scores
from lodestone.functions.text import canonicalize_url, clean_markdown, content_hash, extract_entities, jaccard, preview, strip_markdown, trim_all, unique, word_set


#: Chunk bounds that are gathered before they join the others, and characters of the blocks from which chunks are cut.
GATHERED, BLOCK = 256, 4096


def chunk_bounds(text: Column, size: int = 700, overlap: int = 200) -> Column:
    """``array<struct<s, e>>`` of the chunks of a cleaned text (the end is exclusive), found by one fold over its pieces between blank lines.

    A chunk ends at the last blank line before its limit if that lies past 55 % of its size; the next one starts ``overlap`` before that end. The
    fold knows the place in the text, the start of the chunk that is open and the last blank line at which it may end; a piece that
    leads beyond the limit ends chunks, of which those without a blank line follow one another in even steps.
    """
    least = int(size * 0.55)
    if overlap >= least:
        raise ValueError("overlap must be below 55 % of size")
    kind, hop = "array<struct<s:int,e:int>>", size - overlap
    none = F.array().cast(kind)
    lengths = F.transform(F.split(text, r"(?<=\n)(?=\n)"), F.length)
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("at"), F.lit(-1).alias("last"), none.alias("new"), F.array().cast(f"array<{kind}>").alias("out"))

    def state(pos, at, last, new, out) -> Column:
        return F.struct(pos.cast("int").alias("pos"), at.cast("int").alias("at"), last.cast("int").alias("last"), new.alias("new"), out.alias("out"))

    def closed(a: Column, to: Column) -> tuple[Column, Column, Column]:
        """The start, last blank line and chunks once all chunks are closed whose limits lie before ``to``."""
        ends = (to > a["at"] + size) & (a["last"] >= 0)
        at = F.when(ends, a["last"] - overlap).otherwise(a["at"])
        n = F.greatest(F.lit(0), F.ceil((to - size - at) / hop)).cast("int")
        even = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: span(at + k * hop, at + k * hop + size))).otherwise(none)
        return at + n * hop, F.when(ends | (n > 0), -1).otherwise(a["last"]), F.concat(F.when(ends, F.array(span(a["at"], a["last"]))).otherwise(none), even)

    def step(a: Column, length: Column) -> Column:
        pos = a["pos"] + length
        at, last, made = closed(a, pos - 1)
        ends_at = lambda at, last: F.when(pos - 1 > at + least, pos - 1).otherwise(last)
        full = F.size(a["new"]) >= GATHERED
        more = state(pos, at, ends_at(at, last), F.when(full, made).otherwise(F.concat(a["new"], made)), F.when(full, F.concat(a["out"], F.array(a["new"]))).otherwise(a["out"]))
        return F.when(pos - 1 <= a["at"] + size, state(pos, a["at"], ends_at(a["at"], a["last"]), a["new"], a["out"])).otherwise(more)

    def finish(a: Column) -> Column:
        n = F.length(text)
        at, last, made = closed(a, n)
        ending = F.when(last >= 0, F.array(span(at, last), span(last - overlap, n))).otherwise(F.array(span(at, n)))
        return F.concat(F.flatten(a["out"]), a["new"], made, ending)

    inner = F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0)))
    return F.when(F.length(text) > 0, F.aggregate(inner, start, step, finish)).otherwise(none)


def chunk_text(docs: DataFrame, key: str, text: str, size: int = 700, overlap: int = 200) -> DataFrame:
    """``key, chunk_index, start_char, end_char, chunk_text`` of each document; chunks are cut from blocks of the text, not from its whole."""
    d = docs.select(key, clean_markdown(F.col(text)).alias("t")).withColumn("b", chunk_bounds(F.col("t"), size, overlap))
    block = max(BLOCK, size)
    d = d.withColumn("blocks", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    own = lambda s: F.concat(F.get("blocks", F.floor(s / block).cast("int")), F.coalesce(F.get("blocks", F.floor(s / block).cast("int") + 1), F.lit("")))
    parts = F.transform("b", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), trim_all(F.substring(own(x.s), x.s % block + 1, x.e - x.s)).alias("c")))
    d = d.select(key, F.posexplode(F.filter(parts, lambda x: x.c != "")).alias("i", "x"))
    return d.select(key, F.col("i").alias("chunk_index"), F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char"), F.col("x.c").alias("chunk_text"))


def split_sections(md: Column) -> Column:
    """``array<struct<heading, text>>``: headings of one to four signs begin a section; what comes before is "Page"."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(md, "\r\n", "\n")), r"\n(?=#{1,4}\s+[^\n])")
    made = F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(i == 0, "Page").otherwise(strip_markdown(F.regexp_extract(p, r"^#{1,4}\s+([^\n]+)", 1))).alias("heading"),
            trim_all(F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^[^\n]*\n?", ""))).alias("text"),
        ),
    )
    kept = F.filter(made, lambda s: s.text != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit("Page").alias("heading"), md.alias("text"))))


def claim_candidates(text: Column) -> Column:
    """Sentences, bullets and table rows of 45 to 520 characters, without Markdown, distinct in this order."""
    sentences = F.regexp_extract_all(strip_markdown(text), F.lit(r"[^.!?]+[.!?]+(?=\s|\z)|[^.!?]+\z"), F.lit(0))
    ls = F.transform(F.split(text, "\n"), trim_all)
    bullets = F.filter(ls, lambda x: x.rlike(r"^[-*+]\s+") | x.rlike(r"^\d+\.\s+"))
    rows = F.filter(ls, lambda x: x.contains("|") & ~x.rlike(r"^[-\s|:]+\z"))
    return unique(F.filter(F.transform(F.concat(sentences, bullets, rows), strip_markdown), lambda x: F.length(x).between(45, 520)))


def extract_evidence(pages: DataFrame, per_page: int = 30) -> DataFrame:
    """Claims of ``pages(pack_id, url, title, markdown, tier, pos)``: the first ``per_page`` of a page, each url and claim once.

    Adds claim, quote, section, confidence, entities and claim_pos, an order of claims within the pack. What concerns one
    page is settled in its own row; only urls with several pages need more.
    """
    found = F.flatten(
        F.transform(
            split_sections(F.col("markdown")),
            lambda s, k: F.transform(claim_candidates(s.text), lambda c, i: F.struct(k.cast("int").alias("section_no"), i.cast("int").alias("no"), s.heading.alias("section"), c.alias("claim"))),
        )
    )
    c = pages.select("pack_id", "url", "title", "tier", "pos", F.filter(found, lambda x: scores.looks_like_claim(x.claim)).alias("cs"))
    c = c.withColumn("cs", F.transform("cs", lambda x: x.withField("claim", strip_markdown(x.claim)))).withColumn("low", F.transform("cs", lambda x: F.lower(x.claim)))
    first = F.filter("cs", lambda x, i: F.array_position("low", F.get("low", i)) == i + 1)
    c = c.select("pack_id", "url", "title", "tier", "pos", F.explode(F.slice(first, 1, per_page)).alias("x"))
    c = c.select("pack_id", "url", "title", "tier", F.struct("pos", "x.section_no", "x.no").alias("claim_pos"), "x.claim", "x.section")
    seen = c.groupBy("pack_id", "url", F.lower("claim").alias("low")).agg(F.min(F.struct("claim_pos", "title", "tier", "claim", "section")).alias("x"))
    c = seen.select("pack_id", "url", "x.title", "x.tier", "x.claim_pos", "x.claim", "x.section")
    claim = F.col("claim")
    quote = F.when(F.length(claim) > 360, F.concat(F.substring(claim, 1, 357), F.lit("..."))).otherwise(claim)
    return c.select("pack_id", "url", "title", "tier", "claim_pos", "claim", quote.alias("quote"), "section", scores.claim_confidence(F.col("tier"), F.col("section")).alias("confidence"), extract_entities(claim).alias("entities"))


def fallback_evidence(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """One general claim for each page without any: its title and the first 500 characters."""
    none = pages.join(evidence.select("pack_id", "url").distinct(), ["pack_id", "url"], "left_anti")
    return none.select("pack_id", "url", "title", "tier", F.concat(F.lit("Source page: "), "title").alias("claim"), preview(F.col("markdown"), 500).alias("quote"), F.when(F.col("tier").isin("official_docs", "trusted_docs"), 0.72).otherwise(0.55).alias("confidence"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the session's checkpoint folder; on one machine a folder is set where the session has none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return df.checkpoint()


def greedy_keep(rows: DataFrame, keys: list[str], pos: str = "pos", checkpoint=None, max_rounds: int = 100) -> DataFrame:
    """``rows`` with ``kept``: in order of ``pos`` a row stays unless an earlier row that stays shares a key with it.

    Rounds decide many rows at once: a row none of whose earlier sharers is open or kept stays, one with a kept
    earlier sharer goes. Each round looks up two least positions by key, a partial aggregation and a join each.
    ``checkpoint`` cuts the lineage of a round; by default the session's checkpoint folder.
    """
    cut = checkpoint or checkpointed
    now = cut(rows.withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(max_rounds):
        step = now
        gone, wait = F.lit(False), F.lit(False)
        for k, key in enumerate(keys):
            least = now.where("kept is null or kept").groupBy(F.col(key).alias(f"k{k}")).agg(F.min(F.when(F.col("kept"), F.col(pos))).alias(f"kept{k}"), F.min(F.when(F.col("kept").isNull(), F.col(pos))).alias(f"open{k}"))
            step = step.join(least, F.col(key) == F.col(f"k{k}"), "left")
            gone = gone | F.coalesce(F.col(f"kept{k}") < F.col(pos), F.lit(False))
            wait = wait | F.coalesce(F.col(f"open{k}") < F.col(pos), F.lit(False))
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(gone, False).when(~wait, True)
        now = cut(step.withColumn("kept", kept).select(now.columns))
        if now.where("kept is null").isEmpty():
            return now
    raise RuntimeError("duplicates did not settle")


def dedupe_pages(pages: DataFrame, checkpoint=None) -> DataFrame:
    """``pages(pos, url, markdown)`` with ``status``: new, duplicate_url or duplicate_content, by what earlier new pages registered."""
    p = pages.withColumn("url_key", canonicalize_url(F.col("url"))).withColumn("content_key", content_hash(F.col("markdown")))
    done = greedy_keep(p, ["url_key", "content_key"], checkpoint=checkpoint)
    first = done.where("kept").groupBy(F.col("url_key").alias("u")).agg(F.min("pos").alias("at"))
    found = done.join(first, F.col("url_key") == F.col("u"), "left")
    status = F.when(F.col("kept"), "new").when(F.col("at") < F.col("pos"), "duplicate_url").otherwise("duplicate_content")
    return found.select(*done.columns, status.alias("status")).drop("kept")


def near_pairs(good: DataFrame, threshold: float) -> DataFrame:
    """``u, v``: ids of ``good(pack_id, id, at, w)`` of one pack, u first in order of ``at``, with a Jaccard similarity of words over ``threshold``.

    Such sets share a word among the rarest of each, one more than they may lack (prefix filter), so these words are where they meet: ids with
    their order and size. The words themselves follow only for pairs that met and may be near by size.
    """
    words = good.select("pack_id", "id", F.explode("w").alias("x"))
    rare = words.join(words.groupBy("pack_id", "x").agg(F.count("*").alias("n")), ["pack_id", "x"])
    rare = rare.groupBy("pack_id", "id").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("r"))
    first = F.expr(f"slice(r, 1, size(r) - CAST(ceil(size(r) * {threshold}D - 1e-9D) AS INT) + 1)")
    met = rare.select("pack_id", "id", F.size("r").alias("size"), F.explode(first).alias("k")).select("pack_id", "id", "size", F.col("k.x").alias("x"))
    a, b = met.alias("a"), met.alias("b")
    near = F.least("a.size", "b.size") > F.greatest("a.size", "b.size") * F.lit(threshold)
    on = (F.col("a.pack_id") == F.col("b.pack_id")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.id") < F.col("b.id")) & near
    pairs = a.join(b, on).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    x, y = (good.select(F.col("id").alias(k), F.col("at").alias(f"{k}_at"), F.col("w").alias(f"{k}_w")) for k in "uv")
    both = pairs.join(x, "u").join(y, "v").where(jaccard(F.col("u_w"), F.col("v_w")) > threshold)
    ahead = F.col("u_at") < F.col("v_at")
    return both.select(F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("v"))


def near_dedupe_claims(claims: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``claims`` with ``quality`` and ``outcome``: quality_rejected, duplicate_rejected or kept.

    Within a pack, in order of quality (high first) and position: a claim goes if its words' Jaccard similarity with a kept one
    is over ``threshold``. Rounds decide many claims at once: one with a kept earlier neighbour goes, one whose earlier
    neighbours are all gone stays; the first open claim is decided in any round.
    """
    q = claims.withColumn("quality", scores.claim_quality(F.col("claim"), F.col("tier"), F.col("section"), F.col("entities")))
    q = checkpointed(q.withColumn("id", F.monotonically_increasing_id()))
    good = (F.col("quality.total") >= 40) & (F.size("entities") > 0)
    order = F.struct((-F.col("quality.total")).alias("o"), "claim_pos", "url", "id")
    pairs = checkpointed(near_pairs(q.where(good).select("pack_id", "id", order.alias("at"), word_set(F.col("claim")).alias("w")), threshold))
    heads = pairs.select(F.col("u").alias("id")).distinct().join(pairs.select(F.col("v").alias("id")), "id", "left_anti")
    done = checkpointed(heads.select("id", F.lit(True).alias("stays")))
    left = pairs
    while not left.isEmpty():
        by = left.join(done.select(F.col("id").alias("u"), "stays"), "u", "left")
        seen = by.groupBy("v").agg(F.max(F.coalesce("stays", F.lit(False))).alias("gone"), F.max(F.col("stays").isNull()).alias("open"))
        new = seen.where("gone or not open").select(F.col("v").alias("id"), (~F.col("gone")).alias("stays"))
        done = checkpointed(done.unionAll(new))
        left = checkpointed(left.join(done.select(F.col("id").alias("v")), "v", "left_anti"))
    out = q.join(done, "id", "left")
    return out.withColumn("outcome", F.when(~good, "quality_rejected").when(F.coalesce("stays", F.lit(True)), "kept").otherwise("duplicate_rejected")).drop("stays", "id")


def evidence_coverage(claims: DataFrame) -> DataFrame:
    """Counts by pack of ``near_dedupe_claims``' rows."""
    kept = F.col("outcome") == "kept"
    status = scores.verify_claim(F.col("claim"), F.col("quote"), F.col("url"), F.col("tier"), F.col("confidence"))
    of = lambda s: F.count_if(kept & (F.col("status") == s))
    return claims.withColumn("status", status).groupBy("pack_id").agg(
        F.count("*").alias("raw_claims"),
        F.count_if(kept).alias("kept_claims"),
        F.count_if(F.col("outcome") == "quality_rejected").alias("quality_rejected"),
        F.count_if(F.col("outcome") == "duplicate_rejected").alias("duplicate_rejected"),
        F.countDistinct(F.when(kept, F.col("url"))).alias("unique_sources"),
        F.countDistinct(F.when(kept & F.col("tier").isin("official_docs", "trusted_docs"), F.col("url"))).alias("official_sources"),
        of("supported").alias("supported"),
        of("weak").alias("weak"),
        of("unsupported").alias("unsupported"),
    )


def evidence_gaps(packs: DataFrame, coverage: DataFrame) -> DataFrame:
    """``packs(pack_id, use_case, ...)`` with the counts of ``evidence_coverage`` (0 where a pack has no claims) and ``missing``, what the evidence lacks."""
    counts = [c for c in coverage.columns if c != "pack_id"]
    g = packs.join(coverage, "pack_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    none, official = F.col("kept_claims") == 0, F.col("use_case").isin("api_facts", "comparison")
    missing = F.array_compact(
        F.array(
            F.when(none, F.lit("No claim-level evidence was collected.")),
            F.when(official & (F.col("official_sources") == 0), F.lit("No official/trusted sources were collected.")),
            F.when(~none & (F.col("supported") == 0), F.lit("Evidence was collected, but no claim passed citation verification.")),
        )
    )
    return g.withColumn("missing", missing)
