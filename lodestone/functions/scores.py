"""Scores of pages and claims, verification of claims, and retry rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.query import has
from lodestone.functions.text import EDGE, trim_all

QUALITY_ENTITY = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9.]*(?:\s+[A-Z][A-Za-z0-9.]*){0,3}" + EDGE


def by_tier(values: dict, tier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, tier), F.lit(values["unknown"]))


def rounded(x: Column) -> Column:
    """Half up."""
    return F.floor(x + 0.5)


def two_places(x: Column) -> Column:
    """A ratio up to 1 with two places, as SQL's printf writes it: its exact binary value is rounded, ties to the even digit."""
    whole = F.lit(1 << 60).cast("decimal(20,0)")
    parts = (x * float(1 << 60)).cast("long").cast("decimal(20,0)") * 100  # exact for all from 1/256 on
    left = parts % whole
    n = ((parts - left) / whole).cast("int")
    up = (left * 2 > whole) | ((left * 2 == whole) & (n % 2 == 1))
    return F.format_string("%.2f", (n + F.when(up, 1).otherwise(0)) / 100)


def page_features(md: Column) -> Column:
    """``struct<words, chars, unique_ratio, link_ratio, headings, code_blocks>`` of Markdown."""
    words = F.filter(F.split(md, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^[#\-*|\[\]()>]+\z"))
    plain = F.filter(F.transform(F.split(F.lower(md), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) > 2)
    ls = F.filter(F.transform(F.split(md, "\n"), trim_all), lambda x: x != "")
    links = F.filter(ls, lambda x: x.rlike(r"^(?i)https?://") | x.rlike(r"^\[.*?\]\(") | x.rlike(r"^\|.*\|\z"))
    ratio = lambda a, b: F.when(F.size(b) == 0, 0.0).otherwise(F.size(a) / F.size(b))
    return F.struct(
        F.size(words).alias("words"),
        F.length(md).alias("chars"),
        ratio(F.array_distinct(plain), plain).alias("unique_ratio"),
        ratio(links, ls).alias("link_ratio"),
        F.regexp_count(md, F.lit(r"(?m)^#{1,6}\s")).alias("headings"),
        (F.regexp_count(md, F.lit("```")) / 2).alias("code_blocks"),
    )


def page_quality(md: Column, f: Column) -> Column:
    """``struct<score, flags, status>`` from the text and its ``page_features``."""
    up_to = lambda most, x: F.least(F.lit(most).cast("double"), rounded(x).cast("double"))
    words, chars, unique, links = f["words"], f["chars"], f["unique_ratio"], f["link_ratio"]
    blocked = has(md, K.BLOCKED_PAGE)
    score = (
        F.when(words >= 30, up_to(25, words * 0.08)).otherwise(0.0)
        + F.when(chars > 500, up_to(10, chars * 0.005)).otherwise(0.0)
        + F.when(unique > 0.3, up_to(15, unique * 30)).otherwise(0.0)
        + F.when(links <= 0.45, up_to(10, (1 - links) * 15)).otherwise(0.0)
        + F.least(F.lit(10.0), f["headings"] * 3.0)
        + F.least(F.lit(8.0), f["code_blocks"] * 4.0)
    )
    score = F.least(F.lit(100.0), score)
    flag = lambda name, x: F.concat(F.lit(name + ":"), x)
    flags = F.array_compact(
        F.array(
            F.when(words < 30, flag("low_word_count", words.cast("string"))),
            F.when(chars < 200, flag("low_char_count", chars.cast("string"))),
            F.when(unique < 0.15, flag("low_unique_word_ratio", two_places(unique))),
            F.when(links > 0.45, flag("high_nav_ratio", two_places(links))),
            F.when(blocked, F.lit("blocked_content")),
        )
    )
    reject = (words < 30) | (chars < 200) | (links > 0.45) | (unique < 0.15) | blocked | (score < 20)
    return F.struct(score.alias("score"), flags.alias("flags"), F.when(reject, "reject").otherwise("accept").alias("status"))


def section_boost(heading: Column) -> Column:
    return F.when(has(heading, K.SECTION_BOOST_HIGH), 0.04).when(has(heading, K.SECTION_BOOST_LOW), 0.01).otherwise(0.0)


def claim_confidence(tier: Column, heading: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.round(by_tier(K.TIER_CONFIDENCE, tier) + section_boost(heading), 2)))


def tech_hits(claim: Column) -> Column:
    low = F.lower(claim)
    return sum((F.when(low.contains(t), 1).otherwise(0) for t in K.TECH_TERMS), F.lit(0))


def claim_quality(claim: Column, tier: Column, section: Column, entities: Column) -> Column:
    """``struct<total, specificity, authority, section_quality, domain_signal, entity_density, flags>``."""
    n_words = F.greatest(F.lit(1), F.size(F.split(claim, r"\s+")))
    found, hits, chars = F.regexp_count(claim, F.lit(QUALITY_ENTITY)), tech_hits(claim), F.length(claim)
    specificity = F.least(
        F.lit(30),
        F.when(claim.rlike("[0-9]"), 8).otherwise(0)
        + F.when(found >= 3, 10).when(found == 2, 7).when(found == 1, 3).otherwise(0)
        + F.when(hits >= 3, 7).when(hits == 2, 4).when(hits == 1, 2).otherwise(0)
        + F.when(chars >= 140, 5).when(chars >= 90, 3).otherwise(0),
    )
    authority = by_tier(K.TIER_AUTHORITY, tier)
    in_section = F.when(F.coalesce(section, F.lit("")) == "", 5).when(has(section, K.SECTION_API), 15).when(has(section, K.SECTION_GUIDE), 10).when(has(section, K.SECTION_HELP), 8).otherwise(5)
    domain = F.when(hits / n_words >= 0.15, 20).when(hits / n_words >= 0.08, 14).when(hits >= 3, 10).when(hits == 2, 6).when(hits == 1, 3).otherwise(0)
    named = F.size(F.filter(entities, lambda e: F.length(e) > 2))
    density = F.when(named / n_words >= 0.12, 10).when(named / n_words >= 0.06, 6).when(named >= 2, 4).when(named == 1, 2).otherwise(0)
    low = trim_all(F.lower(claim))
    navigation = low.rlike("^(click|read|learn|see|visit|go to|check out|find out|skip to)")
    flags = F.array_compact(F.array(F.when(navigation, F.lit("navigation_like")), F.when(F.length(low) < 60, F.lit("too_short")), F.when(found == 0, F.lit("no_entities"))))
    total = specificity + authority + in_section + domain + density
    return F.struct(
        F.when(navigation, F.least(total, F.lit(20))).otherwise(total).cast("int").alias("total"),
        specificity.cast("int").alias("specificity"),
        authority.cast("int").alias("authority"),
        in_section.cast("int").alias("section_quality"),
        domain.cast("int").alias("domain_signal"),
        density.cast("int").alias("entity_density"),
        flags.alias("flags"),
    )


def looks_like_claim(text: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hit = F.lit(False)
    for w in K.CLAIM_WORDS:
        hit = hit | low.contains(w)
    return (F.length(text) >= 45) & ~text.rlike(r"^(?i)(home|next|previous|skip to|copyright|privacy|terms)(?![A-Za-z0-9_])") & hit


def verify_claim(claim: Column, quote: Column, url: Column, tier: Column, confidence: Column) -> Column:
    """supported, weak or unsupported."""
    usable = (F.length(trim_all(F.coalesce(quote, F.lit("")))) >= 20) & F.coalesce(url.rlike(r"^(?i)https?://"), F.lit(False)) & (trim_all(F.coalesce(claim, F.lit(""))) != "")
    strong = tier.isin("official_docs", "trusted_docs") & (confidence >= 0.70)
    return F.when(~usable, "unsupported").when((confidence >= 0.75) | strong, "supported").when(confidence >= 0.55, "weak").otherwise("unsupported")


def is_blocked_reason(reason: Column) -> Column:
    return F.coalesce(reason.rlike("(?i)403|blocked|forbidden"), F.lit(False))


def should_retry(accepted: Column, skipped: Column, failed: Column, returned: Column, error: Column) -> Column:
    """``skipped`` pages alone give no reason to try again, nor does an empty error."""
    return F.when(accepted > 0, False).when(F.coalesce(error, F.lit("")) != "", True).when(returned > 0, True).otherwise(failed > 0)
