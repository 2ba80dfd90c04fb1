"""Text, hash and URL expressions, and tokens of queries. All are Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K

#: The end of a word, or the place before one, in ASCII.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ENTITY = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9.+#-]*(?:\s+[A-Z][A-Za-z0-9.+#-]*){0,4}" + EDGE


def whole_words(alternatives: str) -> str:
    """A pattern for whole ASCII words in any case; letters such as é end a word."""
    return f"(?i)(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def trim_all(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, r"^\s+|\s+\z", "")


def unique(values: Column) -> Column:
    """Trimmed, non-empty, distinct in order of first sight."""
    return F.array_distinct(F.filter(F.transform(values, trim_all), lambda x: x != ""))


def hostname(url: Column) -> Column:
    """Lower-case host without ``www.``; empty where the url can't be read."""
    return F.coalesce(F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^(?i)www\.", "")), F.lit(""))


def host_matches(host: Column, domain: Column | str) -> Column:
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def infer_tier(url: Column) -> Column:
    """The first tier that lists the url's host or a parent of it."""
    host, out = hostname(url), F.lit("unknown")
    for tier, domains in reversed(K.TIER_DOMAINS.items()):
        hit = F.lit(False)
        for d in domains:
            hit = hit | host_matches(host, d)
        out = F.when(hit, tier).otherwise(out)
    return out


def canonicalize_url(url: Column) -> Column:
    """Lower host without ``www.``, no fragment, no tracking parameters, sorted parameters, no trailing slash but the root's."""
    part = lambda k: F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, r"/\z", "")).otherwise(path)
    params = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(K.TRACKING))
    # by key; parameters of one key keep their order
    keyed = F.array_sort(F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(keyed, lambda x: x.p), "&")
    made = F.concat(F.lower(part(1)), F.lit("://"), F.regexp_replace(F.lower(part(2)), r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(2) == "", url).otherwise(made)


def normalize_url(url: Column) -> Column:
    """Origin, path without one trailing slash, and query; the fragment is dropped."""
    bare = F.regexp_replace(url, r"#.*", "")
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).otherwise(F.regexp_replace(bare, r"/(?=\z|\?)", ""))


def page_key(url: Column) -> Column:
    """A url without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*", ""), r"/+\z", "")


def hrefs(html: Column) -> Column:
    """The link targets of a page's anchors, in order."""
    quoted = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    return F.filter(F.transform(quoted, lambda x: F.regexp_replace(x, "^.|.$", "")), lambda x: x != "")


def resolved(base: Column, href: Column) -> Column:
    """``href`` as an address, seen from the page ``base``; without fragment and trailing slashes."""
    part = lambda k: F.regexp_extract(base, r"^(([a-zA-Z][a-zA-Z0-9+.-]*:)//[^/?#]*)([^?#]*)", k)
    path = part(3)
    full = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(2), href))
        .when(href.startswith("/"), F.concat(part(1), href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(part(1), path, href))
        .otherwise(F.concat(part(1), F.regexp_replace(path, r"/[^/]*\z", ""), F.lit("/"), href))
    )
    return page_key(full)


def to_follow(base: Column, link: Column) -> Column:
    """Whether a crawl of ``base``'s site follows a link: http(s), of the same host, and none of the fixed parts in it."""
    site = lambda u: F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]*)", 1)
    low, out = F.lower(link), link.rlike("^(?i)https?://") & (site(base) == site(link))
    for part in K.UNFOLLOWED:
        out = out & ~low.contains(part)
    return out


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def content_hash(text: Column) -> Column:
    """A rolling 32-bit hash over the UTF-16 units of the trimmed, collapsed, lower-case text, in base 36 of at least 7 digits.

    A step takes twelve characters, the first of which may be padding of the value zero; only texts with characters of two units are gone
    through one by one.
    """
    mask = F.lit(4294967295)
    roll = lambda a, unit: (a * 31 + unit).bitwiseAND(mask)

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        pair = F.shiftright(code - 65536, 10) + 55296, (code - 65536).bitwiseAND(F.lit(1023)) + 56320
        return F.when(code < 65536, roll(a, code)).otherwise(roll(roll(a, pair[0]), pair[1]))

    def steps(a: Column, block: Column) -> Column:
        for k in range(12):
            a = a * 31 + F.ascii(F.substring(block, k + 1, 1))
            a = a.bitwiseAND(mask) if k % 6 == 5 else a  # six steps stay within 64 bits
        return a

    def rolled(s: Column) -> Column:
        padded = F.lpad(s, F.ceil(F.length(s) / 12).cast("int") * 12, "\0")
        whole = F.aggregate(F.regexp_extract_all(padded, F.lit("(?s).{12}"), F.lit(0)), F.lit(0).cast("long"), steps)
        return F.when(s == "", 0).when(s.rlike(r"[\x{10000}-\x{10FFFF}]"), F.aggregate(F.split(s, ""), F.lit(0).cast("long"), step)).otherwise(whole)

    plain = F.lower(F.regexp_replace(trim_all(text), r"\s+", " "))
    h = once(plain, rolled)
    digits = once(h, lambda h: F.lower(F.conv(F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h)).cast("string"), 10, 36)))
    return once(digits, lambda d: F.when(F.length(d) < 7, F.lpad(d, 7, "0")).otherwise(d))


def hash_text(text: Column) -> Column:
    return F.sha2(text, 256)


def clean_markdown(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{4,}", "\n\n\n"))


def preview(text: Column, n: int) -> Column:
    """The first n characters, and how many were cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("\n...[truncated "), (F.length(text) - n).cast("string"), F.lit(" chars]")))


def shorten(text: Column, n: int) -> Column:
    one = trim_all(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.substring(one, 1, n - 3), F.lit("...")))


def strip_markdown(text: Column) -> Column:
    """Plain text: fences, tags, bullets, numbers and pipes go, code and links keep their words. Links come before images."""
    bare = text
    for pattern, to in ((r"(?s)```.*?```", " "), ("`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), ("<[^>]+>", " "), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\|", " ")):
        bare = F.regexp_replace(bare, pattern, to)
    marked = text.rlike(r"(?m)[`\[<|]|^\s*(?:[-*+]|\d+\.)\s")  # most text isn't, and needs none of the above
    return trim_all(F.regexp_replace(F.when(marked, bare).otherwise(text), r"\s+", " "))


def extract_entities(text: Column, most: int = 10) -> Column:
    """Runs of up to five capitalised words, distinct, the first ``most``."""
    return F.slice(unique(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))), 1, most)


def infer_year(text: Column, now_year: Column | int) -> Column:
    """The latest year from 2018 to the next one that a text names."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])20\d{2}(?![A-Za-z0-9_])"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: (y >= 2018) & (y <= now_year + 1)))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of over two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def query_tokens(query: Column, longer_than: int = 0) -> Column:
    """Lower-case tokens of letters, digits and ``.+#-``, longer than ``longer_than`` characters."""
    clean = F.regexp_replace(F.lower(query), r"[^a-z0-9.+#\s-]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > longer_than)


def quoted_phrases(query: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), trim_all), lambda x: x != "")
