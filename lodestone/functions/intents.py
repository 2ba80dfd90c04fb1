"""What a question asks for: rules over its text. All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.query import has
from lodestone.functions.text import ENTITY, trim_all, unique

GITHUB = r"(?i)https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"


def holds(text: Column, parts: list[str]) -> Column:
    """Whether a text holds one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def fast_intent(q: Column) -> Column:
    """``struct<intent, fresh, web, github, tools, mode>`` by the first rule that fits."""

    def of(intent: str, fresh: bool, web: bool, github: bool, tools: list[str], mode: str = "fast") -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(fresh).alias("fresh"), F.lit(web).alias("web"), F.lit(github).alias("github"), F.array(*map(F.lit, tools)).cast("array<string>").alias("tools"), F.lit(mode).alias("mode"))

    return (
        F.when(q.rlike(GITHUB), of("github_repo", False, True, True, ["github_repo"]))
        .when(has(q, K.INTENT_KB), of("kb", False, False, False, ["search_kb"]))
        .when(has(q, K.INTENT_NEWS), of("news", True, True, False, ["web_research"]))
        .when(has(q, K.INTENT_WEB), of("web_research", True, True, False, ["web_research"]))
        .when(has(q, K.INTENT_DOCUMENT), of("document", False, False, False, ["search_kb"]))
        .when(has(q, K.INTENT_CODE), of("code", False, False, False, [], "deep"))
        .otherwise(of("general", False, False, False, []))
    )


def fallback_intent(q: Column) -> Column:
    """``struct<kind, normalized, web, table>`` by parts of the text."""
    low = F.lower(q)
    table, web = holds(low, K.WANTS_TABLE), holds(low, K.NEEDS_WEB)
    name = F.regexp_replace(q, r"(?i)(?<![A-Za-z0-9_])mets\s+graph\s+api(?![A-Za-z0-9_])", "Meta Graph API")
    return F.struct(F.when(table, "comparison").when(web, "web_research").otherwise("simple_answer").alias("kind"), name.alias("normalized"), web.alias("web"), table.alias("table"))


def should_use_strategy(q: Column) -> Column:
    return (F.length(q) > 180) | holds(F.lower(q), K.COMPLEX_QUERY)


def strategy_type(q: Column) -> Column:
    """document_qa, comparison_table, research_summary or null."""
    low = F.lower(q)
    return F.when(holds(low, K.STRATEGY_DOCUMENT), "document_qa").when(holds(low, K.STRATEGY_TABLE), "comparison_table").when(holds(low, K.STRATEGY_SUMMARY), "research_summary")


def repo_search_query(q: Column) -> Column:
    """A query for a repository search; null where the text isn't about code."""
    cut = F.substring(trim_all(q), 1, 180)
    named = cut.rlike(r"(?<![A-Za-z0-9_])in:")
    return F.when(has(q, K.REPO_QUERY), F.when(named, cut).otherwise(F.concat(cut, F.lit(" in:name,description,readme"))))


def query_entities(q: Column) -> Column:
    """Runs of up to five capitalised words, distinct, the first twelve."""
    return F.slice(unique(F.regexp_extract_all(q, F.lit(ENTITY), F.lit(0))), 1, 12)
