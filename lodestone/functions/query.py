"""Understanding questions: expressions over a query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.text import trim_all, whole_words


def has(text: Column, alternatives: str) -> Column:
    return text.rlike(whole_words(alternatives))


def normalize_query(q: Column) -> Column:
    for words, name in ((r"mets\s+graph\s+api", "Meta Graph API"), (r"meta\s+ads\s+api", "Meta Marketing API"), (r"facebook\s+ads\s+api", "Meta Marketing API")):
        q = F.regexp_replace(q, whole_words(words), name)
    return trim_all(q)


def infer_use_case(q: Column) -> Column:
    return F.when(has(q, K.COMPARISON), "comparison").when(has(q, K.API_FACTS), "api_facts").when(has(q, K.IMPLEMENTATION), "implementation_help").when(has(q, K.TUTORIAL), "tutorial").otherwise("general_research")


def needs_official_docs(use_case: Column) -> Column:
    return use_case.isin("api_facts", "comparison", "implementation_help")


def needs_freshness_planner(q: Column) -> Column:
    return has(q, K.FRESH_PLAN)


def is_freshness_required(q: Column) -> Column:
    return has(q, K.FRESH_QUERY)


def fallback_queries(q: Column) -> Column:
    n, use = normalize_query(q), infer_use_case(normalize_query(q))
    of = lambda *tails: F.array(*[F.concat(n, F.lit(" " + t)) for t in tails])
    return (
        F.when(use.isin("api_facts", "comparison"), of("official documentation", "API reference official docs", "permissions rate limits official docs"))
        .when(use == "implementation_help", of("official docs", "GitHub issue", "StackOverflow fix"))
        .otherwise(of("official docs", "documentation"))
    )


def plan_subqueries(q: Column) -> Column:
    """``array<struct<query, priority>>``: fallbacks from 100 down by 10, official docs (120) first, changelog (75) last; the first of equal ones stays."""
    n = normalize_query(q)
    item = lambda text, p: F.struct(text.alias("query"), p.cast("int").alias("priority"))
    base = F.transform(fallback_queries(q), lambda x, i: item(x, 100 - 10 * i))
    none = F.array().cast("array<struct<query:string,priority:int>>")
    first = F.when(needs_official_docs(infer_use_case(n)), F.array(item(F.concat(n, F.lit(" official docs")), F.lit(120)))).otherwise(none)
    last = F.when(needs_freshness_planner(n), F.array(item(F.concat(n, F.lit(" latest update changelog")), F.lit(75)))).otherwise(none)
    whole = F.filter(F.transform(F.concat(first, base, last), lambda x: item(trim_all(x.query), x.priority)), lambda x: x.query != "")
    return F.aggregate(whole, none, lambda kept, x: F.when(F.exists(kept, lambda k: k.query == x.query), kept).otherwise(F.concat(kept, F.array(x))))


def provider_route(q: Column) -> Column:
    """``struct<kind, providers, fresh>``."""
    of = lambda kind, fresh, *p: F.struct(F.lit(kind).alias("kind"), F.array(*map(F.lit, p)).alias("providers"), F.lit(fresh).alias("fresh"))
    return F.when(has(q, K.CODE_QUERY), of("code", False, "github", "tavily", "firecrawl")).when(has(q, K.FRESH_QUERY), of("freshness", True, "tavily", "firecrawl")).otherwise(of("docs", False, "tavily", "firecrawl"))


def answer_mode(q: Column, use_case: Column) -> Column:
    use = F.coalesce(use_case, F.lit(""))
    return (
        F.when(has(q, K.MODE_COMPARISON) | (use == "comparison"), "comparison")
        .when(has(q, K.MODE_HOW_TO) | use.isin("implementation_help", "tutorial"), "how_to")
        .when(has(q, K.MODE_SUMMARY), "research_summary")
        .otherwise("general")
    )
