"""What models and jobs say in JSON: tolerant parsing, typed labels, strategy outputs. All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import once, trim_all

# Intents and tools that a model may name.
INTENTS = ["github_repo", "news", "web_research", "kb", "code", "document", "general"]
TOOLS = ["search_kb", "web_research", "crawl_url", "query_graph", "github_repo"]
#: Fields that a strategy output must have, by type; arrays and strings.
REQUIRED = {"comparison_table": {"entities": "ARRAY", "columns": "ARRAY", "rows": "ARRAY"}, "factual_answer": {"answer": "STRING"}, "document_qa": {"answer": "STRING"}, "research_summary": {"summary": "STRING"}}
OUTPUT = "struct<type:string,title:string,columns:array<string>,rows:array<map<string,string>>,recommendation:string,answer:string,details:array<string>,key_points:array<string>,insights:array<string>,recommendations:array<string>,limitations:array<string>,citations:array<struct<text:string,source:string>>,summary:string,key_findings:array<string>>"


def kind_of(value: Column) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, ...; null for none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_json(text: Column, kinds: str = "OBJECT|ARRAY") -> Column:
    """Whether a whole text is JSON of one of the kinds."""
    whole = text.rlike(r"(?s)^\s*(?:\{.*\}|\[.*\])\s*\z")
    return F.coalesce(whole & kind_of(F.try_parse_json(text)).rlike(f"^(?:{kinds})$"), F.lit(False))


def strip_code_fence(text: Column) -> Column:
    """Without a fence, if the text begins with one."""
    t = trim_all(text)
    bare = trim_all(F.regexp_replace(F.regexp_replace(t, r"^(?i)```(?:python|py)?\s*", ""), r"```\z", ""))
    return F.when(t.startswith("```"), bare).otherwise(t)


def json_object_from_text(text: Column) -> Column:
    """The text if it is a JSON object or array, else what stands from the first brace to the last if that is one; null otherwise."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(is_json(text), trim_all(text)).when(is_json(inner), inner)


def truthy(value: Column) -> Column:
    """Whether a variant counts as true: not null, false, zero or the empty string."""
    kind, text = kind_of(value), F.try_variant_get(value, "$", "string")
    return F.coalesce(F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.isin("OBJECT", "ARRAY"), True).when(kind == "VOID", False).otherwise(F.try_variant_get(value, "$", "double") != 0), F.lit(False))


def parse_model_labels(text: Column) -> Column:
    """``struct<intent, tools, mode, fresh, web, github, reason>`` of a model's classification; defaults where it says nothing that is allowed."""

    def labels(raw: Column) -> Column:
        v = F.try_parse_json(raw)
        get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
        is_text = lambda name: F.coalesce(kind_of(get(name, "variant")) == "STRING", F.lit(False))
        named = F.coalesce(get("requiredTools", "array<string>"), F.array().cast("array<string>"))
        tools = F.array_distinct(F.filter(named, lambda t: t.isin(TOOLS)))
        intent, mode = get("intent", "string"), get("answerMode", "string")
        return F.struct(
            F.when(intent.isin(INTENTS), intent).otherwise("general").alias("intent"), tools.alias("tools"), F.when(mode == "deep", "deep").otherwise("fast").alias("mode"),
            truthy(get("requiresFreshness", "variant")).alias("fresh"), (truthy(get("requiresWeb", "variant")) | F.array_contains(tools, "web_research")).alias("web"), (truthy(get("requiresGithub", "variant")) | F.array_contains(tools, "github_repo")).alias("github"),
            F.when(is_text("reason"), get("reason", "string")).when(v.isNotNull(), "Classified by fast intent model.").alias("reason"),
        )

    return once(json_object_from_text(text), labels)


def strategy_output(text: Column) -> Column:
    """``struct<type, missing, markdown>`` of a strategy's JSON: fields that its type requires and it lacks, and its Markdown if none is; null without a known type."""

    def made(raw: Column) -> Column:
        v, o = F.try_parse_json(raw), F.from_json(raw, OUTPUT)
        has = lambda name, kind: F.coalesce(kind_of(F.try_variant_get(v, f"$.{name}", "variant")) == kind, F.lit(False))
        missing = F.coalesce(*[F.when(o["type"] == t, F.array_compact(F.array(*[F.when(~has(f, k), F.lit(f)) for f, k in fields.items()]))) for t, fields in REQUIRED.items()])
        return F.when(missing.isNotNull(), F.struct(o["type"].alias("type"), missing.alias("missing"), F.when(F.size(missing) == 0, rendered(o)).alias("markdown")))

    return once(F.when(is_json(text, "OBJECT"), trim_all(text)), made)


def rendered(o: Column) -> Column:
    """The Markdown of a valid strategy output."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    none, line = F.array().cast("array<string>"), lambda *xs: F.array(*xs)
    part = lambda head, c: F.when(some(c), F.concat(line(F.lit(f"### {head}"), F.lit("")), bullets(c), line(F.lit("")))).otherwise(none)
    cell = lambda row, name: F.coalesce(F.nullif(F.try_element_at(row, name), F.lit("")), F.lit("—"))
    entity = lambda row: F.coalesce(*[F.nullif(F.try_element_at(row, F.lit(k)), F.lit("")) for k in ("Entity", "entity", "name")], F.lit("—"))
    joined = lambda xs: F.array_join(xs, " | ")
    table = F.concat(
        line(F.concat(F.lit("## "), F.coalesce(o["title"], F.lit("undefined"))), F.lit(""), F.concat(F.lit("| Entity | "), joined(o["columns"]), F.lit(" |")), F.concat(F.lit("| --- | "), joined(F.transform(o["columns"], lambda _: F.lit("---"))), F.lit(" |"))),
        F.transform(o["rows"], lambda r: F.concat(F.lit("| "), entity(r), F.lit(" | "), joined(F.transform(o["columns"], lambda c: cell(r, c))), F.lit(" |"))),
        line(F.lit("")),
        F.when(F.coalesce(o["recommendation"], F.lit("")) != "", line(F.lit("### Recommendation"), F.lit(""), o["recommendation"], F.lit(""))).otherwise(none),
    )
    listed = lambda c: F.when(some(c), F.concat(bullets(c), line(F.lit("")))).otherwise(none)
    cited = F.flatten(F.transform(F.coalesce(o["citations"], F.array().cast("array<struct<text:string,source:string>>")), lambda c: F.array(F.concat(F.lit("> "), c.text), F.concat(F.lit("> — "), c.source), F.lit(""))))
    of = {
        "comparison_table": table,
        "factual_answer": F.concat(line(o["answer"], F.lit("")), listed(o["details"])),
        "document_qa": F.concat(line(o["answer"], F.lit("")), part("Key Points", o["key_points"]), part("Insights", o["insights"]), part("Recommendations", o["recommendations"]), part("Limitations", o["limitations"]), F.when(some(o["citations"]), F.concat(line(F.lit("### Citations"), F.lit("")), cited)).otherwise(none)),
        "research_summary": F.concat(line(o["summary"], F.lit("")), part("Key Findings", o["key_findings"])),
    }
    return F.array_join(F.coalesce(*[F.when(o["type"] == t, x) for t, x in of.items()]), "\n")
