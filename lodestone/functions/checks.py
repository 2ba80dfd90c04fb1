"""Whether an answer is one: rules over its text. All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions.intents import holds
from lodestone.functions.model_json import json_object_from_text
from lodestone.functions.text import once, trim_all


def numeric_dump(text: Column) -> Column:
    """Whether a text is mostly figures: lines, currency values, percentages or table rows."""
    ls = F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != "")
    share = F.try_divide(F.size(F.filter(ls, lambda x: F.regexp_count(x, F.lit("[0-9]")) / F.length(x) > 0.2)), F.size(ls))
    money = F.regexp_count(text, F.lit(r"[$€£¥]\s*[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"))
    percent = F.regexp_count(text, F.lit(r"[0-9]+(?:\.[0-9]+)?%"))
    rows = F.regexp_count(text, F.lit(r"(?m)^\|.+\|$"))
    return (F.size(ls) >= 3) & ((share > 0.35) | (money > 15) | (percent > 15) | ((rows > 20) & (share > 0.25)))


def generic_or_raw(text: Column) -> Column:
    """Empty, a stock phrase, a reference to something above, raw data or figures; null counts."""
    t = trim_all(text)
    low = F.lower(t)
    return F.coalesce((t == "") | low.isin(K.STOCK_ANSWERS) | holds(low, K.PLACEHOLDERS) | holds(t, K.RAW_MARKERS) | numeric_dump(t), F.lit(True))


def bad_answer(text: Column) -> Column:
    """Vague, from weak sources, with empty cells, with figures that look made up, or a dump."""
    low = F.lower(text)
    varies = F.regexp_count(low, F.lit(r"(?<![A-Za-z0-9_])varies(?![A-Za-z0-9_])")) >= 3
    made_up = text.rlike(r"(?<![A-Za-z0-9_])[0-9]{4,}(?![A-Za-z0-9_])") & low.rlike(r"(?<![A-Za-z0-9_])(?:api|version|endpoint)(?![A-Za-z0-9_])")
    dump = holds(low, K.DUMP_KEYS) | (low.contains('"type"') & low.contains('"output"'))
    return varies | holds(low, K.WEAK_MENTIONS) | holds(low, K.EMPTY_CELLS) | made_up | dump | numeric_dump(text)


def empty_or_generic(text: Column) -> Column:
    t = trim_all(text)
    low = F.lower(t)
    return low.isin("", "none", "null", "undefined") | (F.length(t) < 25) | holds(low, K.GENERIC_PHRASES)


def heuristic_critic(query: Column, answer: Column, required: Column, called: Column, n_results: Column, threshold: float = 0.65) -> Column:
    """``struct<passed, score, missing>``: .15 generic, .25 without a required tool, .35 without needed sources, else the mean of four dimensions."""
    missing = F.array_except(required, called)
    sources = F.array_contains(required, "web_research") | F.array_contains(required, "github_repo") | holds(F.lower(query), K.NEEDS_SOURCES)
    length = F.least(F.lit(1.0), F.length(answer) / 800)
    structure = F.when(answer.rlike(r"\n|```|[0-9]\.|- |\*"), 0.15).otherwise(0.0)
    concrete = F.when(answer.rlike(r"[A-Z][A-Za-z0-9_/-]{2,}|https?://|/[A-Za-z0-9_.-]+|`[^`]+`"), 0.2).otherwise(0.0)
    specificity = F.least(F.lit(1.0), F.lit(0.45) + length * 0.25 + structure + concrete)
    use = F.when(n_results > 0, 0.75).when(sources, 0.35).otherwise(0.65)
    mean = (F.lit(0.7) + specificity + F.least(F.lit(1.0), F.lit(0.55) + length * 0.3) + use) / 4
    score = F.when(empty_or_generic(answer), 0.15).when(F.size(missing) > 0, 0.25).when(sources & (n_results == 0), 0.35).otherwise(mean)
    judged = ~empty_or_generic(answer) & (F.size(missing) == 0) & ~(sources & (n_results == 0))
    return F.struct((judged & (mean >= threshold)).alias("passed"), score.alias("score"), missing.alias("missing"))


def coding_override(query: Column, answer: Column, critic: Column) -> Column:
    """The critic's score, at least .82 for a useful answer to a coding question that it passed."""
    useful = ~empty_or_generic(answer) & (answer.contains("```") | answer.rlike(r"(?<![A-Za-z0-9_])(?:def|function)\s+[A-Za-z0-9_]+\s*\(|(?<![A-Za-z0-9_])class\s+[A-Za-z0-9_]+") | holds(F.lower(answer), ["time complexity", "space complexity", "while ", "return "]))
    return F.when(critic["passed"] & holds(F.lower(query), K.CODING_TASK) & useful, F.greatest(critic["score"], F.lit(0.82))).otherwise(critic["score"])


def final_gate(final: Column, required: Column, called: Column) -> Column:
    """Why a final answer is refused: missing_tools, empty, or null."""
    return F.when(F.size(F.array_except(required, called)) > 0, "missing_tools").when(F.lower(trim_all(F.coalesce(final, F.lit("")))).isin(K.EMPTY_FINALS), "empty")


def critic_json(text: Column, threshold: float = 0.65) -> Column:
    """``struct<passed, score>`` of a model's verdict in JSON, or of the part from the first brace to the last; null without one."""
    kind = "struct<passed: boolean, score: double, dimensions: struct<relevance: double, specificity: double, completeness: double, sourceUse: double>>"
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))

    def verdict(raw: Column) -> Column:
        j = F.from_json(raw, kind)
        d = j["dimensions"]
        mean = (unit(d["relevance"]) + unit(d["specificity"]) + unit(d["completeness"]) + unit(d["sourceUse"])) / 4
        score = F.when(j["score"].isNotNull(), unit(j["score"])).otherwise(mean)
        return F.when(raw.isNotNull(), F.struct((F.coalesce(j["passed"], F.lit(False)) & (score >= threshold)).alias("passed"), score.alias("score")))

    return once(json_object_from_text(text), verdict)
