"""What jobs answered, from which sources, and where it is written: nested JSON searched in rounds, lists in pages, idempotent writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.model_json import is_json, kind_of
from lodestone.functions.text import host_matches, hostname, trim_all
from lodestone.operators.evidence import checkpointed
from lodestone.operators.runs import STRONG_HOSTS, WEAK_HOSTS

# The mark of a research response, keys that may hold one, answers that say nothing.
VERSION = "research-response-v1"
PREFERRED = ["result", "finalOutput", "final", "output", "response", "data", "research"]
STOCK = ["done", "completed", "all questions have been answered.", "the task is complete.", "task complete"]
POINTERS = ["the comparison table", "the table above", "as shown above", "are provided above", "is provided above", "see above", "refer to the", "see the table"]


def members(raw: Column) -> Column:
    """``array<struct<key, value, kind>>`` of a JSON object or array in its own order; objects and arrays stay JSON, the key of an item is null."""
    text, kinds = F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>"))
    fields = F.transform(text, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), kind_of(F.get(kinds, i)).alias("kind")))
    items, item_kinds = F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>")
    listed = F.transform(items, lambda x, i: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"), kind_of(F.get(item_kinds, i)).alias("kind")))
    return F.when(raw.startswith("{"), fields).otherwise(listed)


def find_contracts(values: DataFrame, depth: int = 4) -> DataFrame:
    """``job_id, contract``: the first research response that ``values(job_id, turn, raw)`` hold, the JSON of reports, runs and steps in turn.

    A value may be a response, or an object that holds one at up to ``depth`` levels, under preferred keys first, then under any, in order. Each level
    is a round over the objects that may hold one.
    """
    found, level = [], values.where(F.col("raw").contains(VERSION)).withColumn("raw", trim_all(F.col("raw"))).where(is_json(F.col("raw"), "OBJECT")).withColumn("way", F.array().cast("array<int>"))
    for k in range(depth + 1):
        level = checkpointed(level)
        is_one = F.get_json_object("raw", "$.contractVersion") == VERSION
        found.append(level.where(is_one))
        if k == depth:
            break
        inner = level.where(~F.coalesce(is_one, F.lit(False))).select("job_id", "turn", "way", F.posexplode(members(F.col("raw"))).alias("i", "x"))
        rank = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("x.key"))
        place = F.when(rank > 0, rank.cast("int")).otherwise(F.col("i") + len(PREFERRED) + 1)
        level = inner.where((F.col("x.kind") == "OBJECT") & F.col("x.value").contains(VERSION)).select("job_id", "turn", F.col("x.value").alias("raw"), F.array_append("way", place).alias("way"))
    return reduce(DataFrame.unionByName, found).groupBy("job_id").agg(F.min_by("raw", F.struct("turn", "way")).alias("contract"))


def nested_sources(values: DataFrame) -> DataFrame:
    """``job_id, at, title, url, score, retrieval`` of every object with a title or url in ``values(job_id, turn, raw)``, in order of sight; a round a level, to any depth."""
    level = values.withColumn("raw", trim_all(F.col("raw"))).where(is_json(F.col("raw"))).select("job_id", "raw", F.array(F.struct(F.col("turn").cast("int").alias("i"))).alias("at"))
    found = None
    while True:
        level = checkpointed(level.withColumn("v", F.try_parse_json("raw")))
        if level.isEmpty() and found is not None:
            break
        get = lambda name, kind: F.when(kind_of(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING" if kind == "string" else kind_of(F.try_variant_get("v", f"$.{name}", "variant")).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get("v", f"$.{name}", kind))  # noqa: E731, B023
        one = level.where(F.col("raw").startswith("{")).select("job_id", "at", F.coalesce(get("title", "string"), get("sourceTitle", "string")).alias("title"), F.coalesce(get("sourceUrl", "string"), get("url", "string")).alias("url"), get("score", "double").alias("score"), get("retrieval", "string").alias("retrieval"))
        one = one.where((F.coalesce("title", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))
        found = one if found is None else found.unionAll(one)
        inner = level.select("job_id", "at", F.posexplode(members(F.col("raw"))).alias("i", "x")).where(F.col("x.kind").isin("OBJECT", "ARRAY"))
        level = inner.select("job_id", F.col("x.value").alias("raw"), F.array_append("at", F.struct(F.col("i").alias("i"))).alias("at"))
    return found


def extract_sources(finals: DataFrame, steps: DataFrame, most: int = 8) -> DataFrame:
    """``job_id, place, title, url, score, retrieval``: what a job's answer and steps name as sources, each once, weak hosts left out, strong ones first.

    ``finals(job_id, raw)`` is the answer's JSON; ``steps(job_id, step, raw, stdout)`` have JSON of their own and text in which addresses stand.
    """
    turn = F.col("step").cast("int") * 2
    raws = finals.select("job_id", F.lit(-1).alias("turn"), "raw").unionAll(steps.select("job_id", turn.alias("turn"), "raw"))
    seen = nested_sources(raws)
    urls = steps.select("job_id", turn.alias("turn"), F.posexplode(F.regexp_extract_all(F.coalesce("stdout", F.lit("")), F.lit(r"""https?://[^\s'",}]+"""), F.lit(0))).alias("i", "url"))
    none = lambda k: F.lit(None).cast(k)
    seen = seen.unionAll(urls.select("job_id", F.array(F.struct((F.col("turn") + 1).alias("i")), F.struct("i")).alias("at"), none("string"), "url", none("double"), none("string")))
    first = seen.groupBy("job_id", F.coalesce("title", F.lit("")).alias("t"), F.coalesce("url", F.lit("")).alias("u")).agg(F.min_by(F.struct("title", "url", "score", "retrieval"), "at").alias("x"), F.min("at").alias("at"))
    host = hostname(F.col("u"))
    any_of = lambda domains: F.exists(F.array(*map(F.lit, domains)), lambda d: host_matches(host, d))
    rank = F.when(any_of(STRONG_HOSTS), 100).when(host == "", 0).otherwise(40)
    kept = first.where(~any_of(WEAK_HOSTS)).withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(rank), "at")))
    return kept.where(F.col("place") <= most).select("job_id", "place", "x.*")


def says_nothing(text: Column) -> Column:
    """Whether an answer is a stock phrase or points at something above; null and empty count."""
    low = F.lower(trim_all(text))
    return F.coalesce((low == "") | low.isin(STOCK) | reduce(lambda a, p: a | low.contains(p), POINTERS, F.lit(False)), F.lit(True))


def readable(raw: Column) -> Column:
    """A JSON value as people read it: text as it is, else its JSON, in one line; empty for null."""
    v = F.try_parse_json(raw)
    return F.coalesce(F.when(v.isNull(), raw).when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind_of(v) == "VOID", "").otherwise(F.to_json(v)), F.lit(""))


def job_answers(jobs: DataFrame, reports: DataFrame, runs: DataFrame, steps: DataFrame) -> DataFrame:
    """``job_id, answer, origin, sources``: what each job answered, from where, and its sources as JSON.

    ``jobs(job_id, error)``, ``reports(job_id, pos, content, metadata)``, ``runs(job_id, pos, final_output)``, ``steps(job_id, pos, step, result, stdout)`` of the run ``pos``;
    JSON as text. The first that says something: the Markdown of a research response, the first report, the last text that the first run with any printed,
    the first run's final text, the error. Sources: the response's citations, else its resources, the report's sources, the run's.
    """
    values = reports.select("job_id", F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("step"), F.lit(0).alias("part")).alias("turn"), F.col("metadata").alias("raw"))
    at = lambda step, part: F.struct(F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), step.cast("int").alias("step"), F.lit(part).alias("part")).alias("turn")
    values = values.unionAll(runs.select("job_id", at(F.lit(-1), 0), "final_output")).unionAll(steps.select("job_id", at(F.col("step"), 0), "result")).unionAll(steps.select("job_id", at(F.col("step"), 1), "stdout"))
    contract = find_contracts(values)
    report = reports.groupBy("job_id").agg(F.min_by(F.struct("content", "metadata"), "pos").alias("report"))
    run = runs.groupBy("job_id").agg(F.min_by("final_output", "pos").alias("final_output"))
    # steps as the run's output lists them
    listed = runs.select("job_id", "pos", F.posexplode(F.from_json(F.get_json_object("final_output", "$.steps"), "array<struct<stdout:string>>")).alias("i", "s")).select("job_id", "pos", "i", trim_all(F.col("s.stdout")).alias("t")).where("t != ''")
    printed = listed.groupBy("job_id").agg(F.min_by("t", F.struct("pos", -F.col("i"))).alias("printed"))
    j = jobs.join(contract, "job_id", "left").join(report, "job_id", "left").join(run, "job_id", "left").join(printed, "job_id", "left")
    said = trim_all(F.get_json_object("contract", "$.ui.answerMarkdown"))
    final = F.when(kind_of(F.try_variant_get(F.try_parse_json("final_output"), "$.final", "variant")) == "STRING", F.get_json_object("final_output", "$.final"))
    options = [("contract", F.when(~says_nothing(said), said)), ("report", F.when(~says_nothing(F.col("report.content")), F.col("report.content"))), ("stdout", F.col("printed")), ("final", F.when(~says_nothing(final) | (final == ""), final)), ("error", F.nullif("error", F.lit("")))]
    some = lambda c: F.when(F.coalesce(F.json_array_length(c) > 0, F.lit(False)), c)
    is_list = lambda c: F.when(F.json_array_length(c).isNotNull(), c)
    sources = F.coalesce(some(F.get_json_object("contract", "$.ui.citations")), some(F.get_json_object("contract", "$.ui.resources")), is_list(F.get_json_object("report.metadata", "$.sources")), is_list(F.get_json_object("final_output", "$.sources")), F.lit("[]"))
    return j.select("job_id", F.coalesce(*[x for _, x in options], F.lit("")).alias("answer"), F.coalesce(*[F.when(x.isNotNull(), n) for n, x in options], F.lit("none")).alias("origin"), sources.alias("sources"))


def report_rows(jobs: DataFrame, title: str = "Answer") -> tuple[DataFrame, DataFrame]:
    """Reports and assistant messages of finished ``jobs(job_id, project_id, conversation_id, answer, sources)``; a message only where there is a conversation."""
    metadata = F.to_json(F.struct(F.col("sources").alias("sources")))
    reports = jobs.select("job_id", "project_id", F.lit(title).alias("title"), F.col("answer").alias("content"), metadata.alias("metadata"))
    messages = jobs.where("conversation_id is not null").select("job_id", "project_id", "conversation_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), metadata.alias("metadata"))
    return reports, messages


def write_by_key(rows: DataFrame, folder: str, key: str = "job_id", parts: int = 64) -> None:
    """Write rows so that a second write of the same keys replaces the first: one row a key, however often a task or a job runs.

    Keys are dealt to ``parts`` folders by hash; only folders with new keys are read, joined with what they hold, and written anew (dynamic partition
    overwrite, through a table in the shared folder, as a folder can't be read while it is written).
    """
    spark = rows.sparkSession
    new = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    new = new.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in rows.columns]))).where("n = 1").drop("n")
    touched = [r[0] for r in new.select("part").distinct().collect()]  # at most ``parts``
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and touched:
        old = spark.read.schema(new.schema).parquet(folder).where(F.col("part").isin(touched))
        new = new.unionByName(old.join(new.select(key), key, "left_anti"))
    checkpointed(new).write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def newest_page(rows: DataFrame, time: str, key: str, most: int, after: tuple | None = None, oldest_first: bool = False) -> DataFrame:
    """A page of a list, newest first (or oldest first): the ``most`` rows that follow the cursor ``after``, the (time, key) of the page before.

    The cursor is a filter that reaches the scan, and the page a top-k of each partition: nothing is sorted as a whole.
    """
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        later = (F.col(time) > t) | ((F.col(time) == t) & (F.col(key) > k)) if oldest_first else (F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k))
        bound = F.col(time) >= t if oldest_first else F.col(time) <= t
        rows = rows.where(bound & later)
    order = [F.col(time).asc(), F.col(key).asc()] if oldest_first else [F.col(time).desc(), F.col(key).desc()]
    return rows.where(F.col(time).isNotNull()).orderBy(*order).limit(most)
