"""Repositories as tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import trim_all

# What a path or a package file says about a repository's stack.
STACK_FOLDERS = [("apps/web/", "Next.js/web app"), ("apps/api/", "API service"), ("apps/worker/", "background worker"), ("apps/model-service/", "Python model service"), ("apps/rlm-runtime/", "RLM runtime"), ("packages/", "monorepo packages")]
STACK_FILES = [(["docker-compose.yml", "docker-compose.yaml"], "Docker Compose"), (["prisma/schema.prisma"], "Prisma/Postgres")]
STACK_PACKAGES = [("bullmq", "BullMQ/Redis"), ("fastify", "Fastify"), ("qdrant", "Qdrant/vector retrieval")]


def parse_repo_ref(ref: Column) -> Column:
    """``struct<owner, repo>`` of a repository's address or ``owner/repo``; null for anything else."""
    s = trim_all(ref)
    url, short = r"^(?i)https?://github\.com/([^/\s]+)/([^/\s?#]+)(?:[/?#].*)?\z", r"^([^/\s]+)/([^/\s]+)\z"
    name = lambda p: F.struct(F.regexp_extract(s, p, 1).alias("owner"), F.regexp_replace(F.regexp_extract(s, p, 2), r"(?i)\.git\z", "").alias("repo"))
    return F.when(s.rlike(url), name(url)).when(s.rlike(short), name(short))


def repo_path_rank(path: Column) -> Column:
    x = F.lower(path)
    return (
        F.when(x == "readme.md", 1000)
        .when(x == "package.json", 950)
        .when(x.isin("docker-compose.yml", "docker-compose.yaml"), 930)
        .when(x == "prisma/schema.prisma", 920)
        .when(x.endswith("/package.json"), 880)
        .when(x.endswith("dockerfile"), 820)
        .when(x.startswith("docs/"), 760)
        .when(x.rlike(r"^(apps|packages)/") & x.rlike(r"(main|server|router|service|schema|client|index)\.(ts|tsx|js|py)\z"), 720)
        .when(x.contains("__tests__") | x.endswith(".test.ts") | x.endswith(".spec.ts"), 500)
        .when(x.rlike(r"\.(ts|tsx|js|py|md|prisma|yml|yaml|json)\z"), 200)
        .otherwise(0)
    )


def select_repo_files(files: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` best files of each repository ``(repo, path)``, by rank, then path."""
    r = files.withColumn("rank", repo_path_rank(F.col("path"))).where("rank > 0")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("rank"), "path"))).where(F.col("place") <= most)


def repo_stack(files: DataFrame) -> DataFrame:
    """``repo, stack`` from ``files(repo, path, text)``, in a fixed order."""
    any_ = lambda hit, name: F.when(F.coalesce(F.bool_or(hit), F.lit(False)), name)
    package = F.lower("path").endswith("package.json")
    found = [any_(F.col("path").startswith(p), n) for p, n in STACK_FOLDERS] + [any_(F.col("path").isin(p), n) for p, n in STACK_FILES] + [any_(package & F.col("text").contains(p), n) for p, n in STACK_PACKAGES]
    return files.groupBy("repo").agg(F.array_compact(F.array(*found)).alias("stack"))


def clip(text: Column, most: Column | int) -> Column:
    t = trim_all(F.regexp_replace(text, "\r\n", "\n"))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, F.lit(1), F.lit(most) if isinstance(most, int) else most), F.lit("\n...[truncated]")))


def summarize_repos(files: DataFrame, most: int = 30) -> DataFrame:
    """``repo, files, selected, stack, markdown`` of ``files(repo, path, text)``: the stack, key files, top folders and first lines of a repository.

    At most ``most`` files of a repository are looked into, each clipped, so its summary is one row of bounded size.
    """
    picked = select_repo_files(files, most).withColumn("text", clip(F.coalesce("text", F.lit("")), F.when(F.lower("path").endswith(".json"), 2200).otherwise(3500)))
    said = F.filter(F.transform(F.split("text", "\n"), trim_all), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    note = F.array_join(F.slice(said, 1, 3), " ")
    line = F.concat(F.lit("- `"), "path", F.lit("`"))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("place", x.alias("t")))), lambda s: s.t)
    g = picked.groupBy("repo").agg(
        F.count("*").alias("selected"), in_order(line).alias("lines"), in_order(F.split("path", "/")[0]).alias("tops"),
        in_order(F.when(trim_all(F.col("text")) != "", F.concat(line, F.lit(": "), F.when(note != "", note).otherwise("File inspected.")))).alias("notes"),
    )
    g = g.join(files.groupBy("repo").agg(F.count("*").alias("files")), "repo").join(repo_stack(files), "repo")
    parts = F.when(F.size("stack") > 0, F.concat(F.lit("Detected stack/components: "), F.array_join("stack", ", "), F.lit("."))).otherwise("Detected stack/components were not obvious from selected files.")
    listed = lambda c, n: F.array_join(F.slice(c, 1, n), "\n")
    tops = F.transform(F.array_distinct("tops"), lambda t: F.concat(F.lit("- `"), t, F.lit("`")))
    markdown = F.concat_ws(
        "\n", F.concat(F.lit("# "), "repo"), F.lit(""), F.lit("## What this repository appears to contain"), F.lit(""), parts, F.lit(""), F.lit("## Key files inspected"), F.lit(""), listed("lines", 20),
        F.lit(""), F.lit("## High-level structure"), F.lit(""), listed(tops, 12), F.lit(""), F.lit("## Notes from selected files"), F.lit(""), listed("notes", 8),
    )
    return g.select("repo", "files", "selected", "stack", markdown.alias("markdown"))
