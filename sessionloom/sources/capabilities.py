"""Installed skills and settings, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from sessionloom.functions import pytext as P
from sessionloom.session import present

FRONT = r"(?s)\A---\s*\n(.*?)\n---"


def front_matter(text: F.Column, key: str) -> F.Column:
    """A scalar of a file's front matter; continued lines are joined by a space."""
    block = F.concat(F.regexp_extract(text, FRONT, 1), F.lit("\n"))
    value = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*(?:\n(?:[ \t].*)?)*?)(?=\n[A-Za-z_-]+:|\n\z)", 1)
    return P.words_joined(F.regexp_replace(value, r"\A\s*[>|]-?(?=\s|\z)", ""))


def skill_rows(files: DataFrame, kind: str, origin: str | None = None) -> DataFrame:
    """Skills of files (``path``, ``text``); plugins take their origin from the folder behind
    ``marketplaces`` or ``cache``."""
    named = F.coalesce(P.blank_to_null(front_matter(F.col("text"), "name")), F.element_at(F.split("path", "/"), -2))
    found = F.coalesce(P.blank_to_null(F.regexp_extract("path", r"/(?:marketplaces|cache)/([^/]+)/", 1)), F.lit("plugin"))
    return files.select(named.alias("name"), front_matter(F.col("text"), "description").alias("description"), F.lit(kind).alias("kind"), (F.lit(origin) if origin else found).alias("origin"), "path")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files of a glob, none if there are none."""
    found = spark.read.format("binaryFile").load(path) if present(spark, path) else spark.createDataFrame([], "path string, content binary")
    return found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def skills(spark: SparkSession, path: str, kind: str, origin: str | None = None) -> DataFrame:
    """The skills of a glob of ``*/SKILL.md``."""
    return skill_rows(text_files(spark, path), kind, origin)


def installed(parts: list[DataFrame]) -> DataFrame:
    """All skills, one for each (origin, name): that of the first part, then of the first path."""
    out = None
    for at, part in enumerate(parts):
        part = part.withColumn("at", F.lit(at))
        out = part if out is None else out.unionByName(part)
    first = W.partitionBy("origin", "name").orderBy("at", "path")
    return out.withColumn("rank", F.row_number().over(first)).where("rank = 1 AND name <> ''").drop("rank", "at").orderBy("kind", "origin", "name")


def settings_rows(files: DataFrame, finder: str = "plugin-finder") -> DataFrame:
    """For each file (``path``, ``text``) its enabled plugins and known marketplaces, sorted, and whether
    one is a finder; a file that cannot be read has none."""
    raw = files.select("path", F.try_parse_json("text").alias("v"))
    on = F.map_filter(F.expr("try_variant_get(v, '$.enabledPlugins', 'map<string,variant>')"), lambda k, v: ~F.coalesce(F.call_function("try_variant_get", v, F.lit("$"), F.lit("string")), F.lit("")).isin("", "false", "0", "[]", "{}"))
    empty = F.array().cast("array<string>")
    plugins = F.coalesce(F.array_sort(F.map_keys(on)), empty)
    markets = F.coalesce(F.array_sort(F.map_keys(F.expr("try_variant_get(v, '$.extraKnownMarketplaces', 'map<string,variant>')"))), empty)
    return raw.select("path", plugins.alias("plugins"), markets.alias("marketplaces"), F.exists(plugins, lambda p: F.contains(p, F.lit(finder))).alias("finder"))


def settings(spark: SparkSession, path: str, finder: str = "plugin-finder") -> DataFrame:
    return settings_rows(text_files(spark, path), finder).drop("path")


def summary(spark: SparkSession, home: str, folder: str | None = None) -> dict:
    """Skills and settings of a home folder, and of a working folder's project, for a report."""
    parts = [skills(spark, f"{home}/skills/*/SKILL.md", "user-skill", "user")]
    if folder:
        parts.append(skills(spark, f"{folder}/.claude/skills/*/SKILL.md", "project-skill", "project"))
    # one, two or three folders deep: a marketplace, a plugin, its version
    parts += [skills(spark, f"{home}/plugins/{deep}/skills/*/SKILL.md", "plugin-skill") for deep in ("*", "*/*", "*/*/*", "*/*/*/*")]
    found = [r.asDict() for r in installed(parts).select("name", "kind", "origin", "description").collect()]
    on = settings(spark, f"{home}/settings.json").first()
    known = {"plugins": on["plugins"], "marketplaces": on["marketplaces"], "plugin_finder": on["finder"]} if on else {"plugins": [], "marketplaces": [], "plugin_finder": False}
    return {"capabilities": found, "count": len(found)} | known
