"""Calibration: a file of findings for a person to mark, and the rates from returned files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from sessionloom import __version__
from sessionloom.functions import pytext as P
from sessionloom.plans.registry import REGISTRY
from sessionloom.session import present

ROWS, SECONDS_PER_ROW, WIDTH, SHOWN, PROJECT_WIDTH = 40, 15, 240, 3, 24
JUDGEABLE = ("proof", "evidenced")
READ_ALL = "read_all"
DATA_MARK = "--- data, do not edit below this line ---"
SCHEMA = "session-calibration-1"
#: fixed values: what people write into a box
MARKS = {
    "ok": ["o", "ok", "y", "yes", "right", "correct", "✓", "v"],
    "bogus": ["b", "bogus", "n", "no", "wrong", "bad", "fp"],
    "unsure": ["?", "??", "u", "unsure", "dunno", "idk", "-"],
}
AFFIRM = ["x", "✓", "y", "yes", "o", "ok", "done", "v"]
ROW = r"(?U)\A\s*\[([^\]]*)\]\s+([A-Za-z_][A-Za-z0-9_]*)\s*(.*)\z"


def mark(raw: Column) -> Column:
    m = F.lower(P.strip(raw))
    out = F.when(m == "", "blank")
    for name, words in MARKS.items():
        out = out.when(m.isin(words), name)
    return out.otherwise("unclear")


def project_name(path: Column) -> Column:
    """The session's folder, kept from the right."""
    name = F.coalesce(P.blank_to_null(F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^-+", "")), F.lit("?"))
    return F.when(F.length(name) <= PROJECT_WIDTH, name).otherwise(F.concat(F.lit("…"), F.right(name, F.lit(PROJECT_WIDTH - 1))))


def round_robin(rows: DataFrame, group: str, order: list[Column], cap: int = ROWS) -> DataFrame:
    """At most ``cap`` rows, one from each group in turn; ``depth`` is the turn, from 0.

    Only the first ``cap`` rows of a group can be chosen, so that is all that is ever sorted together.
    """
    ranked = rows.withColumn("depth", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1).where(F.col("depth") < cap)
    return ranked.orderBy("depth", group).limit(cap)


def judgeable_rows(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """The evidence rows of fired checks that a person can rule on, newest sessions first."""
    names = [n for n, c in REGISTRY.items() if c.evidence in JUDGEABLE and not c.unjudgeable]
    fired = findings.where(F.col("fired") & F.col("check").isin(names)).join(sessions.select("session", "path", "modified", "started"), "session")
    rows = fired.select("session", "path", "modified", "started", "check", F.posexplode(F.slice("specifics", 1, SHOWN)).alias("at", "text"))
    return rows.withColumn("project", project_name(F.col("path"))).withColumn("date", F.left("started", F.lit(10)))


def select(findings: DataFrame, sessions: DataFrame, cap: int = ROWS) -> DataFrame:
    return round_robin(judgeable_rows(findings, sessions), "check", [F.col("modified").desc(), F.col("session"), F.col("at")], cap)


def allowed_strings() -> set[str]:
    """What an aggregate may say in words: the constants of the registered checks."""
    return {x for c in REGISTRY.values() for x in (c.name, c.label, c.dimension, c.evidence)}


def checked(aggregate: dict) -> dict:
    """The aggregate, if none of its strings comes from a session: its keys are field names of this
    module and names of checks, its other strings constants of checks."""
    allowed, fields = allowed_strings(), {"sessions", "checks", "share"}

    def look(value: object) -> None:
        if isinstance(value, str) and value not in allowed:
            raise ValueError("an aggregate may not carry text of a session")
        if isinstance(value, dict):
            if not set(value) <= allowed | fields:
                raise ValueError("an aggregate may not have names of its own")
            for x in value.values():
                look(x)
        if isinstance(value, list):
            for x in value:
                look(x)

    look(aggregate)
    return aggregate


def file_text(rows: list, aggregate: dict, version: str | None = __version__) -> str:
    """The file that goes out: instructions, rows with empty boxes, and the aggregate for machines."""
    minutes = max(1, round(len(rows) * SECONDS_PER_ROW / 60))
    told = sorted({REGISTRY[r["check"]].discloses for r in rows if REGISTRY[r["check"]].discloses})
    lines = [
        f"{len(rows)} findings, about {minutes} minutes. Mark each box: o = right, b = bogus, ? = unsure; leave it blank if right.",
        *[f"rows disclose {x}" for x in told],
        f"[ ] {READ_ALL}  tick this once every row has been read; without it, blanks count as unjudged",
        "",
        *[f"[ ] {r['check']}  {r['date']} {r['project']}  {r['text']}" for r in rows],
        "",
        DATA_MARK,
        json.dumps({"schema": SCHEMA, "version": version, "aggregate": checked(aggregate)}, sort_keys=True),
    ]
    return "\n".join(lines) + "\n"


def returned(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(name, text) of returned files, and the paths under which there is nothing to read."""
    there = [p for p in paths if present(spark, p)]
    if not there:
        return spark.createDataFrame([], "name string, text string"), list(paths)
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(there)
    return read.select(F.col("path").alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")), [p for p in paths if p not in there]


def parse(files: DataFrame) -> DataFrame:
    """Rows (name, check, raw, mark, text) of returned files; the ``read_all`` line is not a row."""
    lines = files.select("name", F.posexplode(F.split("text", r"\R", -1)).alias("line", "row")).where(F.col("row").rlike(ROW))
    return lines.select(
        "name", "line", F.regexp_extract("row", ROW, 2).alias("check"), P.strip(F.regexp_extract("row", ROW, 1)).alias("raw"), mark(F.regexp_extract("row", ROW, 1)).alias("mark"), P.strip(F.regexp_extract("row", ROW, 3)).alias("text")
    )


def file_facts(files: DataFrame) -> DataFrame:
    """(name, read_all, version, aggregate) of returned files; a broken data block is null."""
    affirmed = F.lower(F.col("raw")).isin(AFFIRM)
    ticks = parse(files).where(F.col("check") == READ_ALL).groupBy("name").agg(F.max_by(affirmed, "line").alias("read_all"))
    block = F.try_parse_json(F.regexp_extract("text", rf"(?s)\Q{DATA_MARK}\E\s*([^\n]*)", 1))
    facts = files.select("name", F.contains("text", F.lit(DATA_MARK)).alias("has_block"), block.alias("block"))
    return facts.join(ticks, "name", "left").na.fill(False, ["read_all"]).select(
        "name",
        "read_all",
        F.expr("try_variant_get(block, '$.version', 'string')").alias("version"),
        F.expr("try_variant_get(block, '$.aggregate', 'variant')").alias("aggregate"),
        "has_block",
        (F.col("has_block") & F.col("block").isNull()).alias("broken"),
    )


def tally(rows: DataFrame, by: list[str]) -> DataFrame:
    """Marks counted by the keys; ``rows`` has ``mark`` and ``read_all``. Blanks are right only where
    the reader said that all rows were read. Rates are null where nothing was judged."""
    final = F.when(F.col("mark") == "blank", F.when(F.col("read_all"), "ok").otherwise("unjudged")).otherwise(F.col("mark"))
    marks = ["ok", "bogus", "unsure", "unclear", "unjudged"]
    out = rows.withColumn("final", final).groupBy(*by).agg(*[F.count_if(F.col("final") == m).alias(m) for m in marks])
    judged = F.col("ok") + F.col("bogus")
    return out.withColumn("judged", judged).withColumn("fp_rate", F.when(judged > 0, P.share(F.col("bogus"), judged)))


def merge(files: DataFrame) -> dict[str, DataFrame]:
    """Returned files as tallies per check and per file, each check's share of fired sessions in every
    file's corpus, and the builds that made the files."""
    facts = file_facts(files)
    rows = parse(files).where(F.col("check") != READ_ALL).join(facts.select("name", "read_all"), "name")
    count = rows.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    sessions = F.expr("try_variant_get(aggregate, '$.sessions', 'bigint')").alias("sessions")
    per_file = facts.select("name", "read_all", "version", "broken", sessions).join(count, "name", "left").join(tally(rows, ["name"]), "name", "left").na.fill(0)
    fired = facts.select("name", F.explode(F.expr("try_variant_get(aggregate, '$.checks', 'map<string,variant>')")).alias("check", "v"))
    shares = fired.select("name", "check", F.call_function("try_variant_get", "v", F.lit("$.share"), F.lit("double")).alias("share")).where("share IS NOT NULL")
    builds = facts.select(F.coalesce("version", F.lit("unknown")).alias("build")).distinct()
    return {"checks": tally(rows, ["check"]), "files": per_file, "shares": shares, "builds": builds}


def merge_text(checks: list, builds: list[str], files: list = (), shares: list = (), warnings: list[str] = ()) -> str:
    """All that a merge found, a part for the files and one for the checks, and how to read the rates."""
    head = f"{'rows':>6}{'ok':>6}{'bogus':>7}{'unsure':>8}{'unclear':>9}{'unjudged':>10}"
    lines = [f"{len(files)} files, {sum(f['rows'] for f in files)} rows, built by {', '.join(sorted(builds)) or 'unknown'}", "", f"{'file':<28}{'build':>9}{'read':>6}{'sessions':>10}{head}"]
    for f in sorted(files, key=lambda f: f["name"]):
        numbers = f"{f['rows']:>6}{f['ok']:>6}{f['bogus']:>7}{f['unsure']:>8}{f['unclear']:>9}{f['unjudged']:>10}"
        lines.append(f"{f['name'].rsplit('/', 1)[-1][:27]:<28}{f['version'] or 'unknown':>9}{'all' if f['read_all'] else '':>6}{f['sessions'] or '?':>10}{numbers}")
    lines += ["", f"{'check':<16}{'ok':>6}{'bogus':>7}{'unsure':>8}{'unclear':>9}{'unjudged':>10}{'bogus share':>13}  fired, by corpus"]
    for r in sorted(checks, key=lambda r: r["check"]):
        rate = "none judged" if r["fp_rate"] is None else f"{r['fp_rate']:.3f}"
        fired = ", ".join(f"{x['share']:.0%}" for x in sorted(shares, key=lambda x: x["name"]) if x["check"] == r["check"]) or "-"
        lines.append(f"{r['check']:<16}{r['ok']:>6}{r['bogus']:>7}{r['unsure']:>8}{r['unclear']:>9}{r['unjudged']:>10}{rate:>13}  {fired}")
    missing = [n for n, c in REGISTRY.items() if c.unjudgeable]
    lines += [f"{n:<16}not asked about: {REGISTRY[n].unjudgeable}" for n in sorted(missing)]
    lines += ["", "A blank counts as right where all rows were read, and a row that was skimmed is blank too:", "the share of bogus rows is a lower bound. Unsure and unclear rows are in no rate, and shares of", "fired sessions stand side by side, as corpora are not alike."]
    if len(builds) > 1:
        lines.append(f"! the files span {len(builds)} builds ({', '.join(sorted(builds))}): a rate over all of them assumes that all counted alike")
    lines += [f"! {f['name'].rsplit('/', 1)[-1]}: its data cannot be read" for f in files if f["broken"]]
    return "\n".join([*lines, *(f"! {w}" for w in warnings)])
