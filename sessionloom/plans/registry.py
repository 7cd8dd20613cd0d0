"""The checks: each reads a model and gives one row of findings for each session.

A check's frame has ``session``, ``fired`` (boolean), ``summary`` (string), ``specifics``
(array<string>) and any numeric metrics; all metrics are picked up by the corpus sweep.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Timer
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, functions as F

from sessionloom.functions import pytext as P
from sessionloom.plans.model import Model
from sessionloom.session import ensure_checkpoint_dir

#: checks whose jobs run at a time
SIDE_BY_SIDE = 6

FINDINGS = "session string, check string, fired boolean, line string, metrics map<string,double>, specifics array<string>, error string"
FIXED = ("session", "fired", "summary", "specifics")
#: the order of a report's parts
DIMENSIONS = ("opportunity", "specification", "rot", "sycophancy", "context")


@dataclass(frozen=True)
class Context:
    """A model, and what the checks may compare it with: ``siblings`` (session, other) pairs."""

    model: Model
    siblings: DataFrame | None = None
    sibling_model: Model | None = None


@dataclass(frozen=True)
class Check:
    name: str
    dimension: str
    question: str
    evidence: str
    run: Callable[[Context], DataFrame]
    label: str
    discloses: str = ""
    unjudgeable: str = ""


REGISTRY: dict[str, Check] = {}


def check(name: str, dimension: str, question: str, evidence: str = "descriptive", label: str = "", discloses: str = "", unjudgeable: str = ""):
    def keep(run: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        REGISTRY[name] = Check(name, dimension, question, evidence, run, label or name, discloses, unjudgeable)
        return run

    return keep


def catalog() -> list[dict[str, str]]:
    return [{k: getattr(c, k) for k in ("name", "label", "dimension", "question", "evidence")} for c in REGISTRY.values()]


def metric_columns(frame: DataFrame) -> list[str]:
    """Numeric columns; booleans and nested values are not metrics."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in frame.dtypes if n not in FIXED and (t in numeric or t.startswith("decimal"))]


def findings(context: Context, name: str, width: int = 160) -> DataFrame:
    """A check's rows in the common shape; nulls (not measured) are left out of the metrics."""
    chk = REGISTRY[name]
    frame = chk.run(context)
    numbers = metric_columns(frame)
    metrics = F.create_map(*[x for n in numbers for x in (F.lit(n), F.col(n).cast("double"))]) if numbers else F.create_map().cast("map<string,double>")
    rows = context.model.sessions.select("session").join(frame, "session", "left")
    return rows.select(
        "session",
        F.lit(name).alias("check"),
        F.coalesce("fired", F.lit(False)).alias("fired"),
        P.check_line(F.lit(chk.label), F.col("summary")).alias("line"),
        F.map_filter(metrics, lambda k, v: v.isNotNull()).alias("metrics"),
        P.evidence_rows(F.coalesce("specifics", F.array().cast("array<string>")), width).alias("specifics"),
        F.lit(None).cast("string").alias("error"),
    )


def failed(context: Context, name: str, error: Exception) -> DataFrame:
    """A row for each session that says that a check could not be made."""
    kind = type(error).__name__
    return context.model.sessions.select(
        "session",
        F.lit(name).alias("check"),
        F.lit(False).alias("fired"),
        P.check_line(F.lit(REGISTRY[name].label), F.lit(f"check failed ({kind})")).alias("line"),
        F.create_map().cast("map<string,double>").alias("metrics"),
        F.array().cast("array<string>").alias("specifics"),
        F.lit(f"{kind}: {error}"[:500]).alias("error"),
    )


def run(context: Context, width: int = 160, names: list[str] | None = None) -> DataFrame:
    """Findings of all checks, as one plan; one that cannot be built gives error rows and breaks no other."""
    parts = []
    for name in names or list(REGISTRY):
        try:
            parts.append(findings(context, name, width))
        except Exception as error:  # a new check must not break the rest
            parts.append(failed(context, name, error))
    return reduce(DataFrame.unionByName, parts)


def run_apart(context: Context, width: int = 160, names: list[str] | None = None, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all checks, stored, and their rates: each check is a job of its own over the model, and
    these run side by side.

    A check that fails, also while rows are read, or that takes more than ``seconds`` and is cancelled by
    its tag, gives error rows; the others are run once and keep what they found. The rates (``check``,
    ``sessions``, ``fired``, ``errors``) are observed as findings are written, so nothing is read for them.
    """
    names = names or list(REGISTRY)
    spark = context.model.sessions.sparkSession
    sc, run_tag = spark.sparkContext, f"checks-{uuid4().hex}"
    ensure_checkpoint_dir(spark)

    def counted(part: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        stored = part.observe(seen, F.count(F.lit(1)).alias("sessions"), F.count_if("fired").alias("fired"), F.count_if(F.col("error").isNotNull()).alias("errors")).checkpoint()
        return stored, seen.get

    def one(name: str) -> tuple[DataFrame, dict]:
        sc.addJobTag(f"{run_tag}-{name}")
        late = Timer(seconds, sc.cancelJobsWithTag, [f"{run_tag}-{name}"]) if seconds else None
        try:
            if late:
                late.start()
            return counted(findings(context, name, width))
        except Exception as error:  # a new check must not break the rest
            if late:
                late.cancel()
            sc.clearJobTags()
            return counted(failed(context, name, error))
        finally:
            if late:
                late.cancel()
            sc.clearJobTags()

    with ThreadPoolExecutor(min(len(names), SIDE_BY_SIDE)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), names))
    rates = spark.createDataFrame([(n, int(seen["sessions"]), int(seen["fired"]), int(seen["errors"])) for n, (_, seen) in zip(names, done)], "check string, sessions long, fired long, errors long")
    return reduce(DataFrame.unionByName, [part for part, _ in done]), rates
