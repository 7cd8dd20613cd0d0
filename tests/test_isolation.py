"""Checks that run apart: failures while rows are read, cancelled checks, counts from the writing pass."""

import threading

import pytest
from pyspark.sql import functions as F

from session_records import asst, human, result
from sessionloom.operators import corpus
from sessionloom.plans import registry
from sessionloom.plans.registry import Context
from sessionloom.sources import transcripts


@pytest.fixture
def model(spark, write):
    for i in range(3):
        write(f"s{i}", [human("go"), asst("x", [(f"c{i}", "Read", {"file_path": f"/a{i}"})]), result(f"c{i}", "y" * 6000), human("and"), asst(f"done {i}")], mtime=1_700_000_000 + i)
    return transcripts.load(spark, f"{write.root}/projects/*/*.jsonl", store=True)


@pytest.fixture
def added():
    """Registers a check for one test."""
    names = []

    def add(name, run):
        registry.check(name, "context", "?")(run)
        names.append(name)

    yield add
    for n in names:
        del registry.REGISTRY[n]


def plain(ctx):
    return ctx.model.sessions.select("session", F.lit(True).alias("fired"), F.lit("s").alias("summary"), F.array(F.lit("r")).alias("specifics"), F.lit(2).alias("m"))


def test_errors_that_show_when_rows_are_read(spark, model, added):
    added("breaks_late", lambda ctx: plain(ctx).withColumn("m", F.raise_error(F.lit("gone wrong")).cast("int")))
    added("breaks_early", lambda ctx: ctx.model.sessions.select("nothing"))
    added("works", plain)
    found, rates = registry.run_apart(Context(model), names=["breaks_late", "works", "breaks_early", "dumps"])
    got = {(r["check"], r["fired"], r["error"] is not None) for r in found.collect()}
    assert got == {("breaks_late", False, True), ("breaks_early", False, True), ("works", True, False), ("dumps", True, False)} and found.count() == 12
    assert {tuple(r) for r in rates.collect()} == {("breaks_late", 3, 0, 3), ("breaks_early", 3, 0, 3), ("works", 3, 3, 0), ("dumps", 3, 3, 0)}


def test_each_check_runs_once(spark, model, added):
    runs = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    added("counts", lambda ctx: plain(ctx).mapInArrow(noted, "session string, fired boolean, summary string, specifics array<string>, m int"))
    out = corpus.sweep(model)
    assert {r["check"]: r["share"] for r in out["rates"].collect()}["counts"] == 1.0
    assert {(r["field"], r["median"]) for r in out["fields"].where("check = 'counts'").collect()} == {("m", 2.0)} and out["findings"].count() == 3 * len(registry.REGISTRY)
    assert runs.value == 3


def test_a_check_that_takes_too_long_is_cancelled(spark, model, added):
    def slow(batches):
        for b in batches:
            threading.Event().wait(60)
            yield b

    added("slow", lambda ctx: plain(ctx).mapInArrow(slow, "session string, fired boolean, summary string, specifics array<string>, m int"))
    added("works", plain)
    found, rates = registry.run_apart(Context(model), names=["slow", "works"], seconds=6)
    assert {r["check"]: (r["fired"], r["errors"]) for r in rates.collect()} == {"slow": (0, 3), "works": (3, 0)}
    assert all("cancelled" in r["error"].lower() for r in found.where("check = 'slow'").collect())


def test_findings_are_shown_as_they_are_kept(spark, model):
    shown = []
    out = corpus.sweep(model, observe=lambda findings: shown.append(findings.where("fired").count()))
    assert shown == [out["findings"].where("fired").count()] and shown[0] >= 3


def test_the_plan_of_a_sweep_reads_stored_tables(spark, model):
    """Findings are stored: the plans of rates and fields hold no check; and checks move no row by session."""
    out = corpus.sweep(model)
    assert "Join" not in out["rates"]._jdf.queryExecution().optimizedPlan().toString()
    assert out["fields"]._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2 + len(registry.REGISTRY)
    for name in ("batching", "failures", "dumps"):
        assert "Exchange hash" not in registry.findings(Context(model), name)._jdf.queryExecution().executedPlan().toString()
