"""Over many sessions: fork families, siblings, and base rates of every check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from sessionloom.functions import pytext as P
from sessionloom.operators.calls import in_order
from sessionloom.plans import registry
from sessionloom.plans.model import Model
from sessionloom.plans.registry import Context
from sessionloom.session import ensure_checkpoint_dir

FINGERPRINT_CALLS, SIBLINGS, PROBE_NEEDLE = 10, 12, "--help"
QUANTILES, ACCURACY = (0.5, 0.9), 10_000
#: values of a key that one task sorts, bins of a histogram, keys whose bounds may be broadcast
OPEN_VALUES, BINS, BROADCAST_KEYS = 1_000_000, 1024, 100_000


def fingerprints(model: Model) -> DataFrame:
    """Identity of each session's history: its start and its first calls. A fork shares both."""
    first = model.calls.withColumn("at", F.row_number().over(W.partitionBy("session").orderBy("call_no"))).where(F.col("at") <= FINGERPRINT_CALLS)
    # adapted tables have no parameters; there the key stands for them
    acted = F.when(F.col("params") == "{}", F.col("key")).otherwise(F.col("params"))
    seeds = first.groupBy("session").agg(F.array_join(in_order(F.concat("tool", F.lit(":"), F.hex(F.crc32(acted.cast("binary")))), F.col("at")), "|").alias("seed"))
    rows = model.sessions.join(seeds, "session", "left")
    started = F.left(F.coalesce("started", F.lit("")), F.lit(19)) if "started" in model.sessions.columns else F.lit("")
    return rows.select("session", F.concat(started, F.lit("|"), F.lower(F.hex(F.crc32(F.coalesce("seed", F.lit("")).cast("binary"))))).alias("fingerprint"))


def collapse_forks(model: Model) -> DataFrame:
    """(session, fingerprint) of the longest session of each family; those without steps drop out.

    Ties go to the newest file, then to the first path.
    """
    rows = model.sessions.where("n_steps > 0").join(fingerprints(model), "session")
    best = W.partitionBy("fingerprint").orderBy(F.col("n_calls").desc(), F.col("modified").desc(), "session")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("session", "fingerprint")


def needle_sessions(files: DataFrame, needle: str = PROBE_NEEDLE) -> DataFrame:
    """Sessions whose raw content holds the needle, newest first; content is read for this alone."""
    return files.where(F.contains("content", F.lit(needle))).select("session", "modified")


def siblings(model: Model, probing: DataFrame, limit: int = SIBLINGS) -> DataFrame:
    """(session, other): what each session is compared with.

    Per session: the newest ``limit`` of the other needle-bearing files, then one of each fork family,
    without its own family. Leaving out a session itself moves the cut by one file at most, so the
    newest ``limit + 1`` are all that any session needs; their number does not grow with the corpus.
    """
    newest = probing.select("session", "modified").orderBy(F.col("modified").desc(), "session").limit(limit + 1)
    known = newest.join(model.sessions.select("session", "n_steps", "n_calls"), "session").join(fingerprints(model), "session")
    place = F.row_number().over(W.orderBy(F.col("modified").desc(), "session"))  # limit + 1 rows
    pool = known.withColumn("place", place).select(F.col("session").alias("other"), F.col("fingerprint").alias("family"), "place", "n_steps", "n_calls")
    asking = fingerprints(model)
    pairs = asking.join(F.broadcast(pool), F.col("session") != F.col("other"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy("place"))).where(F.col("rank") <= limit)
    usable = ranked.where((F.col("n_steps") > 0) & (F.col("family") != F.col("fingerprint")))
    best = W.partitionBy("session", "family").orderBy(F.col("n_calls").desc(), "place")
    return usable.withColumn("best", F.row_number().over(best)).where("best = 1").select("session", "other")


def population(model: Model) -> tuple[DataFrame, DataFrame]:
    """Sessions that a sweep judges, and one row of counts of what it refused."""
    families = collapse_forks(model).join(model.sessions, "session")
    judged = families.where("n_turns > 0").select("session")
    counts = model.sessions.agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("n_steps") > 0).alias("with_responses"), F.count_if(F.col("n_steps") == 0).alias("no_responses"))
    kept = families.agg(F.count(F.lit(1)).alias("families"), F.count_if(F.col("n_turns") == 0).alias("no_human_turn"), F.count_if(F.col("truncated") & (F.col("n_turns") > 0)).alias("truncated"))
    both = counts.crossJoin(kept)  # two single rows
    return judged, both.withColumn("forks_collapsed", F.col("with_responses") - F.col("families")).withColumn("sessions", F.col("families") - F.col("no_human_turn"))


def base_rates(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per check: sessions, fired, share, errors. Per check and metric: its distribution.

    Percentiles are nearest-rank, and exact; no task gathers a metric's values of the whole corpus.
    """
    rates = findings.groupBy("check").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("fired").alias("fired"), P.share(F.count_if("fired"), F.count(F.lit(1))).alias("share"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
    return rates, distribution(findings.select("check", F.explode("metrics").alias("field", "value")), ["check", "field"])


def distribution(values: DataFrame, keys: list[str], value: str = "value", open_values: int = OPEN_VALUES) -> DataFrame:
    """n, nonzero, min, nearest-rank median and p90, and max of a value by keys; nulls are left out.

    Rows are read twice and never dealt out by key. A mergeable summary of each key's values
    (``percentile_approx``, whose rank is off by a stated share at most) says between which two values a
    rank lies; then values below are counted, and those between, each different one once, all summed
    before they leave their task. Where so many lie between that one task should not sort them, a
    histogram of their range is summed, and only the bin with the rank stays open, until it is small.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    rows = values.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("key"), F.col(value).alias("v"))
    margin = 4 / ACCURACY
    around = F.array(*[F.lit(q + side * margin) for q in QUANTILES for side in (-1, 1)])
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") != 0).alias("nonzero"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile_approx("v", around, ACCURACY).alias("near")
    )
    # where the margin is less than a few ranks, all values are few enough to be sorted
    few = F.col("n") < 2 * ACCURACY
    ranks = [
        F.struct(
            F.lit(i).alias("i"),
            F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))).alias("rank"),
            F.when(few, F.col("min")).otherwise(F.col("near")[2 * i]).alias("low"),
            F.when(few, F.col("max")).otherwise(F.col("near")[2 * i + 1]).alias("high"),
        )
        for i, q in enumerate(QUANTILES)
    ]
    bounds = groups.select("key", "n", "nonzero", "min", "max", F.array(*ranks).alias("ranks")).checkpoint()
    held = bounds.agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("n")).first()
    sides = bounds.select("key", "ranks")
    placed = rows.join(F.broadcast(sides) if held["keys"] <= BROADCAST_KEYS else sides, "key").select("key", "v", F.inline("ranks"))
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counted = placed.where("v <= high").groupBy("key", "i", "rank", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    most = 2 * margin * (held["n"] or 0)
    while most > open_values:
        counted = _narrowed(counted.checkpoint())
        most = counted.where("v IS NOT NULL").groupBy("key", "i").count().agg(F.max("count")).first()[0]
    upto = F.sum("c").over(W.partitionBy("key", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = counted.withColumn("upto", upto).where("upto > rank AND v IS NOT NULL").groupBy("key").agg(*[F.min(F.when(F.col("i") == i, F.col("v"))).alias(f"at{i}") for i in range(len(QUANTILES))])
    return bounds.join(found, "key").select("key.*", "n", "nonzero", "min", F.col("at0").alias("median"), F.col("at1").alias("p90"), "max")


def _narrowed(counted: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts of open values (those below are under null) with all but the bin of the rank closed.

    The range from the least to the greatest open value is cut in equal bins, and always in two parts at least.
    """
    open_ = counted.where("v IS NOT NULL")
    edges = open_.groupBy("key", "i").agg(F.min("v").cast("double").alias("least"), F.max("v").cast("double").alias("greatest"))
    part = F.when(F.col("v") >= F.col("greatest"), F.lit(bins)).otherwise(F.floor((F.col("v") - F.col("least")) / (F.col("greatest") - F.col("least")) * bins))
    binned = counted.join(F.broadcast(edges), ["key", "i"]).withColumn("bin", F.when(F.col("v").isNull(), F.lit(-1)).otherwise(F.least(part, F.lit(bins))).cast("int"))
    sums = binned.groupBy("key", "i", "rank", "bin").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(W.partitionBy("key", "i").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))  # as many rows as bins
    chosen = sums.withColumn("upto", upto).where("upto > rank").groupBy("key", "i").agg(F.min("bin").alias("chosen"))
    kept = binned.join(F.broadcast(chosen), ["key", "i"]).where("bin <= chosen")
    return kept.groupBy("key", "i", "rank", F.when(F.col("bin") == F.col("chosen"), F.col("v")).alias("v")).agg(F.sum("c").alias("c"))


def sweep(model: Model, probing: DataFrame | None = None, limit: int = 0, sibling_limit: int = SIBLINGS, width: int = 160, observe: Callable[[DataFrame], None] | None = None) -> dict[str, DataFrame]:
    """Every session through every check: ``files`` (one row), ``findings``, ``rates``, ``fields``.

    ``limit`` keeps the newest files only (0: all); siblings are always drawn from the whole corpus.
    What is judged is chosen and stored once, and so are the findings; all counts are made from these.
    ``observe`` is given the stored findings before anything is made of them.
    """
    ensure_checkpoint_dir(model.sessions.sparkSession)
    considered = model
    if limit:
        considered = model.only(model.sessions.orderBy(F.col("modified").desc(), "session").limit(limit))
    judged, files = population(considered)
    judged = judged.checkpoint()
    chosen = considered.only(judged).stored()
    near = siblings(model, probing, sibling_limit).join(judged, "session", "left_semi").checkpoint() if probing is not None and sibling_limit else None
    found, counts = registry.run_apart(Context(chosen, near, model), width)
    if observe is not None:
        observe(found)
    rates = counts.withColumn("share", P.share(F.col("fired"), F.greatest("sessions", F.lit(1))))
    fields = distribution(found.select("check", F.explode("metrics").alias("field", "value")), ["check", "field"])
    return {"files": files.withColumn("found", F.lit(model.sessions.count())), "findings": found, "rates": rates, "fields": fields}


def sweep_text(files: dict, rates: list, fields: list) -> str:
    lines = [f"{files['sessions']} sessions of {files['found']} files: {files['no_responses']} without responses, {files['forks_collapsed']} forks, {files['no_human_turn']} without a human turn, {files['truncated']} truncated"]
    for r in sorted(rates, key=lambda r: r["check"]):
        lines.append(f"{r['check']:<14} fired {r['fired']}/{r['sessions']} ({r['share']:.3f})" + (f"  errors {r['errors']}" if r["errors"] else ""))
        lines += [f"    {f['field']:<24} n {f['n']}  nonzero {f['nonzero']}  min {f['min']:g}  median {f['median']:g}  p90 {f['p90']:g}  max {f['max']:g}" for f in sorted(fields, key=lambda f: f["field"]) if f["check"] == r["check"]]
    return "\n".join(lines)
