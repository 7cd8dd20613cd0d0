"""A session's report: all findings with the facts, as one row and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionloom.operators import calls, excerpt, formats, turns  # noqa: F401  the checks register themselves
from sessionloom.operators.calls import in_order
from sessionloom.plans import registry
from sessionloom.plans.registry import DIMENSIONS, REGISTRY, Context


def report_order() -> list[str]:
    """Checks in the order of a report: by dimension, then as registered."""
    known = list(REGISTRY)
    rank = {d: i for i, d in enumerate(DIMENSIONS)}
    return sorted(known, key=lambda n: (rank.get(REGISTRY[n].dimension, 99), REGISTRY[n].dimension, known.index(n)))


def refused(model) -> DataFrame:
    """Sessions without a report, and why."""
    why = F.when(F.col("n_steps") == 0, "no responses in this transcript").when(F.col("n_turns") == 0, "no human turn in this transcript")
    return model.sessions.select("session", why.alias("reason")).where("reason IS NOT NULL")


def report(ctx: Context, width: int = 160) -> DataFrame:
    """One row for each session that is not refused: its facts and its findings in report order."""
    place = F.create_map(*[x for i, n in enumerate(report_order()) for x in (F.lit(n), F.lit(i))])
    found = registry.run(ctx, width)
    # a map cannot be sorted by, so metrics travel as their entries
    entry = F.struct("check", "fired", "line", F.map_entries("metrics").alias("metrics"), "specifics", "error")
    rows = found.groupBy("session").agg(in_order(entry, F.element_at(place, F.col("check"))).alias("findings"))
    good = ctx.model.sessions.where("n_steps > 0 AND n_turns > 0").select("session")
    return excerpt.stats(ctx.model).join(good, "session", "left_semi").join(rows, "session")


def text(row) -> str:
    """A report row for a reader: caveats that fired come first, rows of evidence under fired checks."""
    lines = [
        f"session {row['session'].rsplit('/', 1)[-1][:40]} | turns {row['turns']} responses {row['responses']} calls {row['calls']} | depth {row['depth_tokens']:,} tok{'  [PARTIAL]' if row['truncated'] else ''}",
        f"excerpt {row['digest_exchanges']}/{row['turns']} exchanges, {'middle cut' if row['digest_gapped'] else 'contiguous'} | model {row['model'] or 'unknown'}",
    ]
    found = row["findings"]
    first = [f for f in found if f["fired"] and REGISTRY[f["check"]].evidence == "caveat"]
    for f in [*first, *(f for f in found if f not in first)]:
        sign = "!" if f in first else "*" if f["fired"] else " "
        lines.append(f"{sign} {f['line']}")
        if f["fired"]:
            lines += [f"    - {r}" for r in f["specifics"]]
    fired = [f["check"] for f in found if f["fired"]]
    return "\n".join([*lines, "", f"fired: {', '.join(fired) or 'nothing'}"])
