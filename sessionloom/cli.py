"""Command line: reports, sweeps, census, verdicts and calibration over a corpus of session logs."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from sessionloom.operators import calibrate, corpus, excerpt, formats, verdict
from sessionloom.plans import registry, report
from sessionloom.plans.registry import Context
from sessionloom.session import open_session
from sessionloom.sources import capabilities, transcripts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sessionloom", description=__doc__)
    p.add_argument("root", nargs="?", help="folder with projects/*/*.jsonl, or a single .jsonl file")
    p.add_argument("--cwd", help="only this working folder's project")
    p.add_argument("--master", help="Spark's master, where the environment names none (local[*])")
    p.add_argument("--home", help="folder with skills, plugins and settings.json, if it is not the root")
    p.add_argument("--session", help="a session by its file's stem; unknown ones fall back to the newest")
    p.add_argument("--siblings", type=int, default=corpus.SIBLINGS)
    p.add_argument("--text", action="store_true", help="text in place of JSON")
    p.add_argument("--emit", metavar="DIR", help="write digest.txt and candidates.txt")
    p.add_argument("--catalog", action="store_true")
    p.add_argument("--sweep", action="store_true")
    p.add_argument("--limit", type=int, default=0, help="newest files of a sweep")
    p.add_argument("--census", action="store_true")
    p.add_argument("--verdict", metavar="FILE", help="check a reviewer's reply (- for standard input)")
    p.add_argument("--against", metavar="DIR", help="folder that --emit wrote")
    p.add_argument("--calibrate", action="store_true")
    p.add_argument("--calibrate-merge", nargs="+", metavar="FILE")
    return p


def evidence(path: str | None) -> tuple[str | None, list[str]]:
    """The texts that a reviewer was shown, and what is wrong with the place they should be in."""
    if not path:
        return None, []
    place = Path(path)
    parts = [place] if place.is_file() else [p for n in ("digest.txt", "candidates.txt") if (p := place / n).is_file()]
    if not parts:
        return None, [f"quotations are not checked: {'no digest.txt or candidates.txt in' if place.is_dir() else 'there is no'} {path}"]
    return "\n".join(p.read_text(errors="replace") for p in parts), []


def judge(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        raw, notes = sys.stdin.read() if a.verdict == "-" else Path(a.verdict).read_text(errors="replace"), []
    except OSError as error:
        raw, notes = "", [f"the reply cannot be read: {error.strerror}"]
    shown, wrong = evidence(a.against)
    row = verdict.validate(spark.createDataFrame([("reply", raw, shown)], "reply_id string, raw string, excerpt string"))
    found = row.withColumn("retry", verdict.retry_hint(F.col("problems"), F.col("status"))).first().asDict(recursive=True)
    found["warnings"] = [*notes, *wrong, *found["warnings"]]
    print(verdict.text(found) if a.text else json.dumps(found, indent=1))
    return verdict.EXIT[found["status"]]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.catalog:
        print(json.dumps(registry.catalog(), indent=1) if not a.text else "\n".join(f"{c['label']:<12}{c['evidence']:<12}{c['question']}" for c in registry.catalog()))
        return 0
    spark = open_session(a.master)
    if a.verdict:
        return judge(spark, a)
    if a.calibrate_merge:
        files, missing = calibrate.returned(spark, a.calibrate_merge)
        merged = {k: v.collect() for k, v in calibrate.merge(files).items()}
        builds = [r["build"] for r in merged["builds"]]
        warnings = [f"nothing to read: {p}" for p in missing]
        print(calibrate.merge_text(merged["checks"], builds, merged["files"], merged["shares"], warnings))
        return 0
    if not a.root:
        parser().error("a folder or file is needed")
    single = a.root.endswith(".jsonl")
    path = a.root if single else f"{a.root}/projects/*/*.jsonl"
    if not (a.census or a.sweep or a.calibrate):
        return report_one(spark, a, single, path)
    model = transcripts.parse(transcripts.read_files(spark, path, empty=single), store=True)
    if a.census:
        rows = formats.census(model.record_types).collect()
        print(formats.census_text(rows))
        return int(formats.disagrees(rows))
    probing = transcripts.with_needle(spark, path, corpus.PROBE_NEEDLE)
    out = corpus.sweep(model, probing, a.limit, a.siblings, calibrate.WIDTH if a.calibrate else 160)
    files_row, rates, fields = out["files"].first().asDict(), out["rates"].collect(), out["fields"].collect()
    if a.calibrate:
        rows = calibrate.select(out["findings"], model.sessions).collect()
        print(calibrate.file_text(rows, {"sessions": files_row["sessions"], "checks": {r["check"]: {"share": r["share"]} for r in rates}}))
    else:
        print(corpus.sweep_text(files_row, rates, fields) if a.text else json.dumps({"files": files_row, "rates": [r.asDict() for r in rates], "fields": [r.asDict() for r in fields]}, indent=1))
    return 0


def report_one(spark: SparkSession, a: argparse.Namespace, single: bool, path: str) -> int:
    """The report of one session. The files' names, ages and sizes say which it is; it is parsed, and the newest
    files that may hold siblings, and no others."""
    if single:
        chosen = [a.root if "://" in a.root else str(Path(a.root).absolute())]
    else:
        listed = transcripts.listing(spark, a.root)
        if a.cwd:
            listed = transcripts.of_folder(listed, a.cwd)
        chosen = [r["path"] for r in transcripts.current(listed, a.session).select("path").collect()]  # one row
    probing = transcripts.newest_with_needle(spark, path, corpus.PROBE_NEEDLE, a.siblings + 1) if a.siblings else None
    near = [r["session"] for r in probing.collect()] if probing is not None else []  # so many rows at most
    wanted = list({transcripts.plain_path(p): p for p in [*near, *chosen]}.values())
    files = transcripts.read_files(spark, wanted if wanted else path, empty=single)
    model = transcripts.parse(files if wanted else files.limit(0), store=True)
    row = why = None
    if chosen:
        mine = model.sessions.where(F.col("path").endswith(transcripts.plain_path(chosen[0]))).select("session")
        one = model.only(mine).stored()
        pairs = corpus.siblings(model, probing, a.siblings).join(mine, "session", "left_semi") if probing is not None else None
        row = report.report(Context(one, pairs, model)).first()
        why = None if row else report.refused(one).first()
    if row is None:
        print(json.dumps({"error": why["reason"] if why else "no transcript found", "hint": "pass --session <stem> for another one"}))
        return 1
    if a.emit:
        Path(a.emit).mkdir(parents=True, exist_ok=True)
        Path(a.emit, "digest.txt").write_text(excerpt.build(one).first()["excerpt"])
        found = excerpt.candidates_text(one).first()
        Path(a.emit, "candidates.txt").write_text(found["candidates"] if found else "")
    skills = capabilities.summary(spark, a.home or (str(Path(a.root).absolute().parents[2]) if single else a.root), a.cwd)
    if a.text:
        finder = "with" if skills["plugin_finder"] else "without"
        print(f"{report.text(row)}\nskills: {skills['count']} installed, {finder} a plugin finder; the JSON names them")
    else:
        print(json.dumps(row.asDict(recursive=True) | {"capabilities": skills}, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
