"""Calibration files, capabilities, streaming, the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from session_records import asst, human, result, rows
from pyspark.sql import functions as F

from sessionloom import cli
from sessionloom.operators import calibrate, corpus
from sessionloom.plans import registry
from sessionloom.sources import capabilities, transcripts
from sessionloom.streaming import live


def test_calibration_round_trip(spark, tmp_path):
    found = [{"check": "rereads", "date": "2024-05-01", "project": "a", "text": f"row {i}"} for i in range(3)]
    out = calibrate.file_text(found, {"sessions": 4, "checks": {"rereads": {"share": 0.25}}}, "1.0")
    lines = out.splitlines()
    marked = [line.replace("[ ]", "[x]", 1) if "read_all" in line else line for line in lines]
    marked = [m.replace("[ ]", "[b]", 1) if m.endswith("row 1") else m for m in marked]
    (tmp_path / "a.txt").write_text("\n".join(marked))
    (tmp_path / "b.txt").write_text(out.replace('"1.0"', '"2.0"'))
    (tmp_path / "c.txt").write_text("[q] rereads x\n[?] spill y\n")
    files, missing = calibrate.returned(spark, [f"{tmp_path}/{n}.txt" for n in "abcd"])
    assert missing == [f"{tmp_path}/d.txt"]
    merged = calibrate.merge(files)
    by = {r["check"]: r for r in rows(merged["checks"])}
    assert (by["rereads"]["ok"], by["rereads"]["bogus"], by["rereads"]["unjudged"], by["rereads"]["unclear"]) == (2, 1, 3, 1)
    assert by["rereads"]["fp_rate"] == 0.333 and by["spill"]["unsure"] == 1 and by["spill"]["fp_rate"] is None
    assert {r["build"] for r in rows(merged["builds"])} == {"1.0", "2.0", "unknown"}
    text = calibrate.merge_text(*[merged[k].collect() if k != "builds" else ["1.0", "2.0", "unknown"] for k in ("checks", "builds", "files", "shares")], ["gone"])
    assert "span 3 builds" in text and "a.txt" in text and "3 files, 8 rows" in text and "! gone" in text and "25%, 25%" in text
    assert calibrate.returned(spark, ["/nowhere/x"])[0].count() == 0


def test_aggregates_carry_no_text_of_sessions():
    good = {"sessions": 4, "checks": {"rereads": {"share": 0.25}}}
    assert calibrate.checked(good) is good
    for bad in ({"sessions": "secret/path"}, {"checks": {"/secret": {"share": 1}}}, {"checks": {"rereads": {"share": ["why"]}}}):
        with pytest.raises(ValueError):
            calibrate.checked(bad)


def test_round_robin_covers_every_check(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 1), ("c", 2)], "g string, i int")
    got = rows(calibrate.round_robin(df, "g", [F.col("i")], 6))
    assert sorted((r["g"], r["i"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2)]


def test_capabilities(spark, tmp_path):
    def skill(path, text):
        p = tmp_path / path / "SKILL.md"
        p.parent.mkdir(parents=True)
        p.write_text(text)

    skill("skills/one", "---\nname: first\ndescription: >\n  does a\n  and b\nother: x\n---\nbody")
    skill("skills/two", "no front matter")
    skill("plugins/marketplaces/shop/p/skills/one", "---\nname: first\ndescription: plain\n---")
    user = capabilities.skills(spark, f"{tmp_path}/skills/*/SKILL.md", "user-skill", "user")
    plugin = capabilities.skills(spark, f"{tmp_path}/plugins/marketplaces/*/*/skills/*/SKILL.md", "plugin-skill")
    got = rows(capabilities.installed([user, user, plugin]))
    assert [(r["kind"], r["origin"], r["name"], r["description"]) for r in got] == [
        ("plugin-skill", "shop", "first", "plain"),
        ("user-skill", "user", "first", "does a and b"),
        ("user-skill", "user", "two", ""),
    ]
    (tmp_path / "settings.json").write_text(json.dumps({"enabledPlugins": {"b@x": True, "a-plugin-finder@x": 1, "c": False}, "extraKnownMarketplaces": {"m": {}}}))
    s = capabilities.settings(spark, f"{tmp_path}/settings.json").first()
    assert (s["plugins"], s["marketplaces"], s["finder"]) == (["a-plugin-finder@x", "b@x"], ["m"], True)


def test_streams(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = live.windowed_rates(stream).writeStream.outputMode("append").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert 0 < spark.table("rates").count() <= batch.count()
    q = live.closed_sessions(stream).writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    watermark = events.selectExpr("string(max(ts) - interval 2 hours)").first()[0]
    batch = live.closed_sessions(events)
    closed = batch.where(F.col("end") < F.lit(watermark).cast("timestamp"))
    got = set(map(str, spark.table("live").collect()))
    assert set() < got <= set(map(str, closed.collect()))  # no open session, and none that a batch would not have


def test_command_line(spark, write, tmp_path, capsys):
    write("s", [human("go"), asst("x", [("a", "Read", {"file_path": "/a"})]), result("a", "y" * 9000)])
    assert cli.main([write.root, "--text", "--emit", str(tmp_path / "out")]) == 0
    assert "fired: dumps" in capsys.readouterr().out and (tmp_path / "out" / "digest.txt").read_text().startswith("### Exchange 1")
    assert cli.main([write.root, "--census"]) == 1  # declared kinds that no file has
    (tmp_path / "reply.txt").write_text("no")
    assert cli.main(["--verdict", str(tmp_path / "reply.txt"), "--against", str(tmp_path / "out")]) == 2
    assert cli.main(["--catalog", "--text"]) == 0
    assert len(registry.catalog()) == len(registry.REGISTRY) == 15


def test_command_line_verdict(tmp_path, capsys):
    items = {"sycophancy": 1, "goal_adherence": 0, "constraint_retention": 2, "self_consistency": 0, "confusion": 0}
    quote = {1: "the words that stand here", 2: "words that are nowhere at all"}
    reply = {k: {"score": v, "evidence": f'it says "{quote.get(v, "")}"' if v else ""} for k, v in items.items()} | {"wasted_effort": [], "candidate_verdicts": [{"is_sycophancy": True}]}
    (tmp_path / "reply.txt").write_text(json.dumps(reply))
    (tmp_path / "digest.txt").write_text("These are the words that stand here.")
    assert cli.main(["--verdict", str(tmp_path / "reply.txt"), "--against", str(tmp_path), "--text"]) == 1
    said = capsys.readouterr().out
    assert "verdict salvaged: 5 of 6" in said and "weak: another reading" in said and "quotations found: 1 of 2" in said and "candidates judged: 1, of them sycophancy: 1" in said and "To mend" in said
    assert cli.main(["--verdict", str(tmp_path / "reply.txt"), "--against", str(tmp_path / "gone"), "--text"]) == 1
    assert "quotations are not checked: there is no" in capsys.readouterr().out
    assert cli.main(["--verdict", str(tmp_path / "gone.txt")]) == 2
    assert "the reply cannot be read" in capsys.readouterr().out


def test_command_line_never_raises(spark, write, tmp_path, capsys):
    assert cli.main([str(tmp_path / "nowhere")]) == 1 and "no transcript" in capsys.readouterr().out
    path = write("s", [human("go"), asst("x")], project="-odd-name")
    (tmp_path / "projects" / "-odd-name" / "empty.jsonl").write_text("")
    for name in ("empty", "gone"):
        assert cli.main([str(tmp_path / "projects" / "-odd-name" / f"{name}.jsonl")]) == 1 and "no responses" in capsys.readouterr().out
    assert cli.main([path]) == 0
    assert json.loads(capsys.readouterr().out)["capabilities"]["count"] == 0
    assert cli.main([write.root, "--sweep", "--text"]) == 0 and "1 sessions of 1 files" in capsys.readouterr().out
    assert cli.main(["--calibrate-merge", str(tmp_path / "gone")]) == 0 and "nothing to read" in capsys.readouterr().out


def test_needles_and_folders_over_whole_files(spark, write):
    long = write("long", [human("app --help"), *[asst("x" * 50) for _ in range(30)]])
    write("other", [{"type": "user", "cwd": "/home/me/work.b", "message": {"content": "hi"}}, asst("y")], project="-elsewhere")
    files = transcripts.read_files(spark, f"{write.root}/projects/*/*.jsonl", read_cap=400)
    assert corpus.needle_sessions(files).count() == 0  # it stands before the part that is read
    assert [r["session"].rsplit("/", 1)[1] for r in transcripts.with_needle(spark, f"{write.root}/projects/*/*.jsonl", "--help").collect()] == [long.rsplit("/", 1)[1]]
    listed = transcripts.listing(spark, write.root)
    stems = lambda folder: sorted(r["stem"] for r in transcripts.of_folder(listed, folder).collect())
    assert stems("/work/a") == ["long"] and stems("/home/me/work.b") == ["other"] and stems("/nowhere") == []


def test_a_report_parses_its_session_and_its_siblings_only(spark, write, capsys, monkeypatch):
    for i in range(12):
        write(f"probe{i}", [human("go"), asst("x", [("a", "Bash", {"command": f"app{i} --help"})])], mtime=1_700_000_000 + i)
        write(f"plain{i}", [human("go"), asst("y")], mtime=1_700_000_100 + i)
    parsed, parse = [], transcripts.parse
    monkeypatch.setattr(transcripts, "parse", lambda files, store=False: parsed.append(sorted(r["path"].rsplit("/", 1)[1] for r in files.collect())) or parse(files, store))
    assert cli.main([write.root, "--session", "plain3", "--siblings", "2"]) == 0
    assert parsed == [["plain3.jsonl", "probe10.jsonl", "probe11.jsonl", "probe9.jsonl"]]
    assert json.loads(capsys.readouterr().out)["session"].endswith("plain3.jsonl")
    looked, look = [], transcripts.with_needle
    monkeypatch.setattr(transcripts, "with_needle", lambda spark, path, needle: looked.append(path) or look(spark, path, needle))
    got = transcripts.newest_with_needle(spark, f"{write.root}/projects/*/*.jsonl", "--help", 1)
    assert [r["session"].rsplit("/", 1)[1] for r in got.collect()] == ["probe11.jsonl"]
    assert len(looked) == 1 and len(looked[0]) == 16  # of 24 files


def test_launcher(tmp_path):
    link = tmp_path / "linked"
    link.symlink_to(Path(cli.__file__).parents[1] / "bin" / "sessionloom")
    done = subprocess.run(["sh", str(link), "--catalog", "--text"], capture_output=True, text=True, env=os.environ | {"PATH": f"{Path(sys.executable).parent}:{os.environ['PATH']}"})
    assert done.returncode == 0 and "rereads" in done.stdout


def test_command_line_refuses(spark, write, capsys):
    write("s", [human("go")])
    assert cli.main([write.root]) == 1
    assert "no responses" in capsys.readouterr().out
