"""The log format: what makes a step, a turn, a result and a seam."""

import pytest
from session_records import asst, human, result, rows

from sessionloom.operators import formats, turns as turn_checks
from sessionloom.plans.registry import Context
from sessionloom.sources import transcripts


@pytest.fixture
def load(spark, write):
    return lambda records, **k: transcripts.load(spark, write("s", records), store=True, **k)


def test_records_of_one_response_are_one_step(load):
    m = load([human("go"), asst("a", request="r1"), human("[Request interrupted by user]"), asst("b", [("c1", "Read", {"file_path": "/x"})], "r1"), asst("c", request="r2")])
    steps = rows(m.steps, "step")
    assert [s["text"] for s in steps] == ["a\nb", "c"]
    assert m.calls.count() == 1 and m.sessions.first()["n_steps"] == 2


def test_a_null_group_never_merges(load):
    assert load([human("go"), asst("a"), asst("b")]).steps.count() == 2


def test_interruption_is_no_turn(load):
    m = load([human("go"), asst("r"), human("[Request interrupted by user for tool use]"), human("no, do it the other way"), asst("r2")])
    assert [t["prompt"] for t in rows(m.turns, "turn")] == ["go", "no, do it the other way"]


def test_tool_results_sidechains_meta_and_notifications_are_no_turns(load):
    m = load(
        [
            human("go"),
            asst("x", [("c1", "Bash", {"command": "ls"})]),
            result("c1", "out"),
            human("side", isSidechain=True),
            human("meta", isMeta=True),
            human("<task-notification>done</task-notification>"),
        ]
    )
    assert [t["prompt"] for t in rows(m.turns)] == ["go"]
    assert {r["kind"]: r["n"] for r in rows(m.record_types)} == {"user": 5, "assistant": 1}


def test_a_quoted_notification_keeps_its_turn(load):
    m = load([human("before <task-notification>x</task-notification> after"), asst("r")])
    assert rows(m.turns)[0]["prompt"] == "before   after"


def test_slash_commands(load):
    tags = "<command-message>m</command-message><command-name>/x</command-name><command-args>{}</command-args>"
    m = load([human(tags.format("write the brief")), asst("a"), human(tags.format("")), asst("b")])
    assert [t["prompt"] for t in rows(m.turns)] == ["write the brief"]


def test_declined_and_failed_calls(load):
    m = load(
        [
            human("go"),
            asst("", [("a", "Bash", {"command": "x"}), ("b", "Bash", {"command": "y"}), ("c", "Bash", {"command": "z"}), ("d", "Bash", {"command": "w"})]),
            result("a", "The user doesn't want to proceed with this tool use.", True),
            result("b", "Error: no", False),
            result("c", "fine"),
            result("c", "late answer", True),
        ]
    )
    got = {c["command"]: (c["ok"], c["declined"], c["result_chars"]) for c in rows(m.calls)}
    assert got["x"][:2] == (True, True) and got["y"][:2] == (False, False) and got["z"] == (True, False, 4) and got["w"] == (None, False, 0)


def test_a_reused_id_goes_to_the_latest_call(load):
    m = load([human("go"), asst("", [("a", "Bash", {"command": "x"})]), asst("", [("a", "Bash", {"command": "y"})]), result("a", "four")])
    assert {c["command"]: c["result_chars"] for c in rows(m.calls)} == {"x": 0, "y": 4}


def test_depth_is_carried(load):
    steps = rows(load([human("go"), asst("a", tokens=0), asst("b", tokens=70), asst("c", tokens=0)]).steps, "step")
    assert [s["depth"] for s in steps] == [0, 70, 70]


def boundary(trigger, pre, post):
    return {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": trigger, "preTokens": pre, "postTokens": post, "preservedMessages": {"uuids": ["u", "v"]}}}


def test_seams(load):
    m = load(
        [
            human("one"),
            asst("a", tokens=90),
            boundary("auto", 100, 10),
            human("summary text", isCompactSummary=True),
            human("two"),
            asst("b", tokens=20),
            human("orphan", isCompactSummary=True),
        ]
    )
    seams = rows(turn_checks.seam_rows(m), "seam")
    assert [(s["trigger"], s["step"], s["turn"], s["summary_chars"], s["depth_before"], s["depth_after"]) for s in seams] == [("auto", 1, 1, 12, 90, 20), ("unknown", 2, 1, 6, 20, None)]
    assert [t["prompt"] for t in rows(m.turns, "turn")] == ["one", "two"]
    found = turn_checks.compaction(Context(m)).first()
    assert found["fired"] and "70 fewer" in found["specifics"][0] and "no response on the other side" in found["specifics"][1]


def test_broken_lines_are_counted(load):
    m = load(["not json", '{"a": 1} x', "[]", "", human("go"), {"type": "assistant", "message": None}, asst("a"), {"type": "odd-kind"}])
    kinds = {r["kind"]: r["n"] for r in rows(m.record_types)}
    assert kinds["<unparsed>"] == 2 and kinds["<not-an-object>"] == 1 and kinds["odd-kind"] == 1
    assert "odd-kind" in {r["kind"] for r in rows(formats.census(m.record_types)) if r["standing"] == "undeclared"}


def test_tail_of_a_large_file(load):
    m = load([human("first"), asst("a"), human("second"), asst("b")], read_cap=330)
    row = m.sessions.first()
    assert row["truncated"] and row["dropped_bytes"] > 0 and "<unparsed>" not in {r["kind"] for r in rows(m.record_types)}


def test_no_records(load):
    m = load([""])
    assert m.turns.count() == m.steps.count() == 0 and m.sessions.first()["n_steps"] == 0


def test_unicode_prompts_and_multibyte_results(load):
    m = load([human("¿Estás seguro? ñandú"), asst("", [("a", "Read", {"file_path": "/ä.py"})]), result("a", "ß" * 7)])
    assert rows(m.calls)[0]["result_chars"] == 7 and rows(m.turns)[0]["prompt"].startswith("¿Est")


def test_listing_and_current(spark, write):
    write("old", [human("a"), asst("b")], mtime=1_700_000_000)
    write("new", [human("a"), asst("b")], mtime=1_700_001_000)
    write("else", [human("a")], project="-work-b", mtime=1_700_002_000)
    files = transcripts.listing(spark, write.root)
    assert files.count() == 3
    mine = files.where(files.project == transcripts.mangled("/work.a"))
    assert transcripts.current(mine).first()["stem"] == "new"
    assert transcripts.current(mine, "old").first()["stem"] == "old"
    assert transcripts.current(mine, "nowhere").first()["stem"] == "new"
