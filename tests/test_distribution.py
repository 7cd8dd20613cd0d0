"""Nearest ranks, unions of line ranges and names in commands against plain versions, and at length."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from session_records import asst, human, result
from sessionloom.operators import calls, corpus
from sessionloom.sources import transcripts


def plain_distribution(rows):
    out = {}
    for k in {k for k, v in rows if v is not None}:
        v = sorted(v for key, v in rows if key == k and v is not None)
        at = lambda q: v[min(len(v) - 1, int(q * len(v)))]
        out[k] = (len(v), sum(x != 0 for x in v), v[0], at(0.5), at(0.9), v[-1])
    return out


@pytest.mark.parametrize("open_values", [1_000_000, 50, 1])
def test_ranks_as_brute_force(spark, open_values):
    """Ties, nulls, clusters far apart, one value only, a key of its own null."""
    rng = random.Random(open_values)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, rng.random(), rng.gauss(0, 1e9), float(rng.randrange(5))])) for _ in range(3000)]
    rows += [("one", 7.0)] * 40 + [("none", None)] + [("big", float(i % 997)) for i in range(25_000)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in corpus.distribution(df, ["k"], open_values=open_values).collect()}
    assert got == plain_distribution(rows)
    assert corpus.distribution(df.limit(0), ["k"], open_values=open_values).count() == 0


def test_rows_are_not_dealt_by_key(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("value"))
    plan = corpus.distribution(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 50000") == 1 and "broadcast" in plan


def plain_meets(spans, whole, low, high):
    return bool(spans) and (whole or any(w or (a < high and low < b) for w, a, b in spans))


def test_unions_as_all_pairs():
    rng = random.Random(4)
    for _ in range(400):
        union, seen = calls.Spans(), []
        for _ in range(rng.choice([3, 30])):
            low = float(rng.randrange(30))
            span = (rng.random() < 0.03, low, rng.choice([low, low + rng.randrange(12), float("inf"), low - 3]) if rng.random() < 0.9 else low)
            assert union.any == bool(seen) and union.meets(*span) == plain_meets(seen, *span)
            union.add(*span)
            seen.append(span)


def test_many_pages_of_one_file():
    n = 20_000
    rows = [("s", "f", 0, 0, side, False, float(10 * i), float(10 * i + 10), i, 0, 1) for i in range(n) for side in (0, 1)]
    names = ["session", "path", "own", "all", "side", "whole", "low", "high", "call_no", "step", "result_chars"]
    whole = pa.table({c: list(x) for c, x in zip(names, zip(*rows))})
    began = time.time()
    got = [r for b in calls.against_union(iter(whole.to_batches(max_chunksize=777))) for r in b.to_pylist()]
    assert time.time() - began < 10 and len(got) == n
    assert not any(r["again"] for r in got) and all(r["still"] for r in got[1:]) and not got[0]["still"]


def test_names_in_a_long_command():
    """Rows by the hit; names inside of names and of longer words."""
    code = "grep -n x " + " ".join(f"dir/file{i}.txt" for i in range(1000)) + " aab.py-old"
    names = pa.table({"session": ["s"] * 6, "base": ["file7.txt", "le77.t", "aab.py", "ab.py", "ab.py", "file1000.txt"]})
    commands = pa.table({"session": ["s"] * 2, "proof_no": [5, 6], "proof_step": [2, 3], "code": [code, "grep y z"]})
    got = sorted((r["base"], r["proof_no"]) for r in calls.names_in(names, commands).to_pylist())
    assert got == [("aab.py", 5), ("ab.py", 5), ("file7.txt", 5), ("le77.t", 5)] and len(code) > 15_000
    assert calls.names_in(names.slice(0, 0), commands).num_rows == calls.names_in(names, commands.slice(0, 0)).num_rows == 0


def test_a_proof_shows_whole_words_around_the_name(spark):
    said = [
        ("grep x a.py", "a.py", "grep x a.py"),
        ("a b c d e  f src/a.py:9 g h i j k", "a.py", "… c d e f src/a.py:9 g h i j …"),
        ("x" * 30 + " a.py", "a.py", "… a.py"),
        ("sed -n 1,5p\n  'my file.txt'", "my file.txt", "sed -n 1,5p 'my file.txt'"),
        ("1 2 3 4 5 6", "gone", "1 2 3 4 …"),
    ]
    df = spark.createDataFrame(said, "command string, name string, want string")
    assert [(r["want"], r["got"]) for r in df.select("want", calls.around(F.col("command"), F.col("name")).alias("got")).collect()] == [(w, w) for _, _, w in said]


def test_the_first_later_access_is_the_proof(spark, write):
    big = "x" * 6000

    records = [human("go")]
    for i, (name, given, text) in enumerate(
        [
            ("Read", {"file_path": "/w/a.py"}, big),
            ("Bash", {"command": "grep -n b /w/other.py"}, "x"),
            ("Bash", {"command": "grep -n x /w/xa.py.bak"}, "x"),
            ("Read", {"file_path": "/w/a.py", "offset": 3, "limit": 9}, "x"),
            ("Read", {"file_path": "/w/a.py"}, big),
        ]
    ):
        records += [asst(calls=[(f"t{i}", name, given)], request=f"r{i}"), result(f"t{i}", text)]
    model = transcripts.load(spark, write("s", records))
    (row,) = calls.proofs(model).collect()
    assert (row["step"], row["proof_step"]) == (0, 2) and row["proof"] == "`grep -n x /w/xa.py.bak` later searched it"
