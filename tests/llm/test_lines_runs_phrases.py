"""Periodic runs, shared lines and collocations against plain versions."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bytekit, collocations, line_dedup, periodic_runs, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"


# ---- 11


def plain_runs(words, least=24, times=3):
    """All stretches, period by period; a stretch counts with its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in found.items())


def periodic(rng):
    """Words with loops inside of loops, over few different words or many."""
    pool = rng.choice([1, 2, 2, 3, 5, 50])
    words = [rng.randrange(pool) for _ in range(rng.choice([0, 1, 3, 10, 30, 60, 120, 200]))]
    for _ in range(rng.choice([0, 1, 2, 4])):
        loop = [rng.randrange(pool) for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (loop * rng.choice([3, 4, 9, 20]))[: rng.choice([10, 24, 25, 60])]
    return (words + [rng.randrange(pool)]) * rng.choice([2, 3, 4]) if rng.random() < 0.3 else words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (2, 2), (9, 3), (12, 4)])
def test_runs_as_brute_force(least, times):
    rng, seen = random.Random(least), 0
    for _ in range(100):
        rows = [periodic(rng) for _ in range(rng.choice([1, 5, 20]))]
        got = periodic_runs.find_runs(np.array([w for r in rows for w in r], np.int64), np.cumsum([0] + [len(r) for r in rows]), least, times)
        for i, words in enumerate(rows):
            assert got.get(i, []) == plain_runs(words, least, times)
            seen += len(got.get(i, []))
    assert seen > 100


def test_copies_inside_of_blocks():
    """A long passage with a run inside comes again: its run is copied, not found at a border."""
    rng = random.Random(5)
    passage = [rng.randrange(1000) for _ in range(40)] + [7, 8] * 15 + [rng.randrange(1000) for _ in range(40)]
    words = passage + [2000] + passage + [2001] + passage
    got = periodic_runs.find_runs(np.array(words), np.array([0, len(words)]))
    assert got[0] == plain_runs(words) and len(got[0]) == 3


def test_long_loops_in_linear_time():
    """One word 300,000 times, and a loop of 1,000 words 300 times."""
    n = 300_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64), np.array([0, n])) == {0: [(0, n, 1)]}
    loop = np.tile(np.random.default_rng(1).permutation(1000), 300)
    assert periodic_runs.find_runs(loop, np.array([0, n])) == {0: [(0, n, 1000)]}


def test_rows_never_share_a_run(spark):
    df = spark.createDataFrame([(1, "a b " * 11), (2, "a b " * 11), (3, " a b" * 12), (4, "x " + "A b " * 12 + "a b")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in periodic_runs.with_runs(df).collect()}
    assert [len(got[i]["runs"]) for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert tuple(got[3]["runs"][0]) == (0, 24, 2) and got[3]["collapsed"] == "a b"
    assert tuple(got[4]["runs"][0]) == (1, 24, 2) and got[4]["collapsed"] == "x A b a b" and got[1]["collapsed"] == ("a b " * 11).strip()


def test_runs_of_odd_rows(spark, odd, empty):
    data = odd.withColumn("runs", F.lit(1))  # a name that gives way
    got = periodic_runs.with_runs(data).collect()
    assert len(got) == 8 and periodic_runs.with_runs(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[2]["runs"] == [] and by[3]["collapsed"] == ""
    assert by[6]["collapsed"] == "ünï🙂 中文 don't" and by[None]["shard"] is None
    assert [tuple(x) for x in by[5]["runs"]] == [(1, 8000, 2)] and by[5]["collapsed"] == "x" * 3000 + " y z"


def test_runs_query_as_its_contract(spark, sf_dir, texts):
    import hashlib
    import zlib

    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
        runs = plain_runs_by_arrays([ids[x] for x in w])
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[d] == (d, len(runs), *tail, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))
    assert len(got) == len(texts)


def plain_runs_by_arrays(ids, least=24, times=3):
    a, found = np.array(ids), {}
    for q in range(1, len(ids) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], a[:-q] == a[q:], [False]]).astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, size, q) for (s, size), q in found.items())


# ---- 12


def plain_kept(rows, documents, least=1):
    keys = [[x.strip(SPACE).translate(LOWER) for x in (t or "").split("\n")] for t in rows]
    count = Counter(k for own in keys for k in set(own))
    return [(len(own), sum(drop(k, count, documents, least) for k in own), "\n".join(x for x, k in zip((t or "").split("\n"), own) if not drop(k, count, documents, least))) for t, own in zip(rows, keys)]


def drop(key, count, documents, least):
    return len(key) >= least and count[key] >= documents


def line_texts(seed, n):
    rng = random.Random(seed)
    pool = ["Home", " home\t", "About us", "é", "É", "", "  ", "x" * 300, " home", "~", *[f"line {i}" for i in range(30)]]
    return [None, "", "\n", "home\nHome\r\nHOME", "last\n"] + ["\n".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("documents,least,fan,parts", [(10, 1, 3, 7), (2, 4, 2, 5), (1, 1, 3, 1), (200, 1, 4, 3)])
def test_lines_as_brute_force(spark, documents, least, fan, parts):
    rows = line_texts(documents, 120)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    batches = [df.where(F.col("doc_id") % parts == i) for i in range(parts)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_common(df, batches, documents=documents, least=least, fan=fan).collect()}
    assert [got[i] for i in range(len(rows))] == plain_kept(rows, documents, least)


def test_runs_are_levelled_and_compacted(spark):
    runs = line_dedup.LineRuns(spark, documents=2, fan=2)
    shapes = []
    for i in range(5):
        runs.add(spark.createDataFrame([(f"own {i}\nshared",)], "text string"))
        shapes.append([len(level) for level in runs.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    # once common, a line is in no later run
    later = spark.table(runs.levels[0][0])
    assert later.count() == 1 and spark.table(runs.levels[2][0]).where("common").count() == 1
    assert runs.common().count() == 1 and runs.levels == []
    assert line_dedup.LineRuns(spark).common().count() == 0


def test_counts_of_several_runs_meet(spark):
    """As the runs are read by column batches, which needs compiled stages."""
    lines = "\n".join(f"line {i}" for i in range(200))
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        for fan in (2, 4):  # compacted by twos, or merged at the end alone
            runs = line_dedup.LineRuns(spark, documents=3, fan=fan)
            for i in range(3):
                runs.add(spark.createDataFrame([(f"{lines}\nown {i}",)], "text string"))
            common = runs.common()
            assert common.count() == common.distinct().count() == 200
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_lines_of_many_common_ones_are_joined(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rows = line_texts(3, 60)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_common(df, [df], documents=5).collect()}
    assert [got[i] for i in range(len(rows))] == plain_kept(rows, 5)


def test_lines_of_odd_rows(spark, odd, empty):
    data = odd.withColumn("kept", F.lit(1)).withColumn("drop", F.lit("d")).withColumn("high", F.lit(2))
    got = line_dedup.drop_common(data, [data], documents=2).collect()
    assert len(got) == 8 and [r["n_dropped"] for r in got if r["doc_id"] == 1] == [1, 1] and {r["drop"] for r in got} == {"d"}
    assert {r["doc_id"]: r["kept"] for r in got}[4] == " \n\t " and line_dedup.drop_common(empty, [empty]).count() == 0
    assert all(r["kept"] == (r["text"] or "") for r in got if r["doc_id"] != 1)


def test_files_are_dealt_into_batches(spark, tmp_path):
    spark.range(100).select("id", F.concat(F.lit("same\n"), F.col("id")).alias("text")).repartition(9).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").select("id", "text")
    batches = line_dedup.batches_of(docs, 4)
    assert len(batches) == 4 and sorted(r["id"] for b in batches for r in b.collect()) == list(range(100))
    assert {r["kept"] for r in line_dedup.drop_common(docs, batches).collect()} == {str(i) for i in range(100)}


# ---- 13


def plain_phrases(rows, longest, least, top, percent):
    count, totals = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang_ = "und" if lang is None else lang
            totals[lang_] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang_, tuple(w[i : i + k]))
                    count[key] = count.get(key, 0) + 1
    many = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    gone = {(lang, w[i:j]) for (lang, w), n in many.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and (lang, w[i:j]) in many and 100 * n >= percent * many[lang, w[i:j]]}
    out = {}
    for (lang, w), a in many.items():
        if (lang, w) not in gone:
            cuts = [(2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, left, right, totals[lang], score))
    return sorted((lang, i + 1, p.decode(), *rest) for lang, found in out.items() for i, (_, _, p, *rest) in enumerate(sorted(found)[:top]))


def phrase_rows(seed, n):
    rng = random.Random(seed)
    pool = ["The", "the", "of", "é", "É", "new york", "a b c d e", "a b c", "x", *[f"w{i}" for i in range(12)], "!", ". ", "\n", "\t", "\x0b"]
    return [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40, 200])))) for _ in range(n)] + [("en", None), ("en", "b " * 500), ("de", "p q " * 300)]


@pytest.mark.parametrize("longest,least,top,percent", [(4, 10, 2000, 80), (3, 3, 20, 50), (5, 30, 7, 100), (2, 1, 5, 80)])
def test_phrases_as_brute_force(spark, longest, least, top, percent):
    rows = phrase_rows(least, 80)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.mine(df, longest=longest, least=least, top=top, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, longest, least, top, percent)


def test_bitmaps_shift_over_blocks_and_stop_at_gaps():
    rng = np.random.default_rng(3)
    at = rng.integers(-1, 4, 5000).astype(np.int32)
    every = np.full((1 << collocations.SIEVE_BITS) // 8, 255, np.uint8)
    hashes = np.arange(1, 5, dtype=np.uint64)
    for size in (1, 2, 3, 4):
        want = Counter(tuple(at[i : i + size].tolist()) for i in range(len(at) - size + 1) if (at[i : i + size] >= 0).all())
        got = Counter()
        for rows, count in collocations.phrases_of(at, hashes, size, [every] * (size - 1)):
            got.update(dict(zip(map(tuple, rows.tolist()), count.tolist())))
        assert got == want


def test_sieves_keep_what_is_frequent(spark):
    rows = [("en", "a b c. " * 20), ("en", "a b. c"), ("de", "ü 🙂 " * 9)] * 2 + [("en", f"x{i} y{i}") for i in range(500)]
    shards = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInArrow(collocations.packer(), collocations.SHARD).checkpoint()
    for ranges in (256, 1 << 12):
        sieves = []
        for size in (1, 2):
            sieves.append(collocations.sieve_of(shards, size, sieves, 10, ranges))
        one, two = (np.frombuffer(x, np.uint8) for x in sieves)

        def asked(sieve, lang, *words):
            return bool(collocations.passes(sieve, collocations.phrase_hashes([collocations.word_hashes(pa.array([lang]), pa.array([w])) for w in words]))[0])

        assert asked(one, "en", "a") and asked(one, "de", "ü") and not asked(one, "de", "a") and not asked(one, "en", "x7")
        assert asked(two, "en", "a", "b") and asked(two, "de", "ü", "🙂") and not asked(two, "en", "b", "a") and not asked(two, "en", "x7", "y7")


def test_differences_come_back():
    rng = np.random.default_rng(8)
    for x in (np.zeros(0, np.int64), np.array([0, 1, (1 << 32) - 1]), rng.integers(0, 1 << 20, 1000)):
        assert collocations.expanded(collocations.squeezed(x), len(x)).tolist() == x.tolist()


def test_scores_beyond_64_bits(spark):
    n = 8 * 10**18
    phrases = spark.createDataFrame([("x", "a", 1, n), ("x", "b", 1, n), ("x", "a b", 2, n - 1)], "lang string, phrase string, size int, f long")
    r = collocations.scored(phrases).first()
    assert (r["score"], r["l"], r["r"]) == (2000000 * (n - 1) // (2 * n), n, n)


def test_phrases_of_odd_rows(spark, odd, empty):
    plain = odd.withColumn("lang", F.when(F.col("doc_id") < 6, "en")).withColumn("phrase", F.lit(1))
    got = collocations.mine(plain, least=2).collect()
    assert ("en", "y z") in {(r["lang"], r["phrase"]) for r in collocations.mine(plain, least=2, longest=2).collect()}
    assert {r["n"] for r in got if r["lang"] == "en"} == {2 * 11 + 8001}
    assert collocations.mine(empty.withColumn("lang", F.lit("en"))).count() == 0


def test_words_of_a_slice_are_told_apart_by_language():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["a b", "a", "B. a"])], ["lang", "text"])
    (shard,) = collocations.packer()(iter([batch]))
    langs, words, at = (x.tolist() for x in collocations.unpacked(shard, 0))
    assert [(langs[i], words[i]) if i >= 0 else None for i in at] == [("en", "a"), ("en", "b"), None, ("de", "a"), None, ("en", "b"), None, ("en", "a")]
    assert len(set(zip(langs, words))) == len(words) == 3 and bytekit.SLICE_BYTES
