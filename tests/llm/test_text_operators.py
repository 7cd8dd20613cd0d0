"""Sharding, token counts, encoding, quality, decontamination and scoring against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionloom.llm import bpe_heap, bpe_matrix, bytekit, decontaminate, jaccard_join, language_model, quality, queries, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
JSON, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def mixed(n, seed=1):
    rng = random.Random(seed)
    pool = [*" '\n\t sStTrevlmd.,!éß中文１٣  ́🙂ABCabc012", "'s", "'re", " '", "<|endoftext|>", "  "]
    return ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 3000, "= " * 900, "=" * 900]


# ---- 1


def test_shards_hold_the_law(spark, sf_dir):
    got = queries.op1_sharding(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and set(got.law) == {"rows"}
    counts = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert set(counts.index) == set(range(40)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and not got.duplicated(["shard", "slot"]).any()
    want = docs.set_index("doc_id").text
    assert all(r.text_crc32 == zlib.crc32(want[r.doc_id].encode()) and r.size == len(want[r.doc_id].encode()) + 16 for r in got.itertuples())


def test_whole_documents_are_shuffled(spark, sf_dir, monkeypatch):
    shuffle, calls = sharding.shuffle_shards, []

    def changed(records, n_shards, size=None, **more):
        calls.append((records.columns, size))
        return shuffle(records, n_shards, size, **more).withColumn("text", F.lit("changed"))

    monkeypatch.setattr(sharding, "shuffle_shards", changed)
    got = queries.op1_sharding(spark, sf_dir).select("size", "text_crc32").distinct().collect()
    assert [tuple(r) for r in got] == [(len("changed") + 16, zlib.crc32(b"changed"))]  # taken from what the shuffle gave back
    columns, size = calls[0]
    assert set(columns) == {*spark.read.parquet(f"{sf_dir}/documents.parquet").columns, "size"} and size == "size"


def test_shuffle_is_uniform_and_bounded(spark):
    df = spark.range(6000).withColumn("pad", F.lit("x"))
    got = sharding.shuffle_shards(df, 4, bucket_rows=500).toPandas()
    order = got.sort_values(["shard", "slot"]).id.to_numpy()
    assert sorted(order) == list(range(6000)) and abs(np.corrcoef(order, np.arange(6000))[0, 1]) < 0.1
    again = sharding.shuffle_shards(df.repartition(7), 4, bucket_rows=500).toPandas().sort_values(["shard", "slot"]).id.to_numpy()
    assert (again == order).all()  # by the seed alone, not by the layout
    assert (sharding.shuffle_shards(df, 4, seed=1, bucket_rows=500).toPandas().sort_values(["shard", "slot"]).id.to_numpy() != order).any()


def test_records_that_repeat_very_often_are_scattered(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("id"))
    got = sharding.shuffle_shards(df, 6, bucket_rows=300).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == 6000 and set(counts) == {1000} and got[got.id == 0].groupby("shard").size().between(400, 600).all()


def test_odd_rows_in_shards(spark, odd, empty, tmp_path):
    got = sharding.shuffle_shards(odd, 3)
    assert got.count() == 8 and got.columns == ["doc_id", "text", "n_words", "shard", "slot"]
    assert sharding.shuffle_shards(empty, 3).count() == 0
    sharding.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 8 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# ---- 4 and 9


def test_counts_as_the_library(spark, texts):
    sample = mixed(1500) + [t for _, t in texts]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(sample, add_special_tokens=False)]
    assert bpe_heap.count_slice(pa.array(sample), open(JSON, "rb").read()).tolist() == want


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_as_the_library(texts, library):
    sample = mixed(1500, 2) + [t for _, t in texts]
    _, words, n = bpe_matrix.encode_slice(pa.array(sample), bpe_matrix.vocabulary(open(RANKS, "rb").read()))
    for text, found, count in zip(sample, words, n):
        ids = library.encode_ordinary(text)
        assert ",".join(w[1] for w in found) == ",".join(map(str, ids)) and count == len(ids)
        assert b"".join(w[2] for w in found) == text.encode()


def thue_morse(n, a, b):
    """Two strings on which a polynomial hash modulo a power of two is blind."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_words_that_polynomials_confuse(spark, library):
    pair = thue_morse(2048, "a", "b")
    vocab = bpe_matrix.vocabulary(open(RANKS, "rb").read())
    for _ in range(2):  # the second time from the cache
        _, words, _ = bpe_matrix.encode_slice(pa.array([*pair, *pair]), vocab)
        assert [b"".join(w[2] for w in t).decode() for t in words] == [*pair, *pair]
        assert [[int(i) for w in t for i in w[1].split(",")] for t in words] == [library.encode_ordinary(t) for t in [*pair, *pair]]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch([*pair], add_special_tokens=False)]
    assert bpe_heap.count_slice(pa.array([*pair]), open(JSON, "rb").read()).tolist() == want
    hashes, bounds = jaccard_join.shingle_sets(pa.array([*pair]))
    assert hashes[bounds[0]] != hashes[bounds[1]]
    tokens, first = language_model.streams(pa.array([*pair]))
    assert tokens[first[0] + 1] != tokens[first[1] + 1]


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    words = [f"word{i % 37}{'x' * (i % 23)}".encode() for i in range(500)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for few in (None, lambda data, starts, ends: np.asarray(ends - starts, np.uint64) % np.uint64(3)):
        if few:
            monkeypatch.setattr(bytekit, "span_hash", few)
        where, number = bytekit.distinct_spans(data, starts, ends)
        assert len(where) == len(set(words)) and [words[where[i]] for i in number.tolist()] == words


@pytest.mark.parametrize("text", ["a" * 5000, "=" * 3000, "ab" * 2500, "xyzzy" * 700 + "q" * 777, "é" * 2000, "".join(random.Random(4).choices("aeinrst", k=6000))])
def test_long_words_as_the_library(text, library):
    vocab = bpe_matrix.vocabulary(open(RANKS, "rb").read())
    assert [list(x) for x in vocab.encode_words([text.encode()])] == [library._encode_single_piece(text)]


def test_odd_rows_in_tokens(odd, empty, library):
    want = sorted((len((r["text"] or "").encode()), len(library.encode_ordinary(r["text"] or "")), r["text"] or "") for r in odd.collect())
    got = bpe_matrix.encode(odd, RANKS).collect()
    assert sorted((len(r["decoded"]), r["n_tokens"], bytes(r["decoded"]).decode()) for r in got) == want
    assert all(library.decode(r["ids"]) == (r["text"] or "") for r in got)
    digests = bpe_matrix.digests(odd, RANKS).where("doc_id = 2").first()
    assert digests["decoded_sha256"] == digests["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe_heap.token_counts(odd, JSON).count() == 8 and bpe_heap.token_counts(empty, JSON).count() == bpe_matrix.digests(empty, RANKS).count() == 0


# ---- 2


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got[got.held_out].doc_id)
    ranks = held.score.rank()
    ones = held.quality == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.98 and (held.predicted == (held.score >= 0.3)).all() and (held.predicted == held.quality).mean() > 0.98


def test_odd_rows_in_quality(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.scored(odd, model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got) and quality.scored(empty, model).count() == 0
    named = odd.withColumnRenamed("n_words", "score").withColumnRenamed("shard", "row")
    assert sorted(map(str, quality.accepted(named, model, 0).collect())) == sorted(map(str, named.collect())) and quality.accepted(named, model, 1.1).count() == 0
    blank = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.scored(odd, blank).collect()} == {0.5}


# ---- 5


def plain_hits(doc, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    d, hit, found = words(doc), set(), set()
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            for q in range(len(d) - k + 1):
                if d[q : q + k] == w[p : p + k]:
                    hit.update(range(q, q + k))
                    found.add(item)
    return d, hit, found


def test_decontamination_as_brute_force(spark, odd, empty):
    items = [(1, "Two three FOUR five six seven eight nine ten eleven twelve"), (2, "中文"), (3, None), (4, "..."), (None, "word"), (5, "y z y z y z y z y z"), (6, "don t")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [i for i in items if i[0] is not None]
    for sent in (8 << 20, 60):  # sent to every task, and as a table
        got = decontaminate.mark(odd, bench, sent_bytes=sent).collect()
        assert len(got) == 8
        for r in got:
            words, hit, found = plain_hits(r["text"], known)
            runs = r["hit_words"]
            assert r["n_words"] == len(words) and r["hit_items"] == sorted(found)
            assert {x for a, b in zip(runs[::2], runs[1::2]) for x in range(a, b)} == hit
    rep = {r["doc_id"]: r for r in decontaminate.report(odd, bench).collect() if r["doc_id"]}
    assert rep[1]["n_hit"] == 10 and rep[1]["contaminated"] and rep[6]["items_sha256"] == hashlib.sha256(b"2,6").hexdigest()
    kept = decontaminate.remove_documents(odd, bench).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "3", "4", "None"]
    assert sorted(tuple(r) for r in kept if r["doc_id"]) == sorted(tuple(r) for r in odd.collect() if r["doc_id"] in (2, 3, 4))  # all columns as they were
    spans = decontaminate.remove_spans(odd, bench)
    assert spans.columns == odd.columns and sorted((r["n_words"] or 0, r["shard"] or "") for r in spans.collect()) == sorted((r["n_words"] or 0, r["shard"] or "") for r in odd.collect())
    cut = {r["doc_id"]: r["text"] for r in spans.collect()}
    assert cut[1] == "one " and cut[6] == "ünï🙂 " and cut[2] is None
    assert decontaminate.report(odd, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.report(empty, bench).count() == 0
    assert decontaminate.mark(empty, bench, sent_bytes=0).count() == 0


def test_a_benchmark_as_a_table_marks_the_same(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    sent, joined = (sorted(map(str, decontaminate.mark(docs, bench, sent_bytes=n).select("doc_id", "n_words", "hit_words", "hit_items").collect())) for n in (8 << 20, 0))
    assert sent == joined and any("hit_words=[]" not in x for x in sent)


# ---- 8


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_as_a_plain_model(spark, odd, texts, order):
    rows = [(d, t) for d, t in texts[:60]] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = language_model.score(df, F.col("doc_id") % 7 == 2, order=order, chunk_bytes=30_000).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    held = [d is not None and d % 7 == 2 for d, _ in rows]
    counts, single = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            stream = ["<", *t, ">"]
            single.update(stream[1:])
            for k in range(1, order + 1):
                counts.update(tuple(stream[i : i + k]) for i in range(len(stream) - k + 1))
    n, v = sum(single.values()), len(single)

    def p(context, w):
        if not context:
            return (single[w] + 1) / (n + v + 1)
        return (counts[(*context, w)] + language_model.PRIOR * p(context[1:], w)) / (counts[context] + language_model.PRIOR)

    want = []
    for (d, _), t, h in zip(rows, tokens, held):
        stream = ["<", *t, ">"]
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in stream[1:])
        full = sum(math.log10(p(tuple(stream[max(0, i - order + 1) : i]), stream[i])) for i in range(1, len(stream)))
        want.append((str(d), h, len(t) + 1, sum(single[w] > 0 for w in stream[1:]), n, round(base, 6), round(full, 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(want)


def test_no_rows_to_learn_from(odd, empty):
    assert language_model.score(empty, F.lit(False)).count() == 0
    got = language_model.score(odd, F.lit(True)).collect()
    assert len(got) == 8 and all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)


def test_n_grams_are_shuffled_once(spark):
    def asked(a, n, count):  # one n-gram in each of four ranges
        return [(a, r, 1, language_model.pack(np.array([n], np.uint64), np.array([count]))) for r in range(4)]

    sent = spark.createDataFrame(asked(1, 5, 2) + asked(2, 5, 3) + asked(3, 6, 7), "chunk long, range long, size long, grams binary")
    answers = language_model.answered(sent, 2)
    assert answers._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["chunk"], r["range"]): language_model.unpack_counts(zstandard.decompress(r["totals"]), 1).tolist() for r in answers.collect()}
    assert got == {(c, r): [n] for c, n in ((1, 5), (2, 5), (3, 7)) for r in range(4)}
