"""Benchmark decontamination by a hash set of normalised word windows.

The windows of the test items are hashed and sent to every task; documents are scanned window by
window, every hash hit is verified against the window's words, and the words inside occurrences
are marked. Spans of marked words can be cut out, or whole documents dropped.

Only a benchmark whose size has been checked is sent. The windows of a larger one are a table, and the
windows of documents that pass a sieve of fixed size are joined with it on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sessionloom.llm import bytekit
from sessionloom.session import ensure_checkpoint_dir

WINDOW = 10
#: text of a benchmark that is sent to every task; its windows take some 150 times that there, and two
#: seconds a MiB to build
SENT_BYTES = 1 << 20
#: bits of the sieve for larger ones, as a power of two, and how they are cut to be put together
SIEVE_BITS, SIEVE_BLOCK = 24, 1 << 18

WORD = np.ones(256, bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
STEP = np.uint64(0xD6E8FEB86659FD93)


def item_words(text: str | None) -> list[bytes]:
    data = bytekit.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends = bytekit.words(WORD[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, from the hashes of the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += hashes[j : j + n]
    return bytekit.mix(out)


def item_windows(items: list[tuple[int, str | None]], window: int) -> dict[int, dict[tuple[bytes, ...], set[int]]]:
    """By length, each window's words and the items that have it."""
    out: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        w = item_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            out.setdefault(k, {}).setdefault(tuple(w[i : i + k]), set()).add(item)
    return out


def hashes_of(keys: list[tuple[bytes, ...]], k: int) -> np.ndarray:
    """The hash of each window of k words, as ``window_hashes`` has it."""
    flat = b"".join(b"".join(x) for x in keys)
    edges = np.cumsum([0] + [len(w) for x in keys for w in x])
    return window_hashes(bytekit.span_hash(np.frombuffer(flat, np.uint8), edges[:-1], edges[1:]), k)[::k]


class Windows:
    """The windows of some items: by length, sorted hashes with their words and items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.tables = []
        for k, found in sorted(item_windows(items, window).items()):
            keys = list(found)
            whole = hashes_of(keys, k)
            order = np.argsort(whole, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[(whole >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((k, whole[order], [keys[i] for i in order], [sorted(found[keys[i]]) for i in order], sieve))

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, list[int]]]]:
        """Word starts, ends and row bounds of a text column, and the verified occurrences as
        (first word, number of words, items)."""
        data, offsets = bytekit.flat(column)
        data = bytekit.LOWER[data]
        starts, ends = bytekit.words(WORD[data], offsets)
        bounds = bytekit.row_bounds(starts, offsets)
        hits: list[tuple[int, int, list[int]]] = []
        if len(starts):
            hashes = bytekit.span_hash(data, starts, ends)
            row = bytekit.row_of(bounds)
            raw = data.tobytes()
            for k, known, keys, items, sieve in self.tables:
                whole = window_hashes(hashes, k)
                maybe = np.flatnonzero(sieve[(whole >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[row[maybe] == row[maybe + k - 1]]
                low = np.searchsorted(known, whole[maybe])
                same = known[np.minimum(low, len(known) - 1)] == whole[maybe]
                for i, j in zip(maybe[same].tolist(), low[same].tolist()):
                    words = tuple([raw[a:b] for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist())])
                    while j < len(known) and known[j] == whole[i]:
                        if keys[j] == words:
                            hits.append((i, k, items[j]))
                        j += 1
        return starts, ends, bounds, hits


def marked(part: pa.RecordBatch, bounds: np.ndarray, hit: np.ndarray, items: list) -> pa.RecordBatch:
    """``part`` with the three columns of ``mark``, from which words are hit."""
    runs = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
        runs.append(edge.tolist())
    added = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "n_words", "hit_words", "hit_items"])


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the spans."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + sizes, -1)
    return np.cumsum(mark[:-1]) > 0


def scanner(items: list[tuple[int, str | None]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items, window)
        for batch in batches:
            for part in bytekit.slices(batch, "text"):
                starts, _, bounds, hits = windows.scan(part.column("text"))
                found: list[set[int]] = [set() for _ in range(part.num_rows)]
                row = bytekit.row_of(bounds)
                for i, _, ids in hits:
                    found[row[i]].update(ids)
                hit = covered(len(starts), np.array([h[0] for h in hits], np.int64), np.array([h[1] for h in hits], np.int64))
                yield marked(part, bounds, hit, [sorted(x) for x in found])

    return run


def window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of items as rows: ``k``, ``hash``, ``words``, ``item_id``."""
    for batch in batches:
        for at in range(batch.num_rows):
            rows = []
            item = batch.column("item_id")[at].as_py()
            for k, found in item_windows([(item, batch.column("text")[at].as_py())], window).items():
                keys = list(found)
                rows += [(k, h, b" ".join(w).decode(), item) for w, h in zip(keys, hashes_of(keys, k).view(np.int64).tolist())]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.int64()))], ["k", "hash", "words", "item_id"])


def sieve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of the sieve, in blocks of packed bits."""
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    for batch in batches:
        sieve[(batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
    parts = sieve.reshape(-1, SIEVE_BLOCK)
    used = np.flatnonzero(parts.any(1)).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(parts[i]).tobytes() for i in used], pa.binary())], ["block", "bits"])


def either(table: pa.Table) -> pa.Table:
    out = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([out.tobytes()], pa.binary())})


def candidates(lengths: list[int], packed: bytes):
    """The windows of documents that pass the sieve: ``number`` of the row, first word, length, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            for part in bytekit.slices(batch, "text"):
                data, offsets = bytekit.flat(part.column("text"))
                data = bytekit.LOWER[data]
                starts, ends = bytekit.words(WORD[data], offsets)
                bounds = bytekit.row_bounds(starts, offsets)
                row = bytekit.row_of(bounds)
                hashes = bytekit.span_hash(data, starts, ends)
                raw, number = data.tobytes(), part.column("number").to_numpy()
                out: list[tuple] = []
                for k in lengths:
                    whole = window_hashes(hashes, k)
                    at = np.flatnonzero(sieve[(whole >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
                    at = at[row[at] == row[at + k - 1]]
                    for i in at.tolist():
                        words = b" ".join([raw[a:b] for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist())])
                        out.append((int(number[row[i]]), i - int(bounds[row[i]]), k, words.decode()))
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["number", "first", "k", "words"])

    return run


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``spans`` (first word and length of each occurrence) and ``items`` as ``mark`` gives them."""
    for batch in batches:
        for part in bytekit.slices(batch, "text"):
            data, offsets = bytekit.flat(part.column("text"))
            starts, _ = bytekit.words(WORD[bytekit.LOWER[data]], offsets)
            bounds = bytekit.row_bounds(starts, offsets)
            spans = part.column("spans").to_pylist()
            first = np.array([bounds[r] + x["first"] for r, found in enumerate(spans) for x in found or ()], np.int64)
            size = np.array([x["k"] for found in spans for x in found or ()], np.int64)
            items = [sorted(x or ()) for x in part.column("items").to_pylist()]
            yield marked(part.select([n for n in part.schema.names if n not in ("spans", "items")]), bounds, covered(len(starts), first, size), items)


MARKS = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.LongType()))]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``hit_words`` (array<long>: first word and one past
    the last, of each run of hit words) and ``hit_items`` (array<long>, sorted item ids).

    ``docs`` needs ``text``; its other columns are passed through, but for three of those names,
    which give way. Null and empty texts have no words; null items and items without words have no
    windows; a null ``item_id`` takes no part; repeated items and rows are kept. Very long texts and
    items are read whole. An empty benchmark marks nothing; an empty table gives an empty result.
    """
    bench = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    plain = docs.drop("n_words", "hit_words", "hit_items")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema] + MARKS)
    if held <= sent_bytes:
        items = [(r[0], r[1]) for r in bench.collect()]
        return plain.mapInArrow(scanner(items, window), schema)
    return mark_by_join(plain, bench, window, schema)


def mark_by_join(docs: DataFrame, bench: DataFrame, window: int, schema: T.StructType) -> DataFrame:
    """``mark`` for a benchmark of any size: no task holds it, and no document is read once for a part
    of it. Windows with their items are stored; documents are, too, so that their numbers last."""
    ensure_checkpoint_dir(docs.sparkSession)
    windows = bench.mapInArrow(lambda batches: window_rows(batches, window), "k int, hash long, words string, item_id long").distinct().checkpoint()
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # ``window`` numbers at most
    parts = np.zeros(((1 << SIEVE_BITS) // SIEVE_BLOCK, SIEVE_BLOCK // 8), np.uint8)
    for r in windows.select("hash").mapInArrow(sieve_rows, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary").collect():
        parts[r["block"]] = np.frombuffer(r["bits"], np.uint8)  # one row for each block: the sieve's size is fixed
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.monotonically_increasing_id().alias("number")).checkpoint()
    found = rows.select("number", "text").mapInArrow(candidates(lengths, parts.tobytes()), "number long, first long, k int, words string")
    hits = found.join(windows.select("k", "words").distinct(), ["k", "words"]).checkpoint()
    spans = hits.groupBy("number").agg(F.collect_list(F.struct("first", "k")).alias("spans"))
    items = hits.select("number", "k", "words").distinct().join(windows, ["k", "words"]).groupBy("number").agg(F.collect_set("item_id").alias("items"))
    both = rows.join(spans, "number", "left").join(items, "number", "left").select("row", "text", "spans", "items")
    out = both.mapInArrow(finish, T.StructType([*both.schema.fields[:2], *MARKS]))
    return out.select("row.*", *[f.name for f in MARKS])


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytekit.slices(batch, "text"):
            data, offsets = bytekit.flat(part.column("text"))
            starts, ends = bytekit.words(WORD[bytekit.LOWER[data]], offsets)
            bounds = bytekit.row_bounds(starts, offsets)
            texts = part.column("text").to_pylist()
            for r, runs in enumerate(part.column("hit_words").to_pylist()):
                if runs:
                    raw, base, keep, at = texts[r].encode(), int(offsets[r]), [], 0
                    for lo, hi in zip(runs[::2], runs[1::2]):
                        keep.append(raw[at : int(starts[bounds[r] + lo]) - base])
                        at = int(ends[bounds[r] + hi - 1]) - base
                    texts[r] = b"".join([*keep, raw[at:]]).decode()
            i = part.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*part.columns[:i], pa.array(texts, pa.string()), *part.columns[i + 1 :]], part.schema.names)


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every run of hit words cut from its text, all other columns as they were, whatever
    their names; odd rows as in ``mark``."""
    marked = mark(_carried(docs), benchmark, window)
    cut = marked.mapInArrow(cut_spans, marked.schema)
    return cut.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns as they were, whatever their
    names; odd rows as in ``mark``."""
    return mark(_carried(docs), benchmark, window).where(F.size("hit_words") == 0).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id``, words, hit words, items found and a digest of their ids."""
    # ends minus beginnings of the runs
    n_hit = F.aggregate(F.transform("hit_words", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda total, x: total + x)
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return mark(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
