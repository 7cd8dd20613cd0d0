"""Language-model scoring with a weighted backoff automaton.

The n-grams of the training documents are counted over the whole corpus. A smoothed n-gram is an
arc with its log probability; an n-gram that can be a context is a state, whose failure arc leads
to the state of its longest shorter suffix and costs the backoff weight. A text is scored in one
left-to-right traversal that carries the state.

Smoothing is by a prior of constant weight K on the shorter context:
p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K), and p(w) = (c(w) + 1) / (N + V + 1).

The model grows with the corpus, so no task holds all of it. A task packs the documents it reads into
chunks of bounded size, which are stored; nothing but these tasks' own rows decides on a chunk, so no
key can make one large. A chunk sends its distinct n-grams (the remainder of a hash, dealt into ranges
by the leading bits) with its own training counts, a range adds up what all chunks sent and answers
each chunk with the totals, and the chunk builds the part of the automaton that its texts can reach.
Every n-gram of every training document counts; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm import bytekit
from sessionloom.session import drop_shuffles, ensure_checkpoint_dir

ORDER = 3
PRIOR = 8.0
CHUNK_BYTES = 4 << 20
#: text whose n-grams share a range
RANGE_BYTES = 8 << 20
#: bits of an n-gram's hash behind those of its range, as long as 63 bits hold both
LOW_BITS = 48
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729E6546B64)
STEP = np.uint64(0xA0761D6478BD642F)
ONE = np.uint64(1)


def streams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text as begin, words, end; and where each text begins."""
    data, offsets = bytekit.flat(column)
    data = bytekit.LOWER[data]
    starts, ends = bytekit.words(~bytekit.SPACE[data], offsets)
    bounds = bytekit.row_bounds(starts, offsets)
    rows = len(bounds) - 1
    tokens = np.empty(len(starts) + 2 * rows, np.uint64)
    first = bounds[:-1] + 2 * np.arange(rows)
    tokens[first] = BEGIN
    tokens[bounds[1:] + 2 * np.arange(rows) + 1] = END
    tokens[np.arange(len(starts)) + 2 * bytekit.row_of(bounds) + 1] = bytekit.span_hash(data, starts, ends)
    return tokens, np.append(first, len(tokens))


def n_grams(tokens: np.ndarray, first: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the n-gram of each length (row) that ends at each token, and whether the text
    has that many tokens up to there."""
    n = len(tokens)
    inside = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    grams = np.empty((order, n), np.uint64)
    grams[0] = bytekit.mix(tokens + ONE)
    for k in range(1, order):
        grams[k, 1:] = bytekit.mix(grams[k - 1, :-1] * STEP + grams[0, 1:])
    low = low_bits(bits)
    top = grams >> np.uint64(64 - bits) << np.uint64(low) if bits else np.uint64(0)
    return top | (grams & np.uint64((1 << low) - 1)), inside >= np.arange(order)[:, None]


def low_bits(bits: int) -> int:
    return min(LOW_BITS, 63 - bits)


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of their places, and their counts."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    large = counts >= 255
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes() + pack_counts(counts, large), 1)


def pack_counts(counts: np.ndarray, large: np.ndarray) -> bytes:
    """Counts as bytes, with those over 254 behind."""
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpack_counts(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    large = out == 255
    if large.any():
        out[large] = np.frombuffer(raw, "<i8", offset=at + n)
    return out


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), unpack_counts(raw, n, 8 * n)


class Automaton:
    """The arcs and states that some texts can reach. ``total`` has the training counts of the
    n-grams that ``at`` points to."""

    def __init__(self, at: np.ndarray, total: np.ndarray, tokens: int, types: int, prior: float):
        self.at, self.total, self.order = at, total, len(at)
        probability = np.zeros(len(total))
        self.arc = np.zeros(len(total))
        self.back = np.log10(prior / (total + prior))  # the failure arc of a state
        place = np.empty(len(total), np.int64)
        for k in range(self.order):
            ends = np.flatnonzero(at[k] >= 0)
            place[at[k, ends]] = ends  # one of the places where each n-gram ends
            own = np.zeros(len(total), bool)
            own[at[k, ends]] = True
            found = np.flatnonzero(own)
            where = place[found]
            if k == 0:
                probability[found] = (total[found] + 1) / (tokens + types + 1)
            else:
                context, suffix = at[k - 1, where - 1], at[k - 1, where]
                probability[found] = (total[found] + prior * probability[suffix]) / (total[context] + prior)
            self.arc[found] = np.log10(probability[found])

    def scores(self, first: np.ndarray) -> np.ndarray:
        """Log probability of each text: all texts step from token to token together."""
        lengths = np.diff(first)
        by_length = np.argsort(-lengths, kind="stable")
        begin = first[:-1][by_length]
        falling = -lengths[by_length]
        out = np.zeros(len(lengths))
        # begin is no token, but the first state is that of its context
        state = np.minimum(self.order - 1, (self.total[self.at[0, begin]] > 0).astype(np.int64))
        for t in range(1, int(lengths.max(initial=0))):
            n = int(np.searchsorted(falling, -t, side="left"))  # texts with more than t tokens
            i = begin[:n] + t
            length = state[:n]
            gain = np.zeros(n)
            for k in range(self.order - 1, 0, -1):
                here = length == k
                if not here.any():
                    continue
                j = i[here]
                seen = self.total[self.at[k, j]] > 0
                gain[here] += np.where(seen, 0, self.back[self.at[k - 1, j - 1]])
                length[here] = np.where(seen, k, k - 1)
            arc = self.at[length, i]
            out[:n] += gain + self.arc[arc]
            state[:n] = np.where(self.total[arc] > 0, np.minimum(self.order - 1, length + 1), 0)
        result = np.empty(len(lengths))
        result[by_length] = out
        return result


def packed(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A task's documents as chunks: ``chunk``, a number, and ``rows``, their rows compressed."""
    partition, made = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size, made
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        row = zstandard.compress(sink.getvalue().to_pybytes(), 2)
        number = (partition << 32) + made
        held, size, made = [], 0, made + 1
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([row], pa.binary())], ["chunk", "rows"])

    for batch in batches:
        for part in bytekit.slices(batch, "text", max(1, chunk_bytes // 4)):
            held.append(part)
            size += part.column("text").nbytes + 16 * part.num_rows
            if size >= chunk_bytes:
                yield flush()
    if held:
        yield flush()


def opened(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(rows)).read_all()


def request(order: int, bits: int):
    """A chunk's distinct n-grams and its training counts of them, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(low_bits(bits))
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                table = opened(rows.as_py())
                tokens, first = streams(table.column("text"))
                numbers, valid = n_grams(tokens, first, order, bits)
                trained = np.repeat(~table.column("held_out").to_numpy(), np.diff(first))
                # the training flag rides in the last bit, so that sorting needs no second array
                both = np.sort((numbers << ONE | trained.astype(np.uint64))[valid])
                values = both >> ONE
                edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                counts = np.add.reduceat((both & ONE).astype(np.int64), edges)
                values = values[edges]
                cuts = np.searchsorted(values >> low, np.arange((1 << bits) + 1).astype(np.uint64)) if bits else np.array([0, len(values)])
                values &= np.uint64((1 << int(low)) - 1)
                ranges = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ranges), chunk)),
                        pa.array(ranges),
                        pa.array(np.diff(cuts)[ranges]),
                        pa.array([pack(values[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]]) for r in ranges.tolist()], pa.binary()),
                    ],
                    ["chunk", "range", "size", "grams"],
                )

    return run


def add_up(table: pa.Table) -> pa.Table:
    """The totals of a range, as each chunk that asked needs them."""
    sizes = table.column("size").to_pylist()
    values, counts = zip(*[unpack(raw.as_py(), n) for raw, n in zip(table.column("grams"), sizes)])
    distinct, inverse = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)  # exact up to 2^53
    edges = np.cumsum([0, *sizes])
    answers = []
    for a, b in zip(edges, edges[1:]):
        own = total[inverse[a:b]]
        answers.append(zstandard.compress(pack_counts(own, own >= 255), 1))
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "size": table.column("size"), "totals": pa.array(answers, pa.binary())})


def add_up_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of the ranges of a task, mostly one."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    held.clear()
    ranges = np.unique(table.column("range").to_numpy())
    for r in ranges:
        yield from add_up(table if len(ranges) == 1 else table.filter(pa.compute.equal(table.column("range"), r))).to_batches()


def answered(asked: DataFrame, bits: int) -> DataFrame:
    """The totals of all ranges, by chunk. One range a task, whatever the number of shuffle partitions; the
    task is the group, as a grouping would write all n-grams to disk once more."""
    return asked.repartitionById(1 << bits, F.col("range").cast("int")).mapInArrow(add_up_ranges, "chunk long, range long, size long, totals binary")


def score_chunk(order: int, bits: int, tokens_all: int, types: int, prior: float):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        docs = opened(chunk.column("rows")[0].as_py())
        tokens, first = streams(docs.column("text"))
        numbers, valid = n_grams(tokens, first, order, bits)
        distinct, inverse = np.unique(numbers[valid], return_inverse=True)
        at = np.full((order, len(tokens)), -1, np.int64)
        at[valid] = inverse
        ranges = np.argsort(answers.column("range").to_numpy())
        sizes, raws = answers.column("size").to_pylist(), answers.column("totals")
        total = np.concatenate([unpack_counts(zstandard.decompress(raws[r].as_py()), sizes[r]) for r in ranges.tolist()])
        if len(total) != len(distinct):
            raise ValueError("a chunk's answers do not fit its n-grams")
        counts = total[at[0]]
        spoken = np.ones(len(tokens), bool)
        spoken[first[:-1]] = False  # begin is context only
        base = np.where(spoken, np.log10((counts + 1) / (tokens_all + types + 1)), 0)
        known = np.concatenate([[0], np.cumsum((counts > 0) & spoken)])
        sums = np.add.reduceat(base, first[:-1])
        scores = Automaton(at, total, tokens_all, types, prior).scores(first)
        n = len(scores)
        values = [docs.column("doc_id"), docs.column("held_out"), np.diff(first) - 1, np.diff(known[first]), np.full(n, tokens_all), sums, scores]
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for (k, t), v in zip(OUT, values)})

    return run


OUT = [
    ("doc_id", pa.int64()),
    ("held_out", pa.bool_()),
    ("n_tokens", pa.int64()),
    ("n_known", pa.int64()),
    ("train_tokens", pa.int64()),
    ("base_score", pa.float64()),
    ("score", pa.float64()),
]
OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token hashes of the training texts of a task's chunks with their counts; a token comes up once
    for every two million or so."""
    held: dict[str, np.ndarray] = {"h": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held["h"].view(np.int64)), pa.array(held["n"])], ["h", "n"])
        held["h"], held["n"] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out

    for batch in batches:
        for rows in batch.column("rows"):
            table = opened(rows.as_py())
            tokens, first = streams(table.filter(pa.compute.invert(table.column("held_out"))).column("text"))
            h, n = np.unique(np.delete(tokens, first[:-1]), return_counts=True)
            both, inverse = np.unique(np.concatenate([held["h"], h]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, inverse, np.concatenate([held["n"], n]))
            held["h"], held["n"] = both, total
            if len(both) > 2_000_000:
                yield flush()
    yield flush()


def score(docs: DataFrame, held_out: F.Column, order: int = ORDER, prior: float = PRIOR, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): see ``OUT_DDL``.

    Texts for which ``held_out`` is true are scored but not learned from. Null and empty texts are
    the end token alone; repeated rows count, and are scored, each time; null ids stay null; other
    columns are not read. Very long texts are scored whole, a text above ``chunk_bytes`` in a chunk
    of its own; equal texts have equal scores. Without training texts every token has probability
    1 / 1 in the base. An empty table gives an empty result.

    Messages number chunks times ranges, so ``chunk_bytes`` and ``range_bytes`` are to grow with the
    memory of a task where the texts run to many terabytes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    held = rows.agg(F.sum((F.octet_length("text") + 16).cast("long"))).first()[0] or 0
    bits = (held // range_bytes).bit_length()
    chunks = rows.mapInArrow(lambda batches: packed(batches, chunk_bytes), "chunk long, rows binary").checkpoint()
    words = chunks.mapInArrow(distinct_words, "h long, n long")
    seen = words.groupBy("h").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = seen["n"] or 0, seen["v"]
    drop_shuffles(spark)
    asked = chunks.mapInArrow(request(order, bits), "chunk long, range long, size long, grams binary")
    answers = answered(asked, bits).checkpoint()
    drop_shuffles(spark)  # the n-grams themselves are no longer needed
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score_chunk(order, bits, tokens, types, prior), OUT_DDL)
