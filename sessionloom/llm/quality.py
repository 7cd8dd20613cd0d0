"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams are hashed into buckets; a bucket has a learned vector,
a document the mean of its buckets' vectors, and a softmax layer turns that mean into class
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled documents. A word pair is hashed by the difference of its words'
hashes, so a word that is repeated meets itself in one bucket, whatever the word.

With two classes a document's log odds are the mean over its buckets of one number for each
bucket, so scoring is one table look-up per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sessionloom.llm import bytekit

BUCKETS = 1 << 17
DIMENSIONS = 16
#: bounds of the training sample: labelled rows, and bytes of their texts
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 24 << 20
N_GRAMS = (3, 4)
THRESHOLD = 0.3
#: bytes of texts whose features are made at a time in training
TRAIN_SLICE = 1 << 17
INVERSE = np.uint64(pow(int(bytekit.PRIME), -1, 1 << 64))

_powers: dict[np.uint64, np.ndarray] = {}


def powers(n: int, of: np.uint64) -> np.ndarray:
    """of ** (0 .. n-1) modulo 2**64."""
    if len(_powers.get(of, ())) < n:
        table = np.full(max(n, 1 << 16), of, np.uint64)
        table[0] = 1
        _powers[of] = np.multiply.accumulate(table)
    return _powers[of][:n]


def features(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Kinds of features, each as (bucket of each feature, row bounds), and the row count."""
    data, offsets = bytekit.flat(column)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    offsets = np.searchsorted(at, offsets)
    n = len(point)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    space = np.zeros(n, bool)
    small = point < 256
    space[small] = bytekit.SPACE[point[small]]
    # sums of (point + 1) * PRIME ** position: a rolling hash, which is enough to choose a bucket
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((point.astype(np.uint64) + np.uint64(1)) * powers(n, bytekit.PRIME), out=sums[1:])
    inverse = powers(n + 1, INVERSE)
    starts, ends = bytekit.words(~space, offsets)
    word = bytekit.mix((sums[ends] - sums[starts]) * inverse[starts])
    bounds = bytekit.row_bounds(starts, offsets)
    kinds = [((word >> shift).astype(np.int64), bounds)]
    if len(word) > 1:
        pair = bytekit.mix(word[1:] - word[:-1] + np.uint64(7)) >> shift
        row = bytekit.row_of(bounds)
        inside = row[1:] == row[:-1]
        seen = np.concatenate([[0], np.cumsum(inside)])
        # pairs that begin before each row's first word, all of them inside earlier rows
        kinds.append((pair[inside].astype(np.int64), seen[np.minimum(bounds, len(inside))]))
    spaces = np.concatenate([[0], np.cumsum(space)])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    for k in N_GRAMS:
        if n < k:
            continue
        i = np.flatnonzero((spaces[k - 1 : n] == spaces[1 : n - k + 2]) & (np.arange(n - k + 1) + k <= row_end[: n - k + 1]))
        gram = bytekit.mix((sums[i + k] - sums[i]) * inverse[i] + np.uint64(k)) >> shift
        kinds.append((gram.astype(np.int64), np.searchsorted(i, offsets)))
    return kinds, len(column)


@dataclass(frozen=True)
class Model:
    """Log odds that each bucket adds (before the mean), and those of a text without features."""

    odds: np.ndarray
    base: float

    def score(self, column: pa.Array) -> np.ndarray:
        kinds, n = features(column)
        total, count = np.zeros(n), np.zeros(n)
        for buckets, bounds in kinds:
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.odds[buckets], out=sums[1:])
            total += np.diff(sums[bounds])
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(self.base + total / np.maximum(count, 1), -500, 500)))


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 3, rate: float = 0.2, seed: int = 1) -> Model:
    """Fit vectors and softmax layer; without rows of both classes the model is the base rate."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), base)
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    # small slices, as all this is the driver's memory
    for part in bytekit.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", TRAIN_SLICE):
        kinds, n = features(part.column(0))
        for r in range(n):
            ids, counts = np.unique(np.concatenate([b[lo[r] : lo[r + 1]] for b, lo in kinds]), return_counts=True)
            rows.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0, base], np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)).tolist():
            ids, weight = rows[r]
            now = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            mean = weight @ vectors[ids]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            error = p - target[r]
            down = layer @ error
            layer -= now * np.outer(mean, error)
            # the step along a mean of many vectors is scaled to that of one vector
            scale = now / float(weight @ weight)
            vectors[ids] -= np.outer(weight * scale, down)
    odds = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(odds.astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Train on ``rows`` labelled documents at most, outside the held-out fold, in the order of a
    hash of their ids, as far as ``size`` bytes of text go (these are the documented bounds).

    Null ids and null labels are not used; of several labels of an id the least counts, of several
    texts the first in order.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    chosen = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows of two numbers
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
    )
    order = chosen.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    sized = sorted(tuple(r) for r in order.select("h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).collect())
    total, last = 0, None
    for h, _, n in sized:
        total += n
        if last is not None and total > size:
            break
        last = h
    if last is None:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    found = order.where(F.col("h") <= last).select("h", "doc_id", "text", (F.col("quality") > 0).cast("long").alias("label")).toArrow()
    found = found.take(np.lexsort((found.column("doc_id").to_numpy(), found.column("h").to_numpy()))).combine_chunks()
    return train(found.column("text").combine_chunks().cast(pa.string()), found.column("label").to_numpy())


def accepted(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` at least, with all their columns as they were,
    whatever their names. Null and empty texts have the base rate's score; rows that repeat stay or go
    together; very long texts are read whole; an empty table gives an empty result."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return scored(rows, model).where(F.col("score") >= least).select("row.*")


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name`` (a column of that name gives way).

    Only ``text`` is read for it. Null and empty texts get the base rate's score; repeated rows get
    equal scores; very long texts are read whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column("text")))], [*part.schema.names, name])

    base = docs.drop(name)
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))
