"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on a few Gaussian directions (a 2-stable law: a projected squared distance,
over the true one, follows a chi-square law). A kd-tree over the projections indexes every row. Its
upper part, fitted on a bounded sample, deals rows into cells; each cell has the lower part. A query
takes projected neighbours in growing distance and verifies them by their true distance, until the
chi-square test says that a neighbour nearer than those found would have come up already with the
wanted probability.

The search has two rounds. A query first visits the cell it falls into; the distance that it finds
there is the test's bound for all other cells, and it is sent to those alone whose box the test does
not rule out. Queries are rows like all others: none are held by the driver. Equal vectors share a
place in the tree, where the smallest ids that any answer can hold are kept, so copies cost nothing.

How much the test rules out is up to the vectors. Where they have clusters, few cells are visited;
where all are about as far from each other as the nearest are, most of them are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from sessionloom.session import ensure_checkpoint_dir

M = 8  # projections; an even number has a closed chi-square distribution
LEAF = 256
SURE = 0.95
#: rows of a cell, and rows of the sample for each cell
CELL_ROWS, CELL_SAMPLE = 16_384, 32
#: queries that meet a cell in one piece
QUERY_BLOCK = 131_072


def chi_square(x: float, m: int) -> float:
    """The distribution function of the chi-square law with an even number of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, m // 2):
        term *= half / k
        total += term
    return 1 - float(np.exp(-half)) * total


def chi_square_point(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(d: int, m: int = M, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, d]).normal(size=(d, m))


class Splits:
    """The upper part of the tree: median splits of a sample's projections, down to the cells."""

    def __init__(self, points: np.ndarray, cells: int):
        m = points.shape[1]
        self.dimension, self.value, self.child, self.cell = [], [], [], []
        low, high = [], []
        stack = [(np.arange(len(points)), cells, np.full(m, -np.inf), np.full(m, np.inf), -1, 0)]
        while stack:
            rows, wanted, lo, hi, parent, side = stack.pop()
            node = len(self.cell)
            if parent >= 0:
                self.child[parent][side] = node
            spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(m)
            widest = int(spread.argmax())
            value = float(np.median(points[rows, widest])) if len(rows) else 0.0
            left = points[rows, widest] < value
            self.child.append([-1, -1])
            self.dimension.append(widest)
            self.value.append(value)
            if wanted < 2 or not left.any():
                self.cell.append(len(low))
                low.append(lo)
                high.append(hi)
                continue
            self.cell.append(-1)
            below, above = hi.copy(), lo.copy()
            below[widest] = above[widest] = value
            stack.append((rows[left], wanted // 2, lo, below, node, 0))
            stack.append((rows[~left], wanted - wanted // 2, above, hi, node, 1))
        self.child, self.cell = np.array(self.child), np.array(self.cell)
        self.dimension, self.value = np.array(self.dimension), np.array(self.value)
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.cell[node] < 0)
            if not len(inner):
                return self.cell[node]
            at = node[inner]
            node[inner] = self.child[at, (points[inner, self.dimension[at]] >= self.value[at]).astype(int)]


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        away = np.maximum(0, np.maximum(low[:, j] - points[:, j, None], points[:, j, None] - high[:, j]))
        out += away * away
    return out


class Tree:
    """The lower part of the tree: leaves over a cell's projected points, with vectors and ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keep: int, m: int = M):
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.flatnonzero(new)
        # the smallest ids of equal vectors: no answer needs more of them
        copies = [np.unique(ids[a:b])[:keep] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)])]
        vectors = vectors[first]
        points = vectors @ directions(vectors.shape[1], m)
        leaves, stack = [], [np.arange(len(first))]
        while stack:
            rows = stack.pop()
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= LEAF or not spread.any():
                leaves.append(rows)
                continue
            split = np.argpartition(points[rows, int(spread.argmax())], len(rows) // 2)
            stack += [rows[split[len(rows) // 2 :]], rows[split[: len(rows) // 2]]]
        placed = np.concatenate(leaves)
        self.edges = np.cumsum([0] + [len(x) for x in leaves])
        self.vectors, self.points = vectors[placed], points[placed]
        self.copies = [copies[i] for i in placed.tolist()]
        self.least = np.array([c[0] for c in self.copies])
        self.norms, self.point_norms = (self.vectors**2).sum(1), (self.points**2).sum(1)
        self.low = np.minimum.reduceat(self.points, self.edges[:-1])
        self.high = np.maximum.reduceat(self.points, self.edges[:-1])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, limit: float, bound: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each query the k smallest (distance, id) of other ids, as far as they are within its
        ``bound``, found by the time the stopping test holds."""
        n, keep = len(queries), k + 1
        points = queries @ directions(queries.shape[1], self.points.shape[1])
        norms, point_norms = (queries**2).sum(1), (points**2).sum(1)
        apart = gaps(points, self.low, self.high)
        order = np.argsort(apart, 1, kind="stable")
        furthest = bound.astype(float).copy()
        who, place, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < order.shape[1]:
            # the next leaves of every query whose test does not hold yet
            leaf = order[:, at : at + step]
            going = np.take_along_axis(apart, leaf, 1) <= limit * (furthest * furthest)[:, None]
            rows, columns = np.nonzero(going)
            if not len(rows):
                break
            chosen = leaf[rows, columns]
            by_leaf = np.argsort(chosen, kind="stable")
            cuts = np.flatnonzero(np.diff(chosen[by_leaf], prepend=-1, append=-1))
            found = [(who, place, far)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                q = rows[by_leaf[a:b]]
                lo, hi = self.edges[chosen[by_leaf[a]]], self.edges[chosen[by_leaf[a]] + 1]
                within = (furthest[q] ** 2 * (1 + 1e-9))[:, None]
                # projected neighbours first, then a true distance that may be off in its last digits
                near = point_norms[q, None] + self.point_norms[lo:hi] - 2 * points[q] @ self.points[lo:hi].T <= limit * within + 1e-9
                if near.mean() > 0.1:
                    near &= norms[q, None] + self.norms[lo:hi] - 2 * queries[q] @ self.vectors[lo:hi].T <= within + 1e-9 * (1 + norms[q, None] + self.norms[lo:hi])
                i, j = np.nonzero(near)
                i, j = q[i], j + lo
                for c in range(0, len(i), 65_536):
                    x, y = i[c : c + 65_536], j[c : c + 65_536]
                    away = self.vectors[y] - queries[x]
                    distance = np.sqrt((away * away).sum(1))
                    good = distance <= furthest[x]
                    found.append((x[good], y[good], distance[good]))
            who, place, far = (np.concatenate(x) for x in zip(*found))
            best = np.lexsort((self.least[place], far, who))
            who, place, far = who[best], place[best], far[best]
            begin = np.searchsorted(who, np.arange(n + 1))
            rank = np.arange(len(who)) - begin[who]
            full = np.flatnonzero(np.diff(begin) >= keep)
            furthest[full] = np.minimum(furthest[full], far[begin[full] + keep - 1])
            who, place, far = who[rank < keep], place[rank < keep], far[rank < keep]
            at, step = at + step, 1 if at < 1 else 2 * step
        out: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        mine = own.tolist()
        for q, p, s in zip(who.tolist(), place.tolist(), far.tolist()):
            out[q] += [(s, i) for i in self.copies[p].tolist() if i != mine[q]]
        return [sorted(x)[:k] for x in out]


def matrices(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch of valid rows, by dimension."""
    ids, column = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = ids[rows], column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)
    return out


MESSAGE = "d int, cell int, block int, ids binary, vectors binary, bounds binary"
FOUND = ", query_id long, vec_id long, score double"


def message(d: int, cell: int, block: int, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray | None = None) -> tuple:
    return d, cell, block, ids.astype("<i8").tobytes(), np.ascontiguousarray(vectors).tobytes(), None if bounds is None else bounds.astype("<f8").tobytes()


def as_batch(rows: list[tuple], found: list[tuple] | None = None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in (MESSAGE + (FOUND if found is not None else "")).split(", ")]
    if found is not None:
        kinds += [pa.int64(), pa.int64(), pa.float64()]
        rows = [(*r, None, None, None) for r in rows] + [(None,) * 6 + f for f in found]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def dealer(splits: dict[int, Splits], keep: int | None, blocks: int, m: int):
    """Rows as messages to their cells; of equal vectors in a batch the ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, (ids, vectors) in matrices(batch).items():
                if keep is not None:
                    order = np.lexsort((ids, *vectors.T[::-1]))
                    ids, vectors = ids[order], vectors[order]
                    new = np.ones(len(ids), bool)
                    new[1:] = (vectors[1:] != vectors[:-1]).any(1) | (ids[1:] != ids[:-1])
                    ids, vectors = ids[new], vectors[new]  # a repeated row is one
                    start = np.ones(len(ids), bool)
                    start[1:] = (vectors[1:] != vectors[:-1]).any(1)
                    copy = np.arange(len(ids)) - np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))
                    ids, vectors = ids[copy < keep], vectors[copy < keep]
                cell = splits[d].of(vectors.astype(float) @ directions(d, m)) if d in splits else np.zeros(len(ids), np.int64)
                block = ids % blocks if keep is None else np.zeros(len(ids), np.int64)
                key = cell * blocks + block
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    own = order[a:b]
                    rows.append(message(d, int(cell[own[0]]), int(block[own[0]]), ids[own], vectors[own]))
            yield as_batch(rows)

    return run


def searcher(splits: dict[int, Splits], k: int, sure: float, m: int, kind: str, first: bool):
    """Searches a cell for the queries sent there. In the first round it also sends them on to the
    cells that the test does not rule out."""
    limit = chi_square_point(sure, m)

    def read(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [b"".join(x.as_py() or b"" for x in table.column(c)) for c in ("ids", "vectors", "bounds")]
        return np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], kind).astype(float).reshape(-1, d), np.frombuffer(raw[2], "<f8")

    def run(cell: pa.Table, asked: pa.Table) -> pa.Table:
        found, on = [], []
        if asked.num_rows:
            d, here, block = (asked.column(c)[0].as_py() for c in ("d", "cell", "block"))
            own, queries, bounds = read(asked, d)
            bounds = np.full(len(own), np.inf) if first else bounds
            if cell.num_rows:
                ids, vectors, _ = read(cell, d)
                tree = Tree(vectors, ids, k + 1, m)
                for a in range(0, len(own), 4096):
                    part = slice(a, a + 4096)
                    for q, got in enumerate(tree.search(queries[part], own[part], k, limit, bounds[part]), a):
                        found += [(int(own[q]), i, s) for s, i in got]
                        if first and len(got) == k:
                            bounds[q] = got[-1][0]
            if first and d in splits:
                points = queries @ directions(d, m)
                for a in range(0, len(own), 4096):
                    part = slice(a, a + 4096)
                    near = gaps(points[part], splits[d].low, splits[d].high) <= (limit * bounds[part] ** 2)[:, None]
                    for c in np.flatnonzero(near.any(0)).tolist():
                        if c != here:
                            q = a + np.flatnonzero(near[:, c])
                            on.append(message(d, c, block, own[q], queries[q].astype(kind), bounds[q]))
        return pa.Table.from_batches([as_batch(on, found)])

    return run


def nearest(
    vectors: DataFrame,
    every: int,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    sure: float = SURE,
    m: int = M,
    query_block: int = QUERY_BLOCK,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The k nearest rows of each query: ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with
    the query's id. Distances are Euclidean, in double precision; ties go to the smaller id. Null
    ids, and vectors that are null, zero, or hold null or non-finite components, take no part;
    vectors of unlike dimension are not near each other. An id of several rows counts once, at its
    nearest; a repeated query id is asked once, with its first vector in order. Other columns are
    not read. No rows give no rows.

    Cells are fitted on a sample of about ``CELL_SAMPLE`` rows for each ``cell_rows`` rows of the
    input, 4,096 at least; every row is indexed. Where queries number more than ``query_block``, a
    cell meets them in several blocks.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    single = dict(vectors.dtypes)[vector_column] == "array<float>"
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    infinite = F.lit(float("inf"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{element}>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < infinite, F.lit(False))) & F.exists("v", lambda x: x != 0))
    n = rows.count()
    cells = 1 << max(0, (n // cell_rows).bit_length())
    sample = max(4096, CELL_SAMPLE * cells)
    taken = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n // sample))) == 0).limit(2 * sample).select("id", "v").toArrow()
    splits: dict[int, Splits] = {}
    for batch in taken.combine_chunks().to_batches():
        for d, (_, found) in matrices(batch).items():
            splits[d] = Splits(found.astype(float) @ directions(d, m), max(1, cells * len(found) // max(1, taken.num_rows)))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-(n // max(1, every)) // query_block))
    placed = rows.mapInArrow(dealer(splits, k + 1, 1, m), MESSAGE).checkpoint()
    if blocks > 1:
        placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["d", "cell", "block"]
    by_cell = placed.groupBy(*key)
    home = asked.mapInArrow(dealer(splits, None, blocks, m), MESSAGE)
    first = by_cell.cogroup(home.groupBy(*key)).applyInArrow(searcher(splits, k, sure, m, kind, True), MESSAGE + FOUND).checkpoint()
    on = first.where("cell IS NOT NULL").select(*[x.split()[0] for x in MESSAGE.split(", ")])
    second = by_cell.cogroup(on.groupBy(*key)).applyInArrow(searcher(splits, k, sure, m, kind, False), MESSAGE + FOUND)
    names = ["query_id", "vec_id", "score"]
    out = first.where("query_id IS NOT NULL").select(*names).unionByName(second.where("query_id IS NOT NULL").select(*names))
    nearest_of = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return nearest_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
