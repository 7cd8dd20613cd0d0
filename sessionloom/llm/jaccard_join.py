"""N-gram Jaccard self-join over whole documents, exact, with a count-vector R-tree.

A document is the set of its distinct shingles. Two documents link when
100 * |A & B| >= share * |A | B|; the result names each document's connected component. A ``Rule``
holds the words of a shingle and the share: four words and 85 for ``op3``, unless another is given.

1. Equal sets are one class (a fingerprint of the set); only classes are joined.
2. The upper part of the index deals classes by group signatures. Shingles are hashed into G groups;
   linked sets of bounded size differ in at most D shingles, so of G > D groups at least G - D hold
   the same shingles in both. Classes meet where a non-empty group's content is equal. Sizes are cut
   into bands, as D follows the size; a class near a band's end takes part in the next band too.
   Common shingles, by a sketch of counts over all documents, are left out of the first deal, so that
   what many texts share deals nobody out. A class with so many empty groups that the shared ones
   could all be empty is dealt again, with all its shingles and under other salts, and lastly into one
   block, so no link is lost.
3. Classes that meet are gathered under the least of them (a hub). There an R-tree over vectors of
   group counts bounds the overlap by summed coordinate minima, for tree nodes and for points, and
   pairs that survive are verified on their sets. Pairs that are already connected are skipped.
4. A hub group of many classes, or of much text, is cut into tiles. Each tile is joined with the hub
   in it; what does not connect to the hub there is joined with the other tiles. All pairs are never
   written out.
5. Components come from alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sessionloom.llm import bytekit
from sessionloom.llm.decontaminate import window_hashes
from sessionloom.session import drop_shuffles, ensure_checkpoint_dir

WHOLE = 100
BAND = 1.3
SALTS = 3
#: classes, and bytes of their texts, that are joined in one piece
TILE, TILE_BYTES = 1500, 8 << 20
#: counters of the sketch, as a power of two, and how they are cut to be added up
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 14
#: a counter is high from so many documents above four times the mean
COMMON = 1000
#: rows of a table of hubs that may be broadcast (two numbers each); a longer one is joined by key
BROADCAST_ROWS = 100_000
COORDINATES = 64
FAN = 16


@dataclass(frozen=True)
class Rule:
    """When two documents link: words in a shingle, and the least per cent of the union that is shared."""

    words: int = 4
    share: int = 85

    @property
    def least(self) -> int:
        """Smaller sets link to equal sets only: n of n + 1 shingles are less than the share."""
        return -(-self.share // (WHOLE - self.share))

    @property
    def band(self) -> float:
        """How much wider each band is; a linked set is never two bands away."""
        return max(BAND, 1.04 * WHOLE / self.share)


RULE = Rule()

# ---- shingle sets -------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, k: int = RULE.words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each text, and row bounds."""
    data, offsets = bytekit.flat(column)
    data = bytekit.LOWER[data]
    starts, ends = bytekit.words(~bytekit.SPACE[data], offsets)
    bounds = bytekit.row_bounds(starts, offsets)
    words = bytekit.span_hash(data, starts, ends)
    row = bytekit.row_of(bounds)
    count = np.diff(bounds)
    hashes, rows = [], []
    whole = window_hashes(words, k)
    inside = np.flatnonzero(row[: len(whole)] == row[k - 1 :]) if len(whole) else np.zeros(0, np.int64)
    hashes.append(whole[inside])
    rows.append(row[inside])
    for short in range(1, k):
        which = np.flatnonzero(count == short)
        if len(which):
            hashes.append(bytekit.mix(window_hashes(words, short)[bounds[which]] + np.uint64(short)))
            rows.append(which)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    # rows in front of the leading bits of the hash; only where two hashes share those is more to do
    order = np.argsort((r.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), kind="stable")
    h, r = h[order], r[order]
    if ((h[1:] < h[:-1]) & (r[1:] == r[:-1])).any():
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(column) + 1))


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(bytekit.mix(hashes ^ np.uint64(salt)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


# ---- the sketch ---------------------------------------------------------------------------------


def counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    return np.bincount(counter(hashes), minlength=1 << SKETCH_BITS)


def high(sketch: np.ndarray) -> np.ndarray:
    """The counters that are far above the others, whose shingles are common."""
    return sketch > 4 * sketch.mean() + COMMON


# ---- group signatures ---------------------------------------------------------------------------


def difference(both: int, rule: Rule = RULE) -> int:
    """The most shingles in which linked sets of ``both`` shingles together can differ."""
    return both * (WHOLE - rule.share) // (WHOLE + rule.share)


@lru_cache(maxsize=None)
def band(j: int, rule: Rule = RULE) -> tuple[int, int, int, int]:
    """The least size of band j, one past the most, its groups, and how many of the groups that
    linked sets share can be empty without another deal."""
    low = rule.least if j == 0 else band(j - 1, rule)[1]
    high = max(low + 1, int(low * rule.band))
    differ = difference(2 * (high - 1), rule)
    spare = 2
    for _ in range(20):
        groups = differ + 1 + spare
        empty = groups * float(np.exp(-rule.share / WHOLE * low / groups))
        spare = max(2, int(np.ceil(empty + 2 * empty**0.5)))
    return low, high, differ + 1 + spare, spare


def bands_of(sizes: np.ndarray, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, band): the band of each size, and the next where it can hold a linked set."""
    top = int(sizes.max(initial=0))
    lows = []
    j = 0
    while True:
        lows.append(band(j, rule)[0])
        if lows[-1] * rule.share > top * WHOLE:
            break
        j += 1
    rows = np.flatnonzero(sizes >= rule.least)
    at = np.searchsorted(lows, sizes[rows], side="right") - 1
    next_low = np.array([*lows, 1 << 60])[at + 1]
    near = sizes[rows] * WHOLE >= next_low * rule.share

    return np.concatenate([rows, rows[near]]), np.concatenate([at, at[near] + 1])


def signatures(hashes: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, common: np.ndarray, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the wanted rows' sets: (row, signature). ``common`` has the sketch's high counters."""
    sizes = np.diff(bounds)
    rows, band_no = bands_of(np.where(wanted, sizes, 0), rule)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out_rows, out_signatures = [], []
    for salt in range(SALTS + 1):
        if salt == SALTS:  # left over after all deals: one block for each band
            out_rows.append(rows)
            out_signatures.append(bytekit.mix(band_no.astype(np.uint64) + np.uint64(0xABCDEF)))
            break
        known = [band(j, rule) for j in range(int(band_no.max()) + 1)]
        groups = np.array([b[2] for b in known])[band_no]
        n = sizes[rows]
        element = np.arange(n.sum()) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n)
        h = hashes[element]
        first = np.cumsum(groups) - groups
        if salt:
            spread = bytekit.mix(h ^ np.uint64(salt * 0x9E3779B1))
        else:
            spread = h
        cell = np.repeat(first, n) + (spread % np.repeat(groups, n).astype(np.uint64)).astype(np.int64)
        if not salt:
            rare = ~common[counter(h)]
            cell, h = cell[rare], h[rare]
        total = np.zeros(int(groups.sum()), np.uint64)
        np.add.at(total, cell, bytekit.mix(h + np.uint64(0x51ED270B)))
        filled = np.bincount(cell, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(rows)), groups)
        place = np.arange(len(total)) - first[owner]
        tag = (band_no[owner].astype(np.uint64) << np.uint64(40)) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(salt)
        out_rows.append(rows[owner[filled]])
        out_signatures.append(bytekit.mix(total[filled] + bytekit.mix(tag[filled])))
        empty = groups - np.bincount(owner[filled], minlength=len(rows))
        again = empty > np.array([b[3] for b in known])[band_no]
        rows, band_no = rows[again], band_no[again]
        if not len(rows):
            break
    return np.concatenate(out_rows), np.concatenate(out_signatures).view(np.int64)


# ---- the R-tree ---------------------------------------------------------------------------------


class CountTree:
    """An R-tree over count vectors, packed by size; a node keeps its upper corner and least size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.levels = [(vectors, sizes)]
        while len(self.levels[-1][0]) > FAN:
            v, s = self.levels[-1]
            edges = np.arange(0, len(v), FAN)
            self.levels.append((np.maximum.reduceat(v, edges), np.minimum.reduceat(s, edges)))

    def near(self, vector: np.ndarray, size: int, rule: Rule = RULE) -> np.ndarray:
        """Points whose summed coordinate minima allow a link."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            v, s = self.levels[level]
            bound = np.minimum(v[at], vector).sum(1)
            at = at[(WHOLE + rule.share) * bound >= rule.share * (size + s[at])]
            if level:
                below = len(self.levels[level - 1][0])
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < below]
        return at


def linked(a: np.ndarray, b: np.ndarray, rule: Rule = RULE) -> bool:
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return WHOLE * both >= rule.share * (len(a) + len(b) - both)


def links_within(sets: list[np.ndarray], left: np.ndarray | None = None, rule: Rule = RULE) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect whatever links of (left or any) x any connect, and component numbers."""
    n = len(sets)
    component = np.arange(n)
    found: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        if linked(sets[0], sets[1], rule):
            return [(0, 1)], np.zeros(2, np.int64)
        return [], component
    order = np.argsort(sizes, kind="stable")
    owner = np.repeat(np.arange(n), sizes[order])
    group = (np.concatenate([sets[i] for i in order.tolist()]) % np.uint64(COORDINATES)).astype(np.int64)
    vectors = np.bincount(owner * COORDINATES + group, minlength=n * COORDINATES).reshape(n, COORDINATES).astype(np.int32)
    tree = CountTree(vectors, sizes[order])
    for p, i in enumerate(order.tolist()):
        if left is not None and not left[i]:
            continue
        near = tree.near(vectors[p], int(sizes[i]), rule)
        near = order[near[near > p] if left is None else near[near != p]]
        while True:
            near = near[component[near] != component[i]]
            if not len(near):
                break
            j, near = int(near[0]), near[1:]
            if linked(sets[i], sets[j], rule):
                found.append((i, j))
                component[component == component[j]] = component[i]
    return found, component


# ---- Spark ----------------------------------------------------------------------------------------


ROWS = "doc_id long, n long, fp long, fp2 long, block int, counts binary"


def per_document(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """A row for each document, and behind them the task's sketch, in blocks."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    seen: set[int] = set()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for part in bytekit.slices(batch, "text"):
            hashes, bounds = shingle_sets(part.column("text"), rule.words)
            a, b = fingerprints(hashes, bounds)
            n = np.diff(bounds)
            sketch += sketch_of(hashes[np.repeat(once(a, n, seen, rule.least), n)])
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), *none], names)
    parts = sketch.reshape(-1, SKETCH_BLOCK)
    used = np.flatnonzero(parts.any(1)).tolist()
    counts = pa.array([zstandard.compress(parts[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())
    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), pa.int64())] * 4, pa.array(used, pa.int32()), counts], names)


def add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(x.as_py()), "<u4").astype(np.int64) for x in table.column("counts"))
    return pa.table({"block": table.column("block")[:1], "counts": pa.array([zstandard.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})


def common_shingles(rows: DataFrame) -> np.ndarray:
    """The high counters of all tasks' sketches; their size is fixed."""
    sketch = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK)
    added = rows.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add_blocks, "block int, counts binary")
    for r in added.collect():  # one row for each block, whatever the corpus
        sketch[r["block"]] = np.frombuffer(zstandard.decompress(r["counts"]), "<i8")
    return high(sketch.ravel())


def once(a: np.ndarray, sizes: np.ndarray, seen: set[int], least: int) -> np.ndarray:
    """Rows whose set this task has not met yet (copies need no second turn)."""
    new = np.zeros(len(a), bool)
    if len(seen) > 1_000_000:
        seen.clear()
    for i, (x, n) in enumerate(zip(a.tolist(), sizes.tolist())):
        if n >= least and x not in seen:
            seen.add(x)
            new[i] = True
    return new


def per_signature(batches: Iterator[pa.RecordBatch], common: bytes, rule: Rule) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    known = np.frombuffer(zstandard.decompress(common), bool)
    for batch in batches:
        for part in bytekit.slices(batch, "text", 1 << 20):
            hashes, bounds = shingle_sets(part.column("text"), rule.words)
            fp = fingerprints(hashes, bounds)[0]
            rows, signature = signatures(hashes, bounds, once(fp, np.diff(bounds), seen, rule.least), known, rule)
            yield pa.RecordBatch.from_arrays([pa.array(signature), pa.array(fp[rows])], ["sig", "fp"])


def per_text(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for part in bytekit.slices(batch, "text"):
            hashes, bounds = shingle_sets(part.column("text"), rule.words)
            fp = fingerprints(hashes, bounds)[0]
            keep = pa.array(np.flatnonzero(once(fp, np.diff(bounds), seen, rule.least)))
            yield pa.RecordBatch.from_arrays([pa.array(fp).take(keep), part.column("text").take(keep)], ["fp", "text"])


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, fp): for each signature of several classes, the least class (the
    hub) with each other one. Rows stream through; only the last signature's hub is remembered."""
    last_sig, hub, last_fp = None, None, None
    for batch in batches:
        sig, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        goes_on = last_sig is not None and sig[0] == last_sig
        if goes_on:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        hubs = np.where(start >= 0, fp[start], hub if hub is not None else 0)
        before = np.empty(len(fp), np.int64)
        before[1:] = fp[:-1]
        before[0] = last_fp if goes_on else fp[0]
        keep = ~new & (fp != hubs) & (fp != before)
        last_sig, hub, last_fp = sig[-1], hubs[-1], fp[-1]
        if keep.any():
            pairs = np.unique(np.stack([hubs[keep], fp[keep]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["hub", "fp"])


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by their keys, many at a time."""
    held: pa.Table | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = pa.Table.from_batches([batch.slice(at, 512)])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < 512:
                continue
            same = np.ones(held.num_rows, bool)
            for k in keys:
                c = held.column(k).to_numpy()
                same &= c == c[-1]
            open_from = held.num_rows - int(same[::-1].argmin() if not same.all() else len(same))
            if open_from:
                yield held.slice(0, open_from)
                held = held.slice(open_from)
    if held is not None and held.num_rows:
        yield held


def tile_links(keys: list[str], with_rest: bool, rule: Rule):
    """Links in each group; with ``with_rest``, also the classes that did not connect to the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, keys):
            table = table.combine_chunks()
            fp, hub = table.column("fp").to_numpy(), table.column("hub").to_numpy()
            tiles = table.column("tiles").to_numpy()
            left = table.column("left").to_numpy(zero_copy_only=False)
            cut = np.zeros(len(fp) + 1, bool)
            cut[[0, -1]] = True
            for k in keys:
                c = table.column(k).to_numpy()
                cut[1:-1] |= c[1:] != c[:-1]
            edges = np.flatnonzero(cut)
            sets: list[np.ndarray] = []
            for part in bytekit.slices(table.to_batches()[0], "text"):
                hashes, bounds = shingle_sets(part.column("text"), rule.words)
                sets += [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            a, b, rest = [], [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo < 2:
                    continue
                side = left[lo:hi]
                found, component = links_within(sets[lo:hi], None if side.all() else side, rule)
                a += [fp[lo + i] for i, _ in found]
                b += [fp[lo + j] for _, j in found]
                if with_rest and tiles[lo] > 1:
                    home = component[np.flatnonzero(fp[lo:hi] == hub[lo])[0]]
                    rest += [(hub[lo], fp[lo + i]) for i in np.flatnonzero(component != home).tolist()]
            kind = [0] * len(a) + [1] * len(rest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(a + [x for x, _ in rest], pa.int64()), pa.array(b + [y for _, y in rest], pa.int64())],
                ["kind", "a", "b"],
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of ``a``-``b`` edges."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = small.where("a <> b").distinct().checkpoint()
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == state:
            break
        state = tuple(after)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def class_links(docs: DataFrame, common: np.ndarray, rule: Rule = RULE) -> DataFrame:
    """Links between classes, as fingerprints ``a`` and ``b``, that connect all linked classes."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text = docs.select("text")
    known = zstandard.compress(common.tobytes(), 3)
    dealt = text.mapInArrow(lambda batches: per_signature(batches, known, rule), "sig long, fp long").repartition("sig").sortWithinPartitions("sig", "fp")
    met = dealt.mapInArrow(meetings, "hub long, fp long").distinct().checkpoint()
    drop_shuffles(spark)
    needed = met.select("fp").unionByName(met.select(F.col("hub").alias("fp"))).distinct()
    texts = text.mapInArrow(lambda batches: per_text(batches, rule), "fp long, text string").join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
    texts = texts.checkpoint()
    drop_shuffles(spark)
    # hubs of several tiles; all others have one
    weight = met.join(texts.select("fp", F.octet_length("text").alias("bytes")), "fp").groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    large = weight.select("hub", tiles.alias("tiles")).where("tiles > 1").checkpoint()
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    members = met.join(large, "hub", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    members = members.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).select("hub", "fp", "tile", "tiles")
    # the hub stands in every tile
    every = members.select("hub", "tiles").distinct().select("hub", F.col("hub").alias("fp"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "tiles")
    placed = members.unionByName(every)
    order = ["hub", "tile"]
    ready = placed.join(texts, "fp").select("hub", "tile", "tiles", "fp", F.lit(True).alias("left"), "text")
    first = ready.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(tile_links(order, True, rule), "kind int, a long, b long").checkpoint()
    drop_shuffles(spark)
    edges = first.where("kind = 0").select("a", "b")
    rest = first.where("kind = 1").select(F.col("a").alias("hub"), F.col("b").alias("fp"))
    count = rest.groupBy("hub").agg(F.count(F.lit(1)).alias("rest")).join(large, "hub").checkpoint()
    if not count.isEmpty():
        # what did not connect to its hub meets the other tiles; it is cut into parts of a tile's size
        sized = F.broadcast(count) if count.count() <= BROADCAST_ROWS else count
        parts = rest.join(sized, "hub").withColumn("part", F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.least("tiles", F.ceil(F.col("rest") / TILE))).cast("int"))
        home = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        asks = parts.select("hub", "fp", "tiles", "part", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), home.alias("home"), F.lit(True).alias("left")).where("tile <> home").drop("home")
        used = parts.select("hub", "part").distinct()
        answers = members.where("tiles > 1").join(used, "hub").select("hub", "fp", "tiles", "part", "tile", F.lit(False).alias("left"))
        order = ["hub", "part", "tile"]
        ready = asks.unionByName(answers).groupBy(*order, "fp", "tiles").agg(F.max("left").alias("left")).join(texts, "fp")
        more = ready.select(*order, "tiles", "fp", "left", "text").repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(tile_links(order, False, rule), "kind int, a long, b long")
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def classified(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, n, fp, fp2) for each document, and of each class (n > 0) its ``component``,
    named by a member class, and ``component_id``, the least id in it."""
    ensure_checkpoint_dir(docs.sparkSession)
    both = docs.select("doc_id", "text").mapInArrow(lambda batches: per_document(batches, rule), ROWS).checkpoint()
    common = common_shingles(both)
    rows = both.where("block IS NULL").select("doc_id", "n", "fp", "fp2")
    classes = rows.where("n > 0").groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("rep"))
    labels = components(class_links(docs, common, rule))
    named = classes.join(labels, classes.fp == labels.node, "left").select("fp", "fp2", "n", "rep", F.coalesce("label", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows, named.join(ids, "component").select("fp", "fp2", "n", "component", "component_id")


def join(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    A null or wordless text has no shingles, links with nothing and is a component of its own. Rows
    that repeat are one class like any copies and come out once each. A null id takes part with its
    text; its component is null if no member has an id. Rows that share an id but no link are in
    components of their own. Very long texts are read whole. An empty table gives an empty result.
    Other columns are not read. Ties cannot arise, as a component has one least id. Sets are compared
    by 64-bit hashes of their shingles, classes by 128 bits.
    """
    rows, classes = classified(docs, rule)
    out = rows.where("n > 0").join(classes, ["fp", "fp2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def with_class(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytekit.slices(batch, "text"):
            hashes, bounds = shingle_sets(part.column("text"), rule.words)
            a, b = fingerprints(hashes, bounds)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a), pa.array(b)], ["doc_id", "text", "row", "fp", "fp2"])


def one_of_each(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One document of each component of ``docs``, with all its columns: the one with the least id.

    Where rows repeat an id, copies among them are one document (the row with the least hash stays)
    and texts without a link all stay. Of two linked texts of one id the class with the least
    fingerprint stays. Wordless rows stay, one for each id, and rows without an id all stay.
    """
    rows, classes = classified(docs, rule)
    wordy = rows.where("n > 0").join(classes, ["fp", "fp2", "n"]).where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min(F.struct("fp", "fp2")).alias("c")).select("doc_id", "c.fp", "c.fp2")
    bare = rows.where("n = 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2"))
    kept = wordy.unionByName(bare)
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id").checkpoint()
    named = docs.where("doc_id IS NOT NULL")
    if repeated.isEmpty():
        out = named.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    else:
        alone = kept.join(repeated, "doc_id", "left_anti").select("doc_id")
        again = named.join(repeated, "doc_id", "left_semi").select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        of_class = again.mapInArrow(lambda batches: with_class(batches, rule), T.StructType([*again.schema.fields, T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType())]))
        least = of_class.join(kept, ["doc_id", "fp", "fp2"], "left_semi").groupBy("doc_id", "fp", "fp2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = named.join(alone, "doc_id", "left_semi").select(*docs.columns).unionByName(least.select("row.*"))
    return out.unionByName(docs.where("doc_id IS NULL"))
