"""Periodic stretches of words: all maximal runs of each text, and the text without the repeats.

By the longest-previous-factor variant of Main's algorithm. A suffix array and common prefixes give, for
every word, the longest factor from there on that has begun before. The factors cut a text into
Lempel-Ziv blocks. A run that touches a border of two blocks is found there by extending both ways for
each possible period, and a run inside a block is a copy of one in the block's earlier occurrence, copied
with the runs bucketed by their beginnings.

A slice of many texts is worked on at once: a word is ranked with its row, so that no two rows ever share
a factor. Ranks of 2, 4, 8 ... words come by doubling; they make the suffix array and answer how far
two places agree, in either direction. A run of the least length repeats a certain number of words, so
rows in which no that many words come twice are done once the ranks have got that far.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from sessionloom.llm import bytekit

#: the least length of a run, and how many times it holds its period at least
LEAST, TIMES = 24, 3
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def repeats_at_least(least: int, times: int) -> int:
    """How many words of any run stand there a second time, one period later."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def doubled(rank: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Ranks of the 2 k words from each place on, from those of k words; a row's end comes first."""
    n = len(rank)
    at = np.arange(n) + k
    second = np.where(at < ends, rank[np.minimum(at, n - 1)] + 1, 0)
    return np.unique(rank * (n + 1) + second, return_inverse=True)[1]


def prefix_ranks(ids: np.ndarray, row: np.ndarray, bounds: np.ndarray, need: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of 1, 2, 4 ... words up to where all differ, of the words of those rows only in which some
    ``need`` words come twice; and which words those are. The last ranks are the suffix array's inverse."""
    kept = np.arange(len(ids))
    ends = bounds[1:][row]
    levels = [np.unique(row * (ids.max() + 1) + ids, return_inverse=True)[1]]
    k = 1
    while len(kept):
        rank = levels[-1]
        again = np.bincount(rank)[rank] > 1
        if k <= need:
            left = np.zeros(len(bounds) - 1, bool)
            left[row[again]] = True
            stay = left[row]
            if not stay.all():
                place = np.cumsum(stay)  # one past a kept word's new place
                kept, row, ends, again = kept[stay], row[stay], place[ends[stay] - 1], again[stay]
                levels = [np.unique(x[stay], return_inverse=True)[1] for x in levels]
        elif not again.any():
            break
        if len(kept):
            levels.append(doubled(levels[-1], ends, k))
            k *= 2
    return levels, kept


class Agreement:
    """How far two places of one row agree."""

    def __init__(self, levels: list[np.ndarray]):
        # one more place, that agrees with none
        self.levels = [np.append(x, -1) for x in levels]

    def onward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are equal from two different places on."""
        n, out = len(self.levels[0]) - 1, np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x = self.levels[k]
            out += (x[np.minimum(a + out, n)] == x[np.minimum(b + out, n)]).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are equal up to two different places, these included; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, back = self.levels[k], out + (1 << k) - 1
            same = (a >= back) & (x[np.maximum(a - back, 0)] == x[np.maximum(b - back, 0)])
            out += same.astype(np.int64) << k
        return out


def previous_factors(inverse: np.ndarray, agree: Agreement) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the longest factor from there on that has begun before, and where.

    It is shared with one of two neighbours in the suffix array: the nearest on either side that
    begin earlier in the text.
    """
    n = len(inverse)
    order = np.empty(n, np.int64)
    order[inverse] = np.arange(n)
    above, below, open_ = [-1] * n, [-1] * n, []
    for at in order.tolist():
        while open_ and open_[-1] > at:
            below[open_.pop()] = at
        if open_:
            above[at] = open_[-1]
        open_.append(at)
    here, best, where = np.arange(n), np.zeros(n, np.int64), np.full(n, -1)
    for side in (np.array(above), np.array(below)):
        size = np.where(side >= 0, agree.onward(here, np.maximum(side, 0)), 0)
        size[side == here] = 0
        more = size > best
        best[more], where[more] = size[more], side[more]
    return best, where


def blocks(factors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of the Lempel-Ziv blocks of all rows and how many each row has, its end included."""
    step, out, count = np.maximum(factors, 1).tolist(), [], []
    for first, end in zip(bounds.tolist(), bounds[1:].tolist()):
        before = len(out)
        while first < end:
            out.append(first)
            first += step[first]
        out.append(end)
        count.append(len(out) - before)
    return np.array(out, np.int64), np.array(count, np.int64)


def counted(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an index i and a number from 1 to most[i]."""
    which = np.repeat(np.arange(len(most)), most)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1


def at_borders(begins: np.ndarray, last: np.ndarray, rows: np.ndarray, agree: Agreement, least: int, times: int) -> np.ndarray:
    """Runs that hold or touch a border: (start, end, period), once each with its smallest period.

    ``begins``: the borders, ``last``: which of them is a row's end, ``rows``: their rows' beginnings.
    At the last border that a run reaches, either the period fits into the part before it, and into the
    two blocks there together, or into the block behind it. A share of those blocks is all that is tried.
    """
    size = np.where(last, 0, np.append(begins[1:], 0) - begins)
    before = np.where(begins > rows, begins - np.append(0, begins[:-1]), 0)
    need = repeats_at_least(least, times)
    found = []
    left = np.where(size + before >= need, np.minimum((size + before) // (times - 1), begins - rows), 0)
    which, period = counted(left)
    at = begins[which]
    ahead = np.where(last[which], 0, agree.onward(at - period, at))
    behind = np.where(at - period > rows[which], agree.backward(at - period - 1, at - 1), 0)
    found.append((at - period - behind, at + ahead, period))
    which, period = counted(np.where(size >= need, size // (times - 1), 0))
    at = begins[which]
    ahead = agree.onward(at, at + period)
    behind = np.where(at > rows[which], agree.backward(at - 1, at + period - 1), 0)
    found.append((at - behind, at + period + ahead, period))
    start, end, period = (np.concatenate(x) for x in zip(*found))
    enough = end - start >= np.maximum(least, times * period)
    runs = np.stack([start, end, period], 1)[enough]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def copied(runs: list[tuple[int, int, int]], begins: list[int], sizes: list[int], sources: list[int], least: int) -> list[tuple[int, int, int]]:
    """``runs`` of a row in order, and those strictly inside of blocks, which are copies of runs inside
    the blocks' sources. A source may reach into its own block; its copies are found in their turn."""
    for first, size, source in zip(begins, sizes, sources):
        if size < least + 2:
            continue
        i = bisect_right(runs, (source + 1,))
        while i < len(runs) and runs[i][0] < source + size - 1:
            start, end, period = runs[i]
            if end < source + size:
                insort(runs, (start + first - source, end + first - source, period))
            i += 1
    return runs


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """By row, its runs as (start, length, period) by start and period; rows without any are left out.

    ``ids``: the words of all rows as numbers, ``bounds``: where each row begins. A run is a stretch of
    ``least`` words and ``times`` periods at least that no neighbour extends.
    """
    if times < 2:
        raise ValueError("a run holds its period twice at least")
    if not len(ids):
        return {}
    row = bytekit.row_of(bounds)
    levels, kept = prefix_ranks(ids, row, bounds, repeats_at_least(least, times))
    if not len(kept):
        return {}
    numbers, sizes = np.unique(row[kept], return_counts=True)
    inner = np.append(0, np.cumsum(sizes))
    agree = Agreement(levels)
    factors, sources = previous_factors(levels[-1], agree)
    begins, count = blocks(factors, inner)
    last = np.zeros(len(begins), bool)
    last[np.cumsum(count) - 1] = True
    found = at_borders(begins, last, np.repeat(inner[:-1], count), agree, least, times)
    of_row = np.searchsorted(inner, found[:, 0], side="right") - 1
    out, edge, block = {}, np.searchsorted(of_row, np.arange(len(numbers) + 1)), np.append(0, np.cumsum(count))
    for i, number in enumerate(numbers.tolist()):
        runs = [tuple(x) for x in found[edge[i] : edge[i + 1]].tolist()]
        if runs:
            own = begins[block[i] : block[i + 1] - 1]
            size = np.diff(begins[block[i] : block[i + 1]])
            runs = copied(runs, own.tolist(), np.where(factors[own] > 0, size, 0).tolist(), sources[own].tolist(), least)
            out[number] = sorted((s - int(inner[i]), e - s, p) for s, e, p in runs)
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept words of each row, joined by one space."""
    starts, size, row = starts[keep], (ends - starts)[keep], row[keep]
    lead = np.zeros(len(row), np.int64)
    lead[1:] = row[1:] == row[:-1]
    put = np.cumsum(size + lead) - size
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    total = int((size + lead).sum())
    out = np.full(total, 0x20, np.uint8)
    out[np.repeat(put, size) + inside] = data[np.repeat(starts, size) + inside]
    offsets = np.append(0, np.cumsum(np.bincount(row, size + lead, rows).astype(np.int64)))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def scanner(text: str, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch, text):
                data, offsets = bytekit.flat(part.column(text))
                starts, ends = bytekit.words(~bytekit.SPACE[data], offsets)
                bounds = bytekit.row_bounds(starts, offsets)
                row = bytekit.row_of(bounds)
                found = find_runs(bytekit.distinct_spans(data, starts, ends)[1], bounds, least, times)
                repeats = np.zeros(len(starts) + 1, np.int64)
                for r, runs in found.items():
                    for start, length, period in runs:
                        repeats[bounds[r] + start + period] += 1
                        repeats[bounds[r] + start + length] -= 1
                keep = np.cumsum(repeats[:-1]) == 0
                lists = [[dict(zip(("start", "length", "period"), x)) for x in found.get(r, ())] for r in range(part.num_rows)]
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                added = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(lists, kind), joined(data, starts, ends, row, keep, part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *[f.name for f in ADDED]])

    return run


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``runs`` (array of start, length, period, by start and period) and
    ``collapsed``: the words outside of every run's repeats, joined by one space.

    Words are what white space of ASCII parts; they are compared byte by byte. A word is a repeat if a
    run holds it behind the run's first period. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Other columns are passed through, but for three of those names, which give way; rows
    that repeat come back each time; an empty table gives an empty result. Texts are read whole: the
    longest one takes about 8 bytes a word for each doubling of its longest repeat, and some 100 besides.
    """
    names = [f.name for f in ADDED]
    plain = docs.select(*[c for c in docs.columns if c.lower() not in names])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema] + ADDED)
    return plain.mapInArrow(scanner(text, least, times), schema)
