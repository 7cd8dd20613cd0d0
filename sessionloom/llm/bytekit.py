"""Vectorised text kernels over the UTF-8 bytes of Arrow string columns.

Every kernel works on one slice of a batch: the concatenated bytes of its rows and the row
offsets. Slices are cut by bytes (``slices``), so memory does not follow the row count, and a
row is never split, so whole texts are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    sizes = np.diff(flat(batch.column(text))[1])
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


#: the low 0 .. 8 bytes of a word of 64 bits
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LENGTH = np.uint64(0xD1B54A32D192ED03)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def tails(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of over eight bytes, and their blocks of eight behind the first: where each span's
    blocks begin, and each block's number in its span, position and bytes inside the span."""
    long = np.flatnonzero(sizes > 8)
    blocks = (sizes[long] - 1) >> 3
    first = np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks) + 1
    at = np.repeat(starts[long], blocks) + 8 * number
    inside = np.minimum(np.repeat(sizes[long], blocks) - 8 * number, 8)
    return long, first, number, np.stack([at, inside])


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes.

    Blocks of eight bytes are keyed by their number in the span and mixed before they are added, so
    the hash is not linear in the bytes. Spans of equal length up to eight bytes never share one.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    eight = eights(data)
    out = mix((eight[starts] & MASK[np.minimum(sizes, 8)]) ^ PRIME)
    long, first, number, (at, inside) = tails(starts, sizes)
    if len(long):
        out[long] += np.add.reduceat(mix((eight[at] & MASK[inside]) ^ mix(number.astype(np.uint64) * PRIME)), first)
    return mix(out + sizes.astype(np.uint64) * LENGTH)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each byte string, and for each span the number of its string.

    Spans are brought together by hash and compared byte by byte with the one they stand for.
    """
    _, where, inverse = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    if not len(starts):
        return where, inverse
    sizes, eight = ends - starts, eights(data)
    other = starts[where][inverse]
    cut = MASK[np.minimum(sizes, 8)]
    same = (sizes[where][inverse] == sizes) & (eight[starts] & cut == eight[other] & cut)
    long, first, number, (at, inside) = tails(starts, np.where(same, sizes, 0))
    if len(long):
        shift = np.repeat((other - starts)[long], np.diff(np.append(first, len(number))))
        same[long] &= np.logical_and.reduceat(eight[at] & MASK[inside] == eight[at + shift] & MASK[inside], first)
    if not same.all():  # two strings of one hash
        raw, more, known = data.tobytes(), [], {}
        for i in np.flatnonzero(~same).tolist():
            key = raw[starts[i] : ends[i]]
            if key not in known:
                known[key] = len(where) + len(more)
                more.append(i)
            inverse[i] = known[key]
        where = np.append(where, more)
    return where, inverse


def words(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; a row boundary ends a run."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return starts, ends


def row_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, where its spans begin among ``starts``; one more entry closes the last row."""
    return np.searchsorted(starts, offsets)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each span."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
