"""Byte-level BPE encoding and decoding in padded numpy matrices.

The distinct pre-tokens of a slice are put into matrices by length, one word a row. In each
round every row merges its leftmost pair of least rank; ranks are looked up in a hash table of
symbol pairs, and the row is closed up. Rows without a ranked pair leave the matrix. A word of more
than ``WIDEST`` bytes has a matrix to itself, whose rows are its pieces, so that closing up after a
merge moves one piece and not the word.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm import bytekit, pretoken

NONE = np.int32(1 << 30)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48, 128, 256, 512, 1024)
WIDEST = WIDTHS[-1]
#: words that a worker remembers, and the longest of them in bytes
CACHE, LONG = 300_000, 64


class Vocabulary:
    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.token = {i: t for t, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        # a pair's rank is the symbol it makes, so several pairs can have one rank
        pairs = np.array(made, np.uint64).reshape(-1, 3)
        self.bits = max(10, int(len(made) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, EMPTY), np.full(size, NONE, np.int32)
        keys = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == EMPTY]
            taken, once = np.unique(slot[free], return_index=True)
            put = free[once]
            self.keys[taken] = keys[put]
            self.values[taken] = pairs[put, 2].astype(np.int32)
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)
        self.cache: dict[bytes, tuple[int, str, bytes, bytes]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none (a negative symbol has none)."""
        none = (left < 0) | (right < 0)
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.values[slot], NONE)
        more = np.flatnonzero((got != keys) & (got != EMPTY) & ~none)
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[more]]
            hit = got == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (got != EMPTY)]
        out[none] = NONE
        return out

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """The final symbols of each row of a matrix that is padded with -1."""
        n, width = ids.shape
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        row = np.arange(n)
        rank = np.full((n, max(1, width)), NONE, np.int32)
        if width > 1:
            rank[:, : width - 1] = self.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                ended = ids[done]
                for r, i, k in zip(row[done].tolist(), ended, (ended >= 0).sum(1).tolist()):
                    out[r] = i[:k]
                going = ~done
                ids, rank, row, at, best = ids[going], rank[going], row[going], at[going], best[going]
            if not len(row):
                return out
            here = np.arange(len(row))
            width = ids.shape[1]
            columns = np.arange(width - 1)
            # close up what follows the merged pair
            ids[here, at] = best
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), 1)
            nxt = np.where(at + 1 < width - 1, ids[here, np.minimum(at + 1, width - 2)], -1)
            rank[here, at] = self.look(ids[here, at], nxt)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.look(ids[inner, at[inner] - 1], ids[inner, at[inner]])

    def merge_pieces(self, word: bytes) -> np.ndarray:
        """The final symbols of one long word: a matrix of its pieces, merged as one row would be.

        ``rank[p, j]`` is the rank of symbol j of piece p with the symbol after it, which for a
        piece's last symbol is the first of the next piece that has any.
        """
        n, width = len(word), int(len(word) ** 0.5) + 1
        pieces = -(-n // width)
        ids, rank = np.full(pieces * width, -1, np.int32), np.full(pieces * width, NONE, np.int32)
        ids[:n] = self.first[np.frombuffer(word, np.uint8)]
        rank[: n - 1] = self.look(ids[: n - 1], ids[1:n])
        ids, rank = ids.reshape(pieces, width), rank.reshape(pieces, width)
        size = np.minimum(width, n - width * np.arange(pieces)).tolist()
        after, before = [*range(1, pieces), -1], list(range(-1, pieces - 1))
        least = rank.min(1)

        def close(p: int, j: int) -> None:
            """Take symbol j out of piece p."""
            k = size[p] = size[p] - 1
            ids[p, j:k], rank[p, j:k] = ids[p, j + 1 : k + 1].copy(), rank[p, j + 1 : k + 1].copy()
            ids[p, k], rank[p, k] = -1, NONE
            if not k:
                a, b = before[p], after[p]
                if a >= 0:
                    after[a] = b
                if b >= 0:
                    before[b] = a

        while True:
            p = int(least.argmin())
            best = least[p]
            if best == NONE:
                return ids[ids >= 0]
            j = int(rank[p].argmin())
            ids[p, j] = best
            q = after[p]
            if j + 1 < size[p]:
                close(p, j + 1)
            else:
                close(q, 0)
                least[q] = rank[q].min()
                q = after[p]
            following = ids[p, j + 1] if j + 1 < size[p] else ids[q, 0] if q >= 0 else -1
            r, i = (p, j - 1) if j else (before[p], size[before[p]] - 1)
            now = self.look(np.array([best, ids[r, i] if r >= 0 else -1]), np.array([following, best]))
            rank[p, j] = now[0]
            if r >= 0:
                rank[r, i] = now[1]
                least[r] = rank[r].min()
            least[p] = rank[p].min()

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            out[i] = self.merge_pieces(words[i])
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if not len(rows):
                continue
            buffer = b"".join(words[i].ljust(width, b"\0") for i in rows.tolist())
            ids = self.first[np.frombuffer(buffer, np.uint8)].reshape(len(rows), width)
            ids[np.arange(width) >= lengths[rows][:, None]] = -1
            for i, got in zip(rows.tolist(), self.merge_rows(ids)):
                out[i] = got
        return out

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


_known: dict[int, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    key = crc32(raw)
    if key not in _known:
        _known[key] = Vocabulary(raw)
    return _known[key]


def encode_slice(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, list[list[tuple[int, str, bytes, bytes]]], np.ndarray]:
    """The number of ids of each pre-token; each text's pre-tokens as (number of ids, ids as text,
    decoded bytes, ids as 32-bit numbers); and each text's number of ids."""
    data, offsets = bytekit.flat(column)
    starts, ends = pretoken.spans(data, offsets)
    where, inverse = bytekit.distinct_spans(data, starts, ends)
    cache = vocab.cache
    text = data.tobytes()
    words = [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
    found = [cache.get(w) for w in words]
    missing = [i for i, x in enumerate(found) if x is None]
    if missing:
        room = CACHE - len(cache)
        for i, ids in zip(missing, vocab.encode_words([words[i] for i in missing])):
            packed, ids = ids.astype(np.int32).tobytes(), ids.tolist()
            found[i] = (len(ids), ",".join(map(str, ids)), vocab.decode(ids), packed)
            if room > 0 and len(words[i]) <= LONG:
                cache[words[i]] = found[i]
                room -= 1
    each = np.array([x[0] for x in found], np.int64)[inverse] if len(found) else np.zeros(0, np.int64)
    total = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=total[1:])
    bounds = bytekit.row_bounds(starts, offsets)
    pool = inverse.tolist()
    edges = bounds.tolist()
    return each, [[found[i] for i in pool[a:b]] for a, b in zip(edges, edges[1:])], np.diff(total[bounds])


def encoder(raw: bytes, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(raw)
        for batch in batches:
            for part in bytekit.slices(batch, "text"):
                _, texts, n = encode_slice(part.column("text"), vocab)
                decoded = [b"".join([w[2] for w in t]) for t in texts]
                columns = [*part.columns, pa.array(n)]
                names = [*part.schema.names, "n_tokens"]
                if with_ids:
                    ids = np.frombuffer(b"".join([w[3] for t in texts for w in t]), np.int32)
                    edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                else:
                    joined = [",".join([w[1] for w in t]) for t in texts]
                    columns += [pa.array([sha256(j.encode()).hexdigest() for j in joined]), pa.array([sha256(d).hexdigest() for d in decoded])]
                    names += ["ids_sha256", "decoded_sha256"]
                    keep = [i for i, c in enumerate(names) if c != "text"]
                    columns, names = [columns[i] for i in keep], [names[i] for i in keep]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """All rows of ``docs`` (as ``doc_id``, ``text``) with ``n_tokens``, ``ids`` (array<int>)
    and ``decoded`` (binary), the bytes that the ids stand for.

    ``ranks`` is the path of a rank file, read by the driver. Null and empty texts have no ids;
    repeated rows give repeated rows; an empty table an empty result; null ``doc_id`` stays
    null; other columns are not read. No special token is recognised. Long texts and long words are
    encoded whole. Words are told apart by their bytes.
    """
    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(encoder(_read(ranks), True), "doc_id long, text string, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids (decimal, joined by commas) and of the
    decoded bytes. Nulls and other odd rows are as in ``encode``."""
    return docs.select("doc_id", "text").mapInArrow(encoder(_read(ranks), False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
