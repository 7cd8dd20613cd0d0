"""Byte-pair merging with a heap over a linked list of symbols, and token counts by it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm import bytekit, pretoken

#: words that a worker remembers, and the longest of them in bytes
CACHE, LONG = 1 << 20, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Ranks of adjacent symbol pairs: ``rank[left << 32 | right]`` and the symbol they make."""

    def __init__(self, first: list[int], pairs: list[tuple[int, int, int]]):
        self.first = first
        self.rank = {left << 32 | right: i for i, (left, right, _) in reversed(list(enumerate(pairs)))}
        self.made = [made for _, _, made in pairs]

    @classmethod
    def of_json(cls, raw: bytes) -> Merges:
        model = json.loads(raw)["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return cls([ids[s] for s in byte_symbols()], [(ids[a], ids[b], ids[a + b]) for a, b in pairs])

    def merge(self, word: bytes) -> list[int]:
        """The symbols that remain of a word once no adjacent pair has a rank."""
        first, rank, made = self.first, self.rank, self.made
        symbol = [first[b] for b in word]
        n = len(symbol)
        if n < 2:
            return symbol
        ranks = [rank.get(a << 32 | b, -1) for a, b in zip(symbol, symbol[1:])]
        ranks.append(-1)
        bits = n.bit_length()
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return symbol
        heapify(heap)
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> bits
            if ranks[i] != r:
                continue  # an entry for a pair that has gone
            j = after[i]
            symbol[i] = made[r]
            symbol[j] = -1
            ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = new = rank.get(symbol[i] << 32 | symbol[k], -1)
                if new >= 0:
                    heappush(heap, new << bits | i)
            else:
                ranks[i] = -1
            p = before[i]
            if p >= 0:
                ranks[p] = new = rank.get(symbol[p] << 32 | symbol[i], -1)
                if new >= 0:
                    heappush(heap, new << bits | p)
        return [s for s in symbol if s >= 0]

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges."""
        first, rank, made = self.first, self.rank, self.made
        n = len(word)
        if n < 2:
            return n
        symbol = [first[b] for b in word]
        get = rank.get
        ranks = [get(a << 32 | b, -1) for a, b in zip(symbol, symbol[1:])]
        ranks.append(-1)
        bits = n.bit_length()
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> bits
            if ranks[i] != r:
                continue
            merges += 1
            j = after[i]
            symbol[i] = now = made[r]
            ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = new = get(now << 32 | symbol[k], -1)
                if new >= 0:
                    heappush(heap, new << bits | i)
            else:
                ranks[i] = -1
            p = before[i]
            if p >= 0:
                ranks[p] = new = get(symbol[p] << 32 | now, -1)
                if new >= 0:
                    heappush(heap, new << bits | p)
        return n - merges


_known: dict[int, tuple[Merges, dict[bytes, int], bytes]] = {}


def _tokenizer(raw: bytes) -> tuple[Merges, dict[bytes, int], bytes]:
    """The merges, a cache of counts by word, and the special string; kept by the worker."""
    key = crc32(raw)
    if key not in _known:
        specials = [t["content"].encode() for t in json.loads(raw).get("added_tokens", [])]
        if len(specials) > 1:
            raise ValueError("vocabularies with one added token at most are supported")
        _known[key] = (Merges.of_json(raw), {}, specials[0] if specials else b"")
    return _known[key]


def count_slice(column: pa.Array, raw: bytes) -> np.ndarray:
    """Tokens of each text of a string column."""
    merges, cache, special = _tokenizer(raw)
    data, offsets = bytekit.flat(column)
    cuts, marks = offsets, np.zeros(0, np.int64)
    if special:
        cuts, marks = pretoken.with_cuts(data, offsets, special)
    starts, ends = pretoken.spans(data, cuts)
    where, inverse = bytekit.distinct_spans(data, starts, ends)
    if len(cache) + len(where) > CACHE:
        cache.clear()
    counts = np.empty(len(where), np.int64)
    text = data.tobytes()
    for i, (a, b) in enumerate(zip(starts[where].tolist(), ends[where].tolist())):
        word = text[a:b]
        n = cache.get(word)
        if n is None:
            n = merges.count(word)
            if b - a <= LONG:
                cache[word] = n
        counts[i] = n
    each = counts[inverse]
    for mark in marks.tolist():  # a special string is one token, whatever its pieces
        lo, hi = np.searchsorted(starts, [mark, mark + len(special)])
        each[lo:hi] = 0
        each[lo] = 1
    total = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=total[1:])
    return np.diff(total[bytekit.row_bounds(starts, offsets)])


def counter(raw: bytes, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch, "text"):
                column = part.column("text")
                n = count_slice(column, raw)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bytekit.flat(column)[1])), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE vocabulary in JSON; the driver reads it and
    its bytes (their size is that of the file) go to the executors with the task. The added
    token's string counts as one token inside a text, as the vocabulary's library has it.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; an empty
    table an empty result; null ``doc_id`` stays null; other columns are not read. Long texts
    and long words are merged whole, in n log n steps. Words are told apart by their bytes.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    return docs.select("doc_id", "text").mapInArrow(counter(raw, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
