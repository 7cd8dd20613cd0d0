"""Phrase collocations by position bitmaps that are shifted, intersected and counted.

Texts are packed into stored shards: the distinct words of a shard, and the word at each of its positions.
A position is left free between two pieces of text and for a word that is rare everywhere, so no phrase
crosses one. In a shard every word has
a bitmap of its positions, compressed to its non-empty blocks of ``BITS`` positions. The bitmap of a phrase's
ends, shifted by one position and intersected with a word's bitmap, is that of the phrase with the
word behind it, and its bits are its occurrences. Phrases are extended depth-first, some first words
at a time, so that a task holds the bitmaps of few of them. Counts are summed over the shards.

Phrases of one more word are counted in each round. A phrase is only as frequent as its parts, so only
ends of phrases that are frequent over all shards are kept before the last extension. Every shard
learns which those are from a sieve of fixed size. A round (but the last) counts hashes first, sent as
compressed sorted differences, which makes the sieve of its phrases; then the phrases that pass it are
counted as they are written, so what a sieve lets through besides is found rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from sessionloom.llm import bytekit
from sessionloom.session import drop_shuffles, ensure_checkpoint_dir

#: words of the longest phrase, the least occurrences of a phrase, phrases kept of each language
LONGEST, LEAST, TOP = 4, 30, 2000
#: a phrase goes if one that holds it has this share (percent) of its occurrences
COVERED = 80
#: text of a shard, positions of a block, blocks of bitmaps that are extended at once
SHARD_BYTES, BITS, AT_ONCE = 1 << 20, 16, 1 << 15
#: bits of the sieve, as a power of two, and of the blocks in which it is put together
SIEVE_BITS, SIEVE_BLOCK = 26, 1 << 20
#: bits of a hash that are sent (more are to be, if the different phrases number billions), hashes that a task
#: holds before it sends them, shards for each range of hashes
HASH_BITS, HELD, SHARDS_A_RANGE = 32, 1 << 22, 8
#: parts into which a language's phrases are dealt before they are ranked
SALTS = 32

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~BREAK
WORD[[0x20, 9]] = False
STEP = np.uint64(0x9FB21C651E98DF25)


SHARD = "langs array<string>, totals array<long>, n int, of binary, words binary, size int, at binary"


def packer(sieve: bytes | None = None):
    """Texts to shards: the ``langs`` and their words in all (``totals``); ``n`` different words with a space
    behind each (``words``), most frequent first, and the number of each one's language (``of``); and for
    ``size`` positions the number of the word there, from 1 on, 0 where none is (``at``). Words that do not
    pass the sieve are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch, "text", SHARD_BYTES):
                data, offsets = bytekit.flat(part.column("text"))
                data = bytekit.LOWER[data]
                starts, ends = bytekit.words(WORD[data], offsets)
                if not len(starts):
                    continue
                row = bytekit.row_of(bytekit.row_bounds(starts, offsets))
                piece = np.cumsum(BREAK[data])[starts]
                apart = np.zeros(len(starts), np.int64)
                apart[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
                where, word = bytekit.distinct_spans(data, starts, ends)
                lang = part.column("lang").dictionary_encode()
                code = lang.indices.to_numpy()[row].astype(np.int64)
                pairs, first, number, count = np.unique(code * len(where) + word, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")
                of, first = pairs[order] // len(where), first[order]
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                new = np.empty(len(order), np.int64)
                new[order] = np.arange(1, len(order) + 1)
                if sieve is not None:
                    plain = pa.array(words, pa.binary()).cast(pa.string())
                    good = passes(np.frombuffer(sieve, np.uint8), word_hashes(lang.dictionary.take(pa.array(of)), plain))
                    new = np.where(good, np.cumsum(good), 0)[new - 1]
                    of, words = of[good], [w for w, g in zip(words, good.tolist()) if g]
                place = np.arange(len(starts)) + np.cumsum(apart)
                at = np.zeros(place[-1] + 1, np.int64)
                at[place] = new[number]
                cells = [lang.dictionary.to_pylist(), np.bincount(code, minlength=len(lang.dictionary)).tolist(), len(words), squeezed(of), b"".join([w + b" " for w in words]), len(at), squeezed(at)]
                types = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, types)], ["langs", "totals", "n", "of", "words", "size", "at"])

    return run


def unpacked(batch: pa.RecordBatch, r: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """A shard's words with their languages, side by side, and its word numbers by position, -1 where none is."""
    n, of, words, size, at = (batch.column(c)[r].as_py() for c in ("n", "of", "words", "size", "at"))
    data = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero(data == 0x20) - np.arange(n)
    plain = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[data != 0x20]))
    return batch.column("langs")[r].values.take(pa.array(expanded(of, n))), plain, expanded(at, size) - 1


def string_hashes(strings: pa.Array) -> np.ndarray:
    data, offsets = bytekit.flat(strings)
    return bytekit.span_hash(data, offsets[:-1], offsets[1:])


def word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """Hashes of words with their languages; equal in all shards."""
    return bytekit.mix(string_hashes(words) + STEP * string_hashes(langs))


def phrase_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, from those of their first words, second words and so on."""
    out = parts[0]
    for more in parts[1:]:
        out = bytekit.mix(out * STEP + more)
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """Small numbers of 32 bits, compressed by their bytes' places."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def expanded(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts or ``most``."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][first], np.minimum(np.add.reduceat(counts[order], first), most) if len(first) else counts


SENT = "range int, n int, hashes binary, counts binary"


def sender(size: int, sieves: list[bytes], least: int, ranges: int):
    """Shards to hashes of their phrases of ``size`` words with their counts (``least`` at most), cut at
    the bounds of ``ranges``."""

    def sent(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        of = keys * ranges >> HASH_BITS
        edges = np.searchsorted(of, np.arange(ranges + 1))
        rows: list[tuple] = []
        for r, a, b in zip(range(ranges), edges.tolist(), edges[1:].tolist()):
            if a < b:
                # a range spans fewer than 2^32 hashes; the first difference is from its lower bound
                rows.append((r, b - a, squeezed(np.diff(keys[a:b], prepend=-(-(r << HASH_BITS) // ranges))), squeezed(counts[a:b])))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "n", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, np.uint8) for x in sieves]
        held: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                langs, words, at = unpacked(batch, r)
                hashes = word_hashes(langs, words)
                for rows, count in phrases_of(at, hashes, size, bits):
                    held.append(((phrase_hashes([hashes[rows[:, i]] for i in range(size)]) >> np.uint64(64 - HASH_BITS)).astype(np.int64), count))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)), least)]
                    if len(held[0][0]) > HELD // 2:
                        yield sent(*held.pop())
        if held:
            yield sent(*summed(*(np.concatenate(x) for x in zip(*held)), least))

    return run


def adder(least: int, ranges: int):
    """The part of the sieve that a range's frequent hashes make, in blocks of packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple] = []
        for batch in batches:
            for r, n, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "n", "hashes", "counts"))):
                waiting.append((np.cumsum(expanded(hashes, n)) + -(-(r << HASH_BITS) // ranges), expanded(counts, n)))
            if sum(len(k) for k, _ in waiting) > HELD:
                total = summed(*(np.concatenate(x) for x in zip(total, *waiting)), least)
                waiting = []
        keys, counts = summed(*(np.concatenate(x) for x in zip(total, *waiting)), least)
        at = np.unique(keys[counts >= least] >> (HASH_BITS - SIEVE_BITS))
        for block in np.unique(at // SIEVE_BLOCK).tolist():
            bits = np.zeros(SIEVE_BLOCK, bool)
            bits[at[at // SIEVE_BLOCK == block] % SIEVE_BLOCK] = True
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    return run


def either(table: pa.Table) -> pa.Table:
    out = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([out.tobytes()], pa.binary())})


def sieve_of(shards: DataFrame, size: int, sieves: list[bytes], least: int, ranges: int) -> bytes:
    """The sieve of the phrases of ``size`` words that occur ``least`` times over all shards, whatever
    their number: ``SIEVE_BITS`` says its size."""
    return gathered(shards.mapInArrow(sender(size, sieves, least, ranges), SENT), least, ranges)


def ranges_for(n: int) -> int:
    """A power of two, so that ranges are of equal size."""
    return 1 << max(8, n.bit_length())


def gathered(sent: DataFrame, least: int, ranges: int) -> bytes:
    parts = sent.groupBy("range").applyInArrow(adder(least, ranges), "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary")
    out = np.zeros(((1 << SIEVE_BITS) // SIEVE_BLOCK, SIEVE_BLOCK // 8), np.uint8)
    for r in parts.collect():  # one row for each block of the sieve
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - SIEVE_BITS)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Bitmaps:
    """The bitmaps of the words that end at the marked positions: for each block its words' masks."""

    def __init__(self, at: np.ndarray, marked: np.ndarray, words: int):
        place = np.flatnonzero(marked)
        key = (place // BITS) * words + at[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        bits = np.left_shift(1, place[order] % BITS).astype(np.uint16)
        self.mask = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        self.block, self.word = key[first] // words, key[first] % words
        self.bounds = np.searchsorted(self.block, np.arange(len(at) // BITS + 2))


def shifted(phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, blocks: int) -> tuple[np.ndarray, ...]:
    """Bitmaps moved on by one position; what leaves a block enters the next."""
    wide = mask.astype(np.uint32) << 1
    stay, leave = (wide & ((1 << BITS) - 1)).astype(np.uint16), (wide >> BITS).astype(np.uint16)
    here, on = stay != 0, (leave != 0) & (block + 1 < blocks)
    return np.append(phrase[here], phrase[on]), np.append(block[here], block[on] + 1), np.append(stay[here], leave[on])


def extended(prefix: np.ndarray, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, words: Bitmaps, known: int) -> tuple[np.ndarray, ...]:
    """All phrases by one word more that occur: their words, and as (phrase, block, mask) their bitmaps.

    ``prefix``: a row of word numbers for each phrase; ``known``: how many words there are.
    """
    phrase, block, mask = shifted(phrase, block, mask, len(words.bounds) - 1)
    found: list[tuple] = []
    for i in range(0, len(phrase), AT_ONCE):
        p, b, m = phrase[i : i + AT_ONCE], block[i : i + AT_ONCE], mask[i : i + AT_ONCE]
        first, count = words.bounds[b], words.bounds[b + 1] - words.bounds[b]
        which = np.repeat(np.arange(len(p)), count)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - first, count)
        both = m[which] & words.mask[entry]
        some = np.flatnonzero(both)
        found.append((p[which[some]] * known + words.word[entry[some]], b[which[some]], both[some]))
    if not found:
        return np.zeros((0, prefix.shape[1] + 1), np.int64), phrase, block, mask
    key, block, mask = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(key, kind="stable")
    distinct, number = np.unique(key[order], return_inverse=True)
    return np.column_stack([prefix[distinct // known], distinct % known]), number, block[order], mask[order]


def occurrences(phrase: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The bits of each phrase's bitmap; phrases are in order, and each has some."""
    first = np.flatnonzero(np.diff(phrase, prepend=-1))
    return np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def phrases_of(at: np.ndarray, hashes: np.ndarray, size: int, sieves: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The phrases of ``size`` words of a shard whose parts pass the sieves, a few first words at a time:
    their words' numbers, a row each, and how often they occur.

    ``sieves``: of one word, two words and so on; with one of ``size`` words, the phrases pass that, too.
    """
    known = len(hashes)
    if not known:
        return
    own = np.where(at >= 0, hashes[at], 0)
    # ends[j]: whether a phrase of j + 1 words that passes ends at a position; the first words are hashed first
    ends, whole = [], at >= 0
    for j, sieve in enumerate(sieves):
        if j:
            whole = np.append(False, whole[:-1]) & (at >= 0)
        value = phrase_hashes([np.append(np.zeros(j - i, np.uint64), own[: len(own) - (j - i)]) for i in range(j + 1)])
        ends.append(whole & passes(sieve, value) & (ends[-1] if ends else True))
    marked = ends if len(ends) == size else [*ends, ends[-1] if ends else at >= 0]
    first = Bitmaps(at, marked[0], known)
    levels = [Bitmaps(at, marked[j], known) for j in range(1, size)]
    order = np.argsort(first.word, kind="stable")
    word, block, mask = first.word[order], first.block[order], first.mask[order]
    edges = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
    i = 0
    while i < len(edges) - 1:
        # first words whose bitmaps have so many blocks together, or one of more
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + AT_ONCE, side="right")) - 1)
        here = slice(edges[i], edges[j])
        phrase = np.repeat(np.arange(j - i), np.diff(edges[i : j + 1]))
        state = (word[edges[i:j]][:, None], phrase, block[here], mask[here])
        for level in levels:
            state = extended(*state, level, known)
        if len(state[0]):
            yield state[0], occurrences(state[1], state[3])
        i = j


def counter(size: int, sieves: list[bytes]):
    """Shards to rows of ``lang``, ``phrase``, ``n``: the phrases of ``size`` words that pass the sieves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, np.uint8) for x in sieves]
        names = ["lang", "phrase", "n"]
        for batch in batches:
            for r in range(batch.num_rows):
                langs, words, at = unpacked(batch, r)
                for rows, count in phrases_of(at, word_hashes(langs, words), size, bits):
                    each = [words.take(pa.array(rows[:, i])) for i in range(size)]
                    phrase = pc.binary_join_element_wise(*each, " ") if size > 1 else each[0]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows[:, 0])), phrase, pa.array(count)], names)

    return run


def frequent(docs: DataFrame, text: str, lang: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times in their language (``lang``,
    ``phrase``, ``size``, ``f``), and the words of each language (``lang``, ``n``)."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/shards-{uuid4().hex}"
    plain = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tasks = plain.select(F.spark_partition_id()).distinct().count()
    every, send = packer(), sender(1, [], least, ranges_for(tasks))
    sieves, tables = [gathered(plain.mapInArrow(lambda batches: send(every(batches)), SENT), least, ranges_for(tasks))], []
    plain.mapInArrow(packer(sieves[0]), SHARD).write.option("compression", "zstd").parquet(folder)
    shards = spark.read.schema(SHARD).parquet(folder)
    ranges = ranges_for(shards.count() // SHARDS_A_RANGE)
    for size in range(1, longest + 1):
        if 1 < size < longest:  # few of the longest are rare, as both of their parts are frequent
            sieves.append(sieve_of(shards, size, sieves, least, ranges))
        counted = shards.mapInArrow(counter(size, sieves), "lang string, phrase string, n long")
        found = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        tables.append(found.select("lang", "phrase", F.lit(size).alias("size"), "f").checkpoint())
        drop_shuffles(spark)
    totals = shards.select(F.inline(F.arrays_zip("langs", "totals"))).toDF("lang", "n").groupBy("lang").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, tables), totals


def words_of(phrase: str | Column) -> Column:
    return F.split(phrase, " ", -1)


def scored(phrases: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``a`` of all phrases of two words and more, with the score of their
    weakest cut and the occurrences ``l`` and ``r`` of its two parts."""
    parts = phrases.select("lang", "phrase", "f")
    many = phrases.where("size > 1").withColumnRenamed("f", "a")
    cut = many.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right")
    )
    first = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    second = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cut.join(first, ["lang", "left"]).join(second, ["lang", "right"])
    # exact for any counts: decimals of 38 digits
    score = F.expr("cast(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) div cast(cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)) as decimal(21, 0)) as bigint)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "size", "a").agg(least).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """For each phrase inside of longer ones, the occurrences of the most frequent of those: ``held``."""
    words = words_of("phrase")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda p: F.array_join(F.slice(words, p, m), " ")))
    )
    inside = phrases.where("size > 2").select("lang", "f", F.explode(spans).alias("phrase"))
    return inside.groupBy("lang", "phrase").agg(F.max("f").alias("held"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a``: occurrences, overlaps included; ``l``, ``r``: those of the parts of its weakest cut; ``n``: the
    language's words. Phrases go if a longer one that holds them has ``percent`` of their occurrences.
    Null texts hold no words; a null language is ``und``; rows that repeat count each time; other columns
    are not read; texts without words and empty tables give no rows. Texts of any length are read whole.
    Equal scores go to the more frequent phrase, then to the first in the order of UTF-8 bytes.
    """
    phrases, totals = frequent(docs, text, lang, longest, least)
    kept = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a")))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most phrases: the first of each part of it are ranked again
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    ahead = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
