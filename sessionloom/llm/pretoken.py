"""The pre-token split of byte-level BPE vocabularies, vectorised over code points.

It gives the spans that the usual pattern gives (contractions; letters, numbers or other marks
with one space before them; white space, whose last character goes to what follows), for many
texts at once and without a regular expression engine.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: fixed values: the code points with the Unicode property White_Space
WHITE_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        table[:] = [kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)]
        table[WHITE_SPACE] = WHITE
        _classes.append(table)
    return _classes[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens; no pre-token crosses a row of ``offsets``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
    kind = classes()[point]
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(at, offsets)] = True
    first = cut[:n]
    same = np.empty(n, bool)
    same[0] = False
    np.equal(kind[1:], kind[:-1], out=same[1:])
    run = ~same | first
    white = kind == WHITE
    after_space = np.zeros(n, bool)
    after_space[1:] = point[:-1] == 0x20
    after_space &= ~first
    # white space followed by something else in its row: its last character stands apart
    last_white = np.zeros(n, bool)
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start = np.where(white, run | last_white, run & ~after_space)

    quote = np.flatnonzero((point == 0x27) & start)
    if len(quote):
        padded = np.zeros(n + 3, np.uint32)
        padded[:n] = point
        ends = np.flatnonzero(cut)
        room = ends[np.searchsorted(ends, quote, side="right")] - quote
        one, two = padded[quote + 1], padded[quote + 2]
        short = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 3) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        hit = short | long
        start[quote[hit] + 1] = False
        rest = quote[hit] + np.where(short[hit], 2, 3)
        start[rest[rest < n]] = True
    starts = at[np.flatnonzero(start)]
    return starts, np.append(starts[1:], len(data))


def with_cuts(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets with the occurrences of ``special`` inside rows as rows of their own, and the
    byte starts of those occurrences."""
    raw = data.tobytes()
    found, i = [], raw.find(special)
    while i >= 0:
        row = np.searchsorted(offsets, i, side="right")
        if i + len(special) <= offsets[row]:
            found.append(i)
            i = raw.find(special, i + len(special))
        else:
            i = raw.find(special, i + 1)
    marks = np.asarray(found, np.int64)
    return np.unique(np.concatenate([offsets, marks, marks + len(special)])), marks
