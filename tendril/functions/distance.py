"""Exact edit distances of whole texts, in characters or words, for error rates.

Two bounds come first, in time that grows with the texts' lengths: the items of
one text that the other lacks, at least, and the edits of an alignment place by
place or word by word, at most. Where they meet, as they do for a reading whose
errors stay within words, that is the distance.

Else it is computed in bit vectors as long as a band around the diagonal: one
Python integer holds a column's differences, so a step over one character costs
the band's width / 64 word operations, in C. The band starts at the lower bound
and doubles until the distance lies within it or the upper bound is reached, so
texts cost their length times their distance, / 64. Beginnings and ends that
are equal are cut off before.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

#: Distance that the first band holds at least.
FIRST_BAND = 63
#: Longest words, in characters, whose distances are remembered, and how many are.
WORD, WORDS = 64, 1 << 16


def _within(a: Sequence[Hashable], b: Sequence[Hashable], places: dict[Hashable, int], k: int) -> int:
    """The distance of a and b if it is at most k, else a number above k.

    A way of k edits goes at most `above` rows over the diagonal of the first cell and `below` rows under it. Bit r of a
    column's vectors is row (column - above + r) of the table of distances. The distance is followed along the diagonal
    that ends in the table's last cell.
    """
    more = len(a) - len(b)
    above, below = (k - more) // 2, (k + more) // 2
    full = (1 << (above + below + 1)) - 1
    down, up = full << above & full, 0  # rows where the distance grows, or falls, from the row before
    last = 1 << (more + above)
    distance = max(more, 0)
    for column, x in enumerate(b, 1):
        equal = places.get(x, 0)
        shift = column - above - 1
        equal = (equal >> shift if shift >= 0 else equal << -shift) & full
        same = ((((equal & down) + down) ^ down) | equal | up) & full  # as the cell up and to the left
        right, left = up | (full ^ (same | down)), same & down
        lower = same >> 1
        down, up = left | (full ^ (lower | right)), lower & right
        if not same & last:
            distance += 1
            if distance > k:  # it never falls along a diagonal
                break
    return distance


def _codes(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """The items as numbers: code points of strings, else numbers by first place."""
    if isinstance(a, str) and isinstance(b, str):
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        if max(x.max(initial=0), y.max(initial=0)) < 1 << 16:
            return x, y
        both = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        return both[: len(x)], both[len(x) :]
    number: dict[Hashable, int] = {}
    return tuple(np.fromiter((number.setdefault(i, len(number)) for i in s), np.int64, len(s)) for s in (a, b))


def _unlike(x: np.ndarray, y: np.ndarray) -> int:
    """The items at the beginning that are equal."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def _at_least(x: np.ndarray, y: np.ndarray) -> int:
    """Items of one side that the other lacks: each edit mends one of either side."""
    size = int(max(x.max(), y.max())) + 1
    lack = np.bincount(x, minlength=size) - np.bincount(y, minlength=size)
    return int(max(lack[lack > 0].sum(), -lack[lack < 0].sum()))


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], known: dict[tuple[str, str], int] | None = None) -> int:
    """The least number of insertions, deletions and substitutions that turn a into b; known: distances of words that calls share."""
    if min(len(a), len(b)) <= WORD:
        return _banded(a, b, 0, max(len(a), len(b)))
    x, y = _codes(a, b)
    start = _unlike(x, y)
    x, y = x[start:], y[start:]
    end = _unlike(x[::-1], y[::-1])
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not a or not b:
        return len(a) + len(b)
    least, most = _at_least(x, y), max(len(a), len(b))
    if len(x) == len(y):
        most = int(np.count_nonzero(x != y))
    if least < most and isinstance(a, str) and isinstance(b, str):
        ours, theirs = a.split(" "), b.split(" ")
        if len(ours) == len(theirs) > 1:
            known = {} if known is None else known
            most = min(most, sum(_words_apart(p, q, known) for p, q in zip(ours, theirs, strict=True) if p != q))
    return least if least == most else _banded(a, b, least, most)


def _words_apart(a: str, b: str, known: dict[tuple[str, str], int]) -> int:
    """Edits that turn a word into another, place by place if they are of one length; known: those of short words so far."""
    if len(a) == len(b):
        return sum(map(ne, a, b))
    if max(len(a), len(b)) > WORD:
        return edit_distance(a, b)
    if (found := known.get((a, b))) is None:
        if len(known) >= WORDS:
            known.clear()
        found = known[a, b] = _banded(a, b, 0, max(len(a), len(b)))
    return found


def _banded(a: Sequence[Hashable], b: Sequence[Hashable], least: int, most: int) -> int:
    """The distance, known to be from least to most, in bands."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[Hashable, int] = {}
    spots: dict[Hashable, list[int]] = {}
    for i, x in enumerate(a):
        spots.setdefault(x, []).append(i)
    for x, at in spots.items():
        bits = bytearray((at[-1] >> 3) + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        places[x] = int.from_bytes(bits, "little")
    k = max(FIRST_BAND, least, abs(len(a) - len(b)))
    while (distance := _within(a, b, places, min(k, most))) > k and k < most:
        k *= 2
    return distance


@F.arrow_udf(LongType())
def edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """The edit distance of two columns of strings; null if one is null."""
    known: dict[tuple[str, str], int] = {}
    each = (None if x is None or y is None else edit_distance(x, y, known) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True))
    return pa.array(each, pa.int64())


@F.arrow_udf(LongType())
def word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """The edit distance in words of two columns of strings; null if one is null."""
    each = (None if x is None or y is None else edit_distance(x.split(), y.split()) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True))
    return pa.array(each, pa.int64())


@F.arrow_udf(IntegerType())
def word_counts(a: pa.Array) -> pa.Array:
    """The words of a column of strings, cut as for their edits."""
    return pa.array((None if x is None else len(x.split()) for x in a.to_pylist()), pa.int32())
