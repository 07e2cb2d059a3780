"""Periodic runs of words in linear time from Lyndon arrays (Ellert and Fischer), and texts with the repeats collapsed.

The words of a text are letters of an ordered alphabet: their ranks by bytes,
from one comparison sort of a slice's words. One pass from left to right gives
each place its next smaller suffix, the end of its longest Lyndon word, with
the length of their common extension. A pass compares only the ends of edges
of the Lyndon array; what an earlier comparison matched, up to the furthest
place reached, is taken from the mirrored edge and never read again, so the
words are read about once. Every run has its Lyndon root under one of the two
orders of the alphabet, so two passes find all. No suffix array, no suffix
tree and no hash is built.

Only runs of at least MIN_REPEATS periods and MIN_WORDS words are asked for.
Words that can stand in no such run are cut off before: all words of a run
stand in it MIN_REPEATS times, and each but the first period's has an equal
one at most a period before it. This loses no run and cannot change one, for
the neighbours of a run are cut off only if they do not extend it; texts
without repeats lose all their words there, in whole columns at once.

Edge cases: a null text has no words, no runs and the digests of nothing; a
text shorter than MIN_WORDS has no runs; a row without an id is not rewritten;
repeated rows are computed each for itself; of runs with equal exponents the
first counts, then that of the least period; an empty table gives an empty
result; columns of other names are ignored. A text is one row's work and its
memory grows with its words, about 200 bytes each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textvec import slices

MIN_REPEATS, MIN_WORDS = 4, 6
#: Rounds of cutting off; any number is right.
ROUNDS = 8


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int]]:
    """The next smaller suffix of each place, the end of the text at last, and the length they have in common.

    t[seen - back ... reach - back] equals t[seen ... reach]: the extension that reaches furthest.
    """
    n = len(t)
    above, above_common = [n] * n, [0] * n  # next smaller suffix
    below, below_common = [-1] * n, [0] * n  # previous smaller suffix
    seen = back = reach = 0
    for i in range(1, n):
        p, q, common = i - 1, -1, 0
        while p >= 0:
            if q >= 0:
                edge = below_common[q]  # of p and q, where suffix i < suffix q with `common` words equal
                if edge < common:
                    below[i], below_common[i] = p, edge
                    break
                if edge > common:
                    above[p], above_common[p] = i, common
                    q, p = p, below[p]
                    continue
            if i + common < reach:
                m = i - back
                a = p - back if p >= seen else p
                known = below_common[m] if below[m] == a else above_common[a] if above[a] == m else -1
                if known > common:
                    common = known if i + known < reach else reach - i
            k, w = i + common, p + common
            while k < n and t[k] == t[w]:
                k += 1
                w += 1
            common = k - i
            if k > reach:
                seen, back, reach = i, i - p, k
            if k < n and t[w] < t[k]:
                below[i], below_common[i] = p, common
                break
            above[p], above_common[p] = i, common
            q, p = p, below[p]
    return above, above_common


def runs(t: list[int], repeats: int = MIN_REPEATS, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least `repeats` (2 or more) periods and `least` words, by start, then period."""
    n = len(t)
    out = set()
    for letters in (t, [-x for x in t]):
        ends, commons = lyndon_edges(letters)
        for i in range(n):
            end = ends[i]
            period, common = end - i, commons[i]
            # the first root of a run begins within its first period
            if end == n or common <= (repeats - 2) * period or (i >= period and ends[i - period] == i and commons[i - period] >= period):
                continue
            start = i
            while start and t[start - 1] == t[start - 1 + period]:
                start -= 1
            length = end + common - start
            if length >= max(least, repeats * period):
                out.add((start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(letters: np.ndarray, rows: np.ndarray, repeats: int = MIN_REPEATS, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold a run; none spans two rows."""
    at = np.arange(len(letters))
    piece = rows.astype(np.int64)
    for _ in range(ROUNDS):
        if not len(at):
            break
        order = np.lexsort((at, letters[at], piece))
        same = np.zeros(len(at), bool)
        same[1:] = (piece[order][1:] == piece[order][:-1]) & (letters[at[order]][1:] == letters[at[order]][:-1])
        # words of a piece that stand in it often enough
        group = np.cumsum(~same) - 1
        often = np.empty(len(at), bool)
        often[order] = np.bincount(group)[group] >= repeats
        # distance to the same word before; the words of a piece are consecutive
        gap = np.full(len(at), 1 << 62)
        gap[order[1:]] = np.where(same[1:], at[order[1:]] - at[order[:-1]], 1 << 62)
        first = np.concatenate(([True], piece[1:] != piece[:-1]))
        begin = np.flatnonzero(first)
        head = np.repeat(begin, np.diff(np.append(begin, len(at))))  # where each word's piece begins
        longest = int(np.diff(np.append(begin, len(at))).max()) // repeats
        mark = np.zeros(len(at) + 1, np.int64)
        for scale in range(max(longest, 1).bit_length() + 1):
            # a run with a period of up to 2**scale words, over half of it, has so many words with a gap of a period at most
            most = 1 << scale
            wanted = max((repeats - 1) * (most // 2 + 1), least - most)
            a, b = stretches(gap <= most)
            long = b - a >= wanted
            a, b = a[long], b[long]
            np.add.at(mark, np.maximum(a - most, head[a]), 1)
            np.add.at(mark, b, -1)
        keep = often & (np.cumsum(mark[:-1]) > 0)
        # pieces of consecutive kept words, long enough for a run
        new = keep & np.concatenate(([True], ~keep[:-1] | first[1:]))
        label = np.cumsum(new)[keep]
        at_kept = at[keep]
        wide = np.bincount(label)[label] >= least if len(label) else np.zeros(0, bool)
        done = len(at_kept[wide]) == len(at)
        at, piece = at_kept[wide], label[wide]
        if done:
            break
    if not len(at):
        return at, at
    new = np.concatenate(([True], piece[1:] != piece[:-1]))
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] + 1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, runs of anything but x20 and x09-x0D, and the bounds of each row's."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    values, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(full)))[offsets]
    return values.filter(pa.array(full)), bounds.astype(np.int64)


def repeated(n: int, seed: int) -> np.ndarray:
    """The original word of each of the n words of a text whose end repeats: the contract's rule for a seed."""
    g = seed // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % period
    return at


def seeds_of(ids: pa.Array) -> list[int | None]:
    """crc32 of each id's decimal text; none for a row without an id."""
    return [None if x is None else zlib.crc32(str(x).encode()) for x in ids.to_pylist()]


def ranks(words: pa.Array) -> np.ndarray:
    """The rank of each word among the distinct ones by bytes, from 1."""
    return pc.rank(words, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, runs_sha256 string, collapsed string, collapsed_sha256 string"


def find(docs: DataFrame, rewrite: bool = False, collapsed: bool = True) -> DataFrame:
    """The runs of each text, the one of greatest exponent, the text without its repeats (if asked for), and digests of both.

    rewrite: first makes the ends of some texts periodic, those whose id's crc32 is divisible by 10.
    """
    triple = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
    longs = [(k, pa.int64()) for k in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    schema = pa.schema([*longs, ("runs", pa.list_(triple)), ("runs_sha256", pa.string()), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            words, bounds = words_of(part.column("text"))
            if rewrite:
                source = np.arange(len(words))
                for row, seed in enumerate(seeds_of(part.column("doc_id"))):
                    a, b = bounds[row], bounds[row + 1]
                    if seed is not None and seed % 10 == 0 and b > a:
                        source[a:b] = a + repeated(int(b - a), seed)
                words = words.take(pa.array(source))
            letters = ranks(words)
            rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
            drop = np.zeros(len(letters) + 1, np.int64)
            for a, b in zip(*(x.tolist() for x in pieces(letters, rows)), strict=True):
                row = int(rows[a])
                for start, length, period in runs(letters[a:b].tolist()):
                    found[row].append((a - int(bounds[row]) + start, length, period))
                    drop[a + start + period] += 1
                    drop[a + start + length] -= 1
            kept = np.cumsum(drop[:-1]) == 0
            ends = np.concatenate(([0], np.cumsum(kept)))[bounds]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), " ")
            digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined.cast(pa.binary())]
            # pieces come in order, so runs do too, but for those of one start
            best = [min(r, key=ByExponent, default=None) for r in found]
            column = lambda i, best=best: [None if r is None else r[i] for r in best]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(r) for r in found], pa.int64()),
                    *(pa.array(column(i), pa.int64()) for i in range(3)),
                    pa.array([None if r is None else 1000 * r[1] // r[2] for r in best], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], pa.list_(triple)),
                    pa.array([hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in r).encode()).hexdigest() for r in found]),
                    joined if collapsed else pa.nulls(part.num_rows, pa.string()),
                    pa.array(digests, pa.string()),
                ],
                schema=schema,
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, SCHEMA)


class ByExponent:
    """Orders runs by exact exponent, the greatest first, then by start, then by period."""

    def __init__(self, run: tuple[int, int, int]):
        self.run = run

    def __lt__(self, other: ByExponent) -> bool:
        (a, n, p), (b, m, q) = self.run, other.run
        return (-n * q, a, p) < (-m * p, b, q)
