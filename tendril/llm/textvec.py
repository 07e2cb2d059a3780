"""Vectorised text kernels: words, hashes and windows of whole Arrow batches at once.

Texts come as Arrow strings; a null text counts as empty. All work is done on
the UTF-8 bytes of a slice of rows, so no Python object is made for a word.
Slices hold about SLICE_BYTES of text (or one row, if that is longer), which
bounds the memory of a worker by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: The white space of the contracts: x20 and x09-x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64


def byte_table(inside) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words as runs of anything but white space.
NONSPACE = byte_table(lambda b: b not in SPACES)
#: Words as runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64; a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
STEP = U64(0xD6E8FEB86659FD93)
#: Bytes of words that are hashed at once.
CHUNK = 1 << 22
#: The bytes of a code point by its first byte.
CHARACTER = np.array([1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) for b in range(256)])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive slices of a batch of about `limit` bytes of text each."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start, done = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    array = pa.concat_arrays([array.cast(pa.large_binary())])
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None:
        return np.empty(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of a slice: byte starts and ends, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        flag = inside[data] if n else np.zeros(0, bool)
        edge = np.ones(n + 1, bool)  # a word may start here, or end just before
        np.not_equal(flag[1:], flag[:-1], out=edge[1:n])
        edge[offsets] = True
        self.starts = np.flatnonzero(flag & edge[:n])
        self.ends = np.flatnonzero(flag & edge[1:]) + 1
        self.flag = flag
        #: bounds[i]:bounds[i+1] are the words of row i.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def heads(self, characters: int) -> np.ndarray:
        """The byte ends of the words' first code points, `characters` of them at most."""
        at = self.starts.copy()
        for _ in range(characters):
            inside = np.flatnonzero(at < self.ends)
            at[inside] += CHARACTER[self.data[at[inside]]]
        return np.minimum(at, self.ends)

    def hashes(self, fold: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (up to the byte `ends`, if given), after folding bytes by a table.

        Words are taken CHUNK bytes at a time, and a longer word in pieces, so the work space is bounded.
        """
        lengths = (self.ends if ends is None else ends) - self.starts
        sums = np.zeros(len(lengths), np.uint64)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        a = 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1)
            if lengths[a] > CHUNK:
                sums[a] = self._long(int(self.starts[a]), int(lengths[a]), fold)
            else:
                sums[a:b] = self._sums(self.starts[a:b], lengths[a:b], fold)
            a = b
        with np.errstate(over="ignore"):
            return mix64(sums + lengths.astype(np.uint64))

    def _sums(self, starts: np.ndarray, lengths: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        firsts = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=firsts[1:])
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
        byte = self.data[place + np.repeat(starts, lengths)]
        with np.errstate(over="ignore"):
            return np.add.reduceat(BYTE_KEYS[byte if fold is None else fold[byte]] * powers(int(lengths.max()))[place], firsts)

    def _long(self, start: int, length: int, fold: np.ndarray | None) -> np.uint64:
        out, step, steps = U64(0), int(STEP), powers(CHUNK)
        with np.errstate(over="ignore"):
            for a in range(0, length, CHUNK):
                byte = self.data[start + a : start + min(a + CHUNK, length)]
                part = (BYTE_KEYS[byte if fold is None else fold[byte]] * steps[: len(byte)]).sum(dtype=np.uint64)
                out += part * U64(pow(step, a, 1 << 64))
        return out


def powers(n: int) -> np.ndarray:
    """The first n powers of STEP."""
    out = np.full(n, STEP)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def window_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within rows: (hash, position of first word, row)."""
    counts = np.diff(bounds)
    each = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), each)
    skip = np.concatenate(([0], np.cumsum(each)))[:-1]
    at = np.arange(int(each.sum()), dtype=np.int64) - np.repeat(skip, each) + np.repeat(bounds[:-1], each)
    acc = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            acc = (acc + words[at + k]) * STEP
            acc ^= acc >> U64(29)
    return mix64(acc), at, rows


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over bounds[i]:bounds[i+1]."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
