"""Packs token sequences by best-two-fit: bins are filled greedily, then a bin's smallest document makes room for two that fit more tightly.

Lengths are whole numbers up to the sequence's length, so the packing of a
whole corpus is a packing of their histogram: at most CONTEXT numbers go to the
driver, whatever the corpus. There a bin is filled with the largest length that
fits, again and again; then its smallest document is taken out if two others
fit the larger gap more tightly. The pattern repeats for as many bins as the
counts allow, so the loop ends after a number of patterns that depends on
CONTEXT alone, and the bins are those of a bin-by-bin run over all documents.

Tokenizing is narrow. A task numbers the pieces of each length that it makes;
counts by task and length give each piece its rank among all of its length, and
the rank gives the bin and the place in it. So no task gathers the pieces of a
length, hot ones included.

Texts are encoded by their distinct chunks: a chunk begins at a space before a
Latin letter, or where Latin letters end before ASCII, and there the pattern of byte-level
BPE always begins a piece too, so the ids of a text are those of its chunks. Ids are kept as little-endian unsigned
32-bit numbers.

Edge cases: a null or empty text is the end id alone; a text of more than
CONTEXT ids is cut, its first piece takes what is left over; strings of special
tokens in a text are ordinary text; repeated rows and rows without an id are
packed like others; an empty table gives an empty result; columns of other
names are ignored. A text is one row's work.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import stored

from .common import arrow
from .textvec import byte_table, slices, text_bytes

CONTEXT, END = 1024, 2
#: Bytes of text a slice; distinct chunks a worker remembers, and bytes of the longest one it does.
SLICE, REMEMBERED, LONGEST = 1 << 22, 1 << 19, 32

ASCII_LETTER = byte_table(lambda b: b < 0x80 and chr(b).isalpha())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by their chunks, for byte-level BPE with the usual pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("Ġ")]] = True  # the vocabulary's sign for a space
        self.known: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the bounds of each): each text's ids, then `end`."""
        data, offsets = text_bytes(texts)
        letter = ASCII_LETTER[data]
        accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # U+00C0 to U+00FF but for two signs
        letter[accented] = letter[accented + 1] = True
        # before a space that a letter follows, and after a letter that something else of ASCII follows
        cuts = np.flatnonzero(letter[1:] & (data[:-1] == 0x20)), np.flatnonzero(letter[:-1] & ~letter[1:] & (data[1:] < 0x80)) + 1
        begins = np.zeros(len(data) + 1, bool)
        for at in (*cuts, offsets):
            begins[at] = True
        starts = np.flatnonzero(begins)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.large_string())
        coded = chunks.dictionary_encode()
        ids = self._of(coded.dictionary.to_pylist())
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        heads = np.cumsum(counts) - counts
        flat = np.frombuffer(b"".join(ids), np.uint32)
        index = coded.indices.to_numpy().astype(np.int64)
        each = counts[index]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        out = flat[np.arange(ends[-1]) + np.repeat(heads[index] - ends[:-1], each)]
        bounds = ends[np.searchsorted(starts, offsets)]
        out = np.insert(out, bounds[1:], np.uint32(end))
        return out, bounds + np.arange(len(bounds))

    def _of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, as bytes."""
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [c for c in chunks if c not in known]
        words = [c for c in new if c[:1] == " " and c[1:].isalpha()]
        # a word's first id begins with its space, the others have none, so words are encoded as one text
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        bounds = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
        flat = ids.tobytes()
        fresh = {c: flat[a:b] for c, a, b in zip(words, bounds[:-1], bounds[1:], strict=True)}
        rest = [c for c in new if c not in fresh]
        fresh |= {c: np.array(e.ids, np.uint32).tobytes() for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        out = [fresh[c] if c in fresh else known[c] for c in chunks]
        known |= {c: x for c, x in fresh.items() if len(c) <= LONGEST}
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a worker process; its tasks share what it remembers."""
    return Encoder(path)


def cut(lengths: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length): rows longer than the context are cut, the first piece takes what is left over."""
    n = np.maximum(-(-lengths // context), 1)
    row = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (lengths - (n - 1) * context)[row]
    start = np.where(piece == 0, 0, first + (piece - 1) * context)
    return row, piece, start, np.where(piece == 0, first, context)


def pieces(docs: DataFrame, tokenizer: str | None = None, context: int = CONTEXT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of each text's pieces, with the task and the number among its pieces of this length."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, so_far = TaskContext.get().partitionId(), np.zeros(context + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, bounds = encoder(path).encode(part.column("text"), end)
                row, piece, start, length = cut(np.diff(bounds), context)
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat(so_far[kinds], many)
                so_far[kinds] += many
                # pieces tile the ids
                ends = 4 * np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), packed, pa.array([task] * len(row), pa.int32()), pa.array(nth)], names=names)

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")


def fill(counts: np.ndarray, context: int) -> list[int]:
    """The lengths of one bin, the largest that fits each time; counts give how many of each length there are."""
    left, gap, bin_ = Counter(), context, []
    have = np.flatnonzero(counts)
    at = len(have) - 1
    while at >= 0 and gap >= have[0]:
        at = min(at, int(np.searchsorted(have, gap, side="right")) - 1)
        size = int(have[at])
        if left[size] < counts[size]:
            left[size] += 1
            bin_.append(size)
            gap -= size
        else:
            at -= 1
    return bin_


def best_two(bin_: list[int], counts: np.ndarray, context: int) -> list[int]:
    """The bin with its smallest document replaced by the two others that fit its larger gap best, if they fit more tightly."""
    gap = context - sum(bin_)
    if len(bin_) < 2 or not gap:
        return bin_
    small = bin_[-1]  # lengths descend
    free = counts.copy()
    for size, n in Counter(bin_).items():
        free[size] -= n
    room = gap + small
    have = np.flatnonzero(free[: room + 1])
    if not len(have):
        return bin_
    # the largest partner of each length
    other = np.searchsorted(have, room - have, side="right") - 1
    pair = np.where(other >= 0, have + have[other], 0)
    alone = (other >= 0) & (have[other] == have) & (free[have] < 2)
    other = np.where(alone, other - 1, other)
    pair = np.where(other >= 0, have + have[other], 0)
    best = int(np.argmax(pair))
    if pair[best] <= small:
        return bin_
    return sorted([*bin_[:-1], int(have[best]), int(have[other[best]])], reverse=True)


def patterns(counts: np.ndarray, context: int = CONTEXT) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until all counts are used; counts[n] is the number of documents of length n."""
    counts, out = counts.copy(), []
    while counts.any():
        greedy = fill(counts, context)
        bin_ = best_two(greedy, counts, context)
        need = Counter(greedy) | Counter(bin_)
        # the smallest document of the greedy bin is needed beside the two
        times = min(int(counts[size]) // n for size, n in need.items())
        for size, n in Counter(bin_).items():
            counts[size] -= n * times
        out.append((bin_, times))
    return out


def places(found: list[tuple[list[int], int]], context: int = CONTEXT) -> dict[int, dict[str, np.ndarray]]:
    """For each length, the ranks at which its use begins, and the first bin, the number in a bin and the offset there."""
    used, rows, bins = Counter(), {}, 0
    for bin_, times in found:
        offset = 0
        for size, n in sorted(Counter(bin_).items(), reverse=True):
            rows.setdefault(size, []).append((used[size], bins, n, offset))
            used[size] += n * times
            offset += n * size
        bins += times
    return {size: dict(zip(("rank", "bin", "each", "offset"), np.array(x, np.int64).T, strict=True)) for size, x in rows.items()}


def pack(cut_texts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with length, task and nth; their other columns stay."""
    by_task = cut_texts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = np.zeros(context + 1, np.int64)
    for r in cut_texts.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row a length
        counts[r["length"]] = r["n"]
    where = places(patterns(counts, context), context)
    ranked = cut_texts.join(firsts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first")
    kept = [c for c in cut_texts.columns if c not in ("task", "nth")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own, of = length == size, where[size]
                k = np.searchsorted(of["rank"], rank[own], side="right") - 1
                many, nth = of["each"][k], rank[own] - of["rank"][k]
                bins[own] = of["bin"][k] + nth // many
                offsets[own] = of["offset"][k] + nth % many * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bins), pa.array(offsets)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_texts.schema if f.name in kept)
    return arrow(ranked.select(*kept, "rank"), work, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of whole sequences from packed pieces with their ids; a sequence has at most CONTEXT pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))


def digests(docs: DataFrame) -> DataFrame:
    """The pieces of all texts with the crc32 of their ids, packed."""
    made = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return pack(stored(made, "pieces"))
