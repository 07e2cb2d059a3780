"""LM scoring: a trigram trie in Elias-Fano levels, built and queried by shards.

Level 1 lists the words of the training texts by hash, with exact counts as a
monotone sequence of their sums. A shard of the trie holds contexts u, their
successors v (level 2) and the successors w of each (u, v) (level 3): monotone
pointers give the range of a node's successors in the next level, and each
level is one Elias-Fano sequence of successors relative to their node. A
successor has one byte, the quantised log10 of its smoothed share,
c(uv) / (c(u) + MU2) or c(uvw) / (c(uv) + MU3), and a node of level 2 one more,
the log10 of the mass it leaves to the shorter context, MU3 / (c(uv) + MU3). A
query finds the context, searches v's successor place within the context's
range, then w's within the range of (u, v), each time guessing places from the
values around, for successors are hashes, whole in the low parts; and it
interpolates:
p(w | uv) = share(uvw) + left(uv) * (share(vw) + left(v) * p(w)), with p the
add-one unigram law, so the probabilities of all words after a context sum to
1; what is not in the trie has share 0 and leaves all.

Counts are gathered from all training texts: each slice of texts sends its
distinct trigrams, packed, to their contexts' shards; bigram and context counts
are sums of theirs. A context with more than HEAVY tokens is split by the first
hash bits of its successors into as many parts as its count asks for; the parts
lie in shards of their own, so no shard grows with a frequent word; a shard is a
task, or several are beyond MOST_TASKS. A context's total is known from level 1. Level 1 is bounded likewise: a slice sends a word once.
Level files lie in the shared folder under names that follow from the shard's
number, so no list of them goes through the driver, and a retried task writes
the same file again. Where shards are many, several slices are scored together. Tasks map them into memory; of a store without paths they
read shards as they need them and keep KEPT_BYTES.

Words are known by 64-bit hashes, successors of a node by 32 of these bits: of
the words that are not among a node's n successors, n / 2**32 are taken for one.

Edge cases: a null or empty text is one end token; a text of one word has no
trigram; very long texts are one slice of their own; repeated rows count and
score alike; a row without an id is a training text; without training rows
every score is that of unknown words; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import scratch_path, stored

from .common import arrow, grouped, is_held_out
from .textvec import LOWER, NONSPACE, U64, Words, mix64, slices, text_bytes

#: Tokens that the shorter context weighs, after one and after two words.
MU2, MU3 = 300.0, 100.0
#: Bytes of text that a slice, a shard of level 1 and one of the trie stand for.
SLICE, WORD_SHARD, TRIE_SHARD = 4 << 20, 32 << 20, 12 << 20
#: Tokens of a context beyond which it is split: about half of those of a shard.
HEAVY = 1 << 20
#: Tasks that the shards of a level are dealt to at most.
MOST_TASKS = 1 << 15
#: Bytes of levels that a task keeps of a store without paths; the least lately used go first.
KEPT_BYTES = 256 << 20
#: Distinct words that a task gathers before it sends them.
GATHER = 1 << 20
END, START, PAD = U64(1), U64(2), U64(3)
GOLD = U64(0x9E3779B97F4A7C15)
TAIL = U64(32)
#: Rounds of a search in which a place is guessed from values, before ranges are halved.
GUESSES = 8
#: Searches that are rather done one by one than all at once.
FEW = 12
#: Slices that are scored together: one for each SHARDS_A_SLICE shards of the trie, up to MOST_SLICES and MOST_TOKENS.
SHARDS_A_SLICE, MOST_SLICES, MOST_TOKENS = 128, 4, 4 << 20


def distinct(codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes below `top` in order, each code's place among them, and their counts: codes and places are sorted as one number."""
    n = len(codes)
    bits = n.bit_length()
    if bits + top.bit_length() > 64:
        return np.unique(codes, return_inverse=True, return_counts=True)
    both = np.sort((codes.astype(np.uint64) << U64(bits)) | np.arange(n, dtype=np.uint64))
    at = (both & U64((1 << bits) - 1)).astype(np.int64)
    both >>= U64(bits)
    new = np.ones(n, bool)
    new[1:] = both[1:] != both[:-1]
    place = np.empty(n, np.int64)
    place[at] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return both[first].astype(np.int64), place, np.diff(first, append=n)


def distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and each hash's place among them."""
    found = pa.array(hashes).dictionary_encode()
    words, own = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(words)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return words[order], place[own]


class Block:
    """The distinct words of a slice of texts, its tokens as places in them, and (if asked for) its distinct bigrams and trigrams.

    A text is framed by START and PAD, and ends with END; each token stands for
    the bigram it ends and for the trigram it is the middle of.
    """

    def __init__(self, array: pa.Array, grams: bool = True):
        data, offsets = text_bytes(array)
        words = Words(data, offsets, NONSPACE)
        self.n_tokens = words.counts + 1
        self.at = np.concatenate(([0], np.cumsum(self.n_tokens)))
        hashes = np.full(int(self.at[-1]), END)
        inner = np.ones(len(hashes), bool)
        inner[self.at[1:] - 1] = False
        hashes[inner] = np.maximum(words.hashes(LOWER), U64(4))
        self.words, places = distinct_hashes(np.concatenate((np.array([START, PAD]), hashes)))
        start, pad, self.token = int(places[0]), int(places[1]), places[2:]
        if not grams:
            return
        before, after = np.empty_like(self.token), np.empty_like(self.token)
        before[1:], after[:-1] = self.token[:-1], self.token[1:]
        before[self.at[:-1]], after[self.at[1:] - 1] = start, pad
        self.before, n = before, len(self.words)
        codes, self.pair_of, _ = distinct(before * n + self.token, n * n)
        self.u, self.v = np.divmod(codes, n)
        codes, self.triple_of, self.count = distinct(self.pair_of * n + after, len(self.u) * n)
        self.pair, self.w = np.divmod(codes, n)
        for name in ("token", "before", "pair_of", "triple_of", "u", "v", "pair", "w"):  # a text has fewer than 2**31 bytes
            setattr(self, name, getattr(self, name).astype(np.int32))


def select_table() -> np.ndarray:
    """The place of the k-th one of a byte b, at k * 256 + b."""
    out = np.zeros((8, 256), np.uint8)
    for b in range(256):
        for k, place in enumerate(i for i in range(8) if b >> i & 1):
            out[k, b] = place
    return out.ravel()


SELECT = select_table()
FIVES, THREES, NIBBLES, BYTES, TOPS, BYTE = (U64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080, 0xFF))
ONE, TWO, FOUR, EIGHT = U64(1), U64(2), U64(4), U64(8)


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The bit of the k-th one of each word (from 0), which has more than k: its byte by the sums of all bytes at once, its place there by a table."""
    k = k.astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = words - ((words >> ONE) & FIVES)
        sums = (sums & THREES) + ((sums >> TWO) & THREES)
        sums = ((sums + (sums >> FOUR)) & NIBBLES) * BYTES  # byte i: the ones of bytes 0 ... i
        place = np.bitwise_count(((k * BYTES | TOPS) - sums) & TOPS).astype(np.uint64) * EIGHT
        k -= ((sums << EIGHT) >> place) & BYTE
    return place.astype(np.int64) + SELECT[(k << EIGHT) | ((words >> place) & BYTE)]


def next_one(rest: np.ndarray) -> np.ndarray:
    """The number of zeros below each word's lowest one."""
    with np.errstate(over="ignore"):
        return np.bitwise_count((rest & (~rest + ONE)) - ONE).astype(np.int64)


class EliasFano:
    """A monotone sequence below 2**bits as high parts in unary and packed low parts, of at least `least` bits."""

    @staticmethod
    def pack(values: np.ndarray, bits: int, least: int = 0) -> dict[str, np.ndarray]:
        n = len(values)
        low = min(max(least, bits - max(n, 1).bit_length()), 56)
        high = (values >> U64(low)).astype(np.int64)
        size = int(high[-1]) + n + 2 if n else 2
        ones = np.zeros((size + 63) // 64 * 64, np.uint8)
        ones[high + np.arange(n)] = 1
        upper = np.packbits(ones, bitorder="little").view(np.uint64)
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))))
        if low == 32:
            return {"shape": np.array([n, low, high[-1] if n else 0], np.int64), "upper": upper, "zeros": zeros, "lower": np.concatenate([values.astype(np.uint32).view(np.uint8), np.zeros(8, np.uint8)])}
        packed = [np.packbits((part[:, None] >> np.arange(low, dtype=np.uint64) & U64(1)).astype(np.uint8).ravel(), bitorder="little") for part in (values[a : a + (1 << 16)] for a in range(0, n, 1 << 16))] if low else []
        lower = np.concatenate([*packed, np.zeros(8, np.uint8)])  # 2**16 values fill whole bytes
        return {"shape": np.array([n, low, high[-1] if n else 0], np.int64), "upper": upper, "zeros": zeros, "lower": lower}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low, self.top = map(int, parts["shape"])
        self.upper, self.zeros = parts["upper"], parts["zeros"]
        self.ones = np.arange(len(self.zeros)) * 64 - self.zeros
        lower = parts["lower"]
        self.whole = lower[: self.n * 4].view(np.uint32) if self.low == 32 else None
        self.words = np.lib.stride_tricks.as_strided(lower[:8].view(np.uint64), (max(1, len(lower) - 7),), (1,))

    def tails(self, at: np.ndarray) -> np.ndarray:
        """The low parts of the values at the given places."""
        if not self.low:
            return np.zeros(len(at), np.uint64)
        if self.whole is not None:
            return self.whole[at].astype(np.uint64)
        bit = at * self.low
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & U64((1 << self.low) - 1)

    def zero(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word and the bit of the k-th zero of the upper bits (from 0)."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word, select(~self.upper[word], k - self.zeros[word])

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the values with these high parts: the zero after the one before them mostly stands in its word."""
        before = np.maximum(high - 1, 0)
        word, bit = self.zero(before)
        start = word * 64 + bit
        rest = ~self.upper[word] >> (bit + 1).astype(np.uint64)
        stop = start + 1 + next_one(rest)
        far = np.flatnonzero(rest == 0)
        if len(far):
            word, bit = self.zero(before[far] + 1)
            stop[far] = word * 64 + bit
        none = high == 0
        start, stop = np.where(none, 0, start - before), np.where(none, start, stop - high)
        return start, np.minimum(stop, self.n)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The high parts, cut where no value is so large, and the low ones."""
        return np.minimum(x >> U64(self.low), U64(self.top + 1)).astype(np.int64), x & U64((1 << self.low) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is at least x."""
        high, tail = self.split(x)
        first, last = self.bucket(high)
        return self.halve(np.minimum(first, last), last, tail)

    def halve(self, first: np.ndarray, last: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The first place in first ... last - 1 with a low part of at least `tail`, or last: by halves, all at once."""
        while True:
            open_ = np.flatnonzero(first < last)
            if not len(open_):
                return first
            mid = (first[open_] + last[open_]) >> 1
            less = self.tails(mid) < tail[open_]
            first[open_] = np.where(less, mid + 1, first[open_])
            last[open_] = np.where(less, last[open_], mid)

    def one(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word and the bit of the k-th one of the upper bits (from 0)."""
        word = np.searchsorted(self.ones, k, side="right") - 1
        return word, select(self.upper[word], k - self.ones[word])

    def at(self, k: np.ndarray) -> np.ndarray:
        """The values at places k."""
        word, bit = self.one(k)
        return ((word * 64 + bit - k).astype(np.uint64) << U64(self.low)) | self.tails(k)

    def two(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places k and k + 1: the next one mostly stands in the same word."""
        word, bit = self.one(k)
        place = word * 64 + bit
        rest = self.upper[word] >> (bit + 1).astype(np.uint64)
        after = ((place + next_one(rest) - k).astype(np.uint64) << U64(self.low)) | self.tails(k + 1)
        far = np.flatnonzero(rest == 0)
        if len(far):
            after[far] = self.at(k[far] + 1)
        return ((place - k).astype(np.uint64) << U64(self.low)) | self.tails(k), after

    def within(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of each x among the values at places first ... last - 1, or -1: a successor search in that range."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        high, tail = self.split(x)
        start, stop = self.bucket(high)
        first, stop = np.maximum(first, start), np.minimum(stop, last)
        place = self.halve(first.copy(), np.maximum(stop, first), tail)
        hit = (place < stop) & (self.tails(np.minimum(place, self.n - 1)) == tail)
        return np.where(hit, place, -1)

    def among(self, tail: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of each low part (of 32 bits) among those at first ... last - 1, which rise there, or -1.

        Low parts of hashes are spread evenly, so a place is guessed from the
        values that bound it; after GUESSES rounds ranges are halved, whatever they
        hold. The last FEW open ones are searched one by one.
        """
        out = np.full(len(tail), -1, np.int64)
        own = np.flatnonzero(first < last)
        first, last, goal = first[own], last[own], tail[own].astype(np.float64)
        floor, top, rounds = np.zeros(len(own)), np.full(len(own), float(1 << self.low)), 0
        while len(own) > FEW:
            share = (goal - floor) / (top - floor) if rounds < GUESSES else 0.5
            mid = np.minimum(first + ((last - first) * share).astype(np.int64), last - 1)
            value = self.tails(mid).astype(np.float64)
            hit = value == goal
            out[own[hit]] = mid[hit]
            less = value < goal
            first, last = np.where(less, mid + 1, first), np.where(less, last, mid)
            floor, top = np.where(less, value + 1, floor), np.where(less, top, value)
            left = np.flatnonzero((first < last) & ~hit)
            own, first, last, goal, floor, top = (v[left] for v in (own, first, last, goal, floor, top))
            rounds += 1
        for i, a, b, x in zip(own.tolist(), first.tolist(), last.tolist(), tail[own], strict=True):
            place = a + int(np.searchsorted(self.whole[a:b], np.uint32(x)))
            if place < b and self.whole[place] == x:
                out[i] = place
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1."""
        return self.within(x, np.int64(0), np.int64(self.n))


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def save(folder: str, name: str, parts: dict[str, np.ndarray]) -> None:
    """Writes named arrays as one file of the shared folder; it appears whole, and a second writer replaces it by its like."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    head, at = {}, 0
    for key, value in parts.items():
        head[key] = [at, len(value), value.dtype.str]
        at += (value.nbytes + 7) // 8 * 8
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 8)
    part = f"{path}/{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for value in parts.values():
            out.write(value.tobytes() + b"\0" * (-value.nbytes % 8))
    fs.move(part, f"{path}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped into memory (read, where the store has no paths); None if there is no such file."""
    fs, path = opened(folder)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r"))
        else:
            with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                raw = np.frombuffer(stream.read(), np.uint8)
    except FileNotFoundError:
        return None
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (at, size, kind) in head.items()}


def nested(prefix: str, values: np.ndarray, bits: int, least: int = 0) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in EliasFano.pack(values.astype(np.uint64), max(1, bits), least).items()}


def part_of(prefix: str, parts: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k.split(".")[1]: v for k, v in parts.items() if k.split(".")[0] == prefix})


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def below(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The hash bits that a shard's number does not tell."""
    return hashes & U64((1 << (64 - bits)) - 1)


class Law:
    """Sums of the training tokens, and the code of the quantised shares."""

    def __init__(self, tokens: int, types: int, texts: int):
        self.tokens, self.types, self.texts = tokens, types, texts
        self.floor = -np.log10(tokens + MU2 + MU3 + 10)  # no share is smaller
        self.step = -self.floor / 255
        self.decoded = 10.0 ** (self.floor + np.arange(256) * self.step)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.tokens + self.types + 1.0)

    def encode(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((np.log10(p) - self.floor) / self.step), 0, 255).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.decoded[code]


class Heavy:
    """Contexts that are split: their hashes, counts and numbers of bits."""

    def __init__(self, parts: dict[str, np.ndarray] | None):
        none = np.empty(0, np.int64)
        self.words, self.counts, self.bits = (parts["words"], parts["counts"], parts["bits"]) if parts else (none.view(np.uint64), none, none)

    def contexts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The context's own hash, or that of the part of it that v belongs to."""
        if not len(self.words):
            return u
        at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
        split = np.flatnonzero(self.words[at] == u)
        out = u.copy()
        out[split] = self.part(u[split], v[split] >> (64 - self.bits[at[split]]).astype(np.uint64))
        return out

    @staticmethod
    def part(word: np.ndarray, number: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(word + (number + U64(1)) * GOLD)

    def totals(self, contexts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The counts of contexts: their own sums, but those of the whole context for parts."""
        if not len(self.words):
            return own
        each = 1 << self.bits
        number = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        parts = self.part(np.repeat(self.words, each), number.astype(np.uint64))
        order = np.argsort(parts)
        parts, counts = parts[order], np.repeat(self.counts, each)[order]
        at = np.minimum(np.searchsorted(parts, contexts), len(parts) - 1)
        return np.where(parts[at] == contexts, counts[at], own)


class Trie:
    """A model in the shared folder: where its levels lie, in how many shards, and its law."""

    def __init__(self, folder: str, bits1: int, bits2: int, law: Law):
        self.folder, self.bits1, self.bits2, self.law = folder, bits1, bits2, law

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Level files as a task needs them; those mapped stay open, of those of a store without paths KEPT_BYTES stay."""

    def __init__(self, trie: Trie):
        self.trie, self.held, self.sizes = trie, {}, {}
        self.keeps = isinstance(opened(trie.folder)[0], pafs.LocalFileSystem)
        self.heavy = Heavy(load(trie.folder, "heavy"))

    def parts(self, name: str, sequences: tuple[str, ...]) -> dict | None:
        if name in self.held:
            if not self.keeps:
                self.held[name] = self.held.pop(name)  # the last used stand last
            return self.held[name]
        got = load(self.trie.folder, name)
        if not self.keeps:
            self.sizes[name] = sum(x.nbytes for x in (got or {}).values() if isinstance(x, np.ndarray))
            while self.held and sum(self.sizes.values()) > KEPT_BYTES:
                oldest = next(iter(self.held))
                del self.held[oldest], self.sizes[oldest]
        if got is not None:
            got = {k: part_of(k, got) for k in sequences} | {k: v for k, v in got.items() if "." not in k}
        self.held[name] = got
        return got

    def counts(self, words: np.ndarray) -> np.ndarray:
        """The training counts of words, which are sorted by hash."""
        bits, out = self.trie.bits1, np.zeros(len(words), np.int64)
        shard = shard_of(words, bits)
        cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            level = self.parts(f"words-{s}", ("words", "sums"))
            if level is None:
                continue
            place = level["words"].find(below(words[cuts[s] : cuts[s + 1]], bits))
            hit = np.flatnonzero(place >= 0)
            later = place[hit] > 0
            before, ends = level["sums"].two(np.maximum(place[hit] - 1, 0)) if level["sums"].n > 1 else (level["sums"].at(place[hit]),) * 2
            out[cuts[s] + hit] = np.where(later, ends - before, before).astype(np.int64)
        return out

    def shares(self, *blocks: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the blocks' bigrams, a block after another, the share and the mass they leave, of their trigrams the share."""
        law, bits = self.trie.law, self.trie.bits2
        context = np.concatenate([self.heavy.contexts(b.words[b.u], b.words[b.v]) for b in blocks])
        v, w = (np.concatenate([tail(b.words).astype(np.uint32)[getattr(b, k)] for b in blocks]) for k in "vw")
        share2, left, share3 = np.zeros(len(v)), np.ones(len(v)), np.zeros(len(w))
        shard = shard_of(context, bits)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
        del shard
        each = np.concatenate([np.bincount(b.pair, minlength=len(b.u)) for b in blocks])
        bounds = np.concatenate(([0], np.cumsum(each)))  # of each bigram's trigrams
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            level = self.parts(f"trie-{s}", ("contexts", "first2", "next2", "first3", "next3"))
            if level is None:
                continue
            own = order[cuts[s] : cuts[s + 1]]
            new = np.ones(len(own), bool)
            new[1:] = context[own][1:] != context[own][:-1]  # bigrams of a context stand together
            found = level["contexts"].find(below(context[own[new]], bits))
            span = [np.zeros(len(found), np.int64) for _ in range(2)]
            for k, x in enumerate(level["first2"].two(found[found >= 0])):
                span[k][found >= 0] = x
            back = np.cumsum(new) - 1
            own, first, last = (x[found[back] >= 0] for x in (own, span[0][back], span[1][back]))
            place = level["next2"].among(v[own], first.astype(np.int64), last.astype(np.int64))
            own, place = own[place >= 0], place[place >= 0]
            share2[own], left[own] = law.decode(level["code2"][place]), law.decode(level["left2"][place])
            first, last = (x.astype(np.int64) for x in level["first3"].two(place))
            runs = each[own]
            mine = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(bounds[own], runs)
            place = level["next3"].among(w[mine], np.repeat(first, runs), np.repeat(last, runs))
            share3[mine[place >= 0]] = law.decode(level["code3"][place[place >= 0]])
        return share2, left, share3


def tail(hashes: np.ndarray) -> np.ndarray:
    return hashes & U64(0xFFFFFFFF)


def binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def packed_counts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and apart those that do not fit one."""
    large = count > 254
    return np.where(large, 255, count).astype(np.uint8), count[large].astype(np.int64)


def unpacked_counts(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[out == 255] = large
    return out


def dealt(sent: DataFrame, bits: int) -> DataFrame:
    """The rows of each shard together, in order of shards: a shard a task, or several where there are more than MOST_TASKS."""
    more = max(0, bits - MOST_TASKS.bit_length() + 1)
    task = F.shiftright("shard", more).cast("int")
    out = sent.repartitionById(1 << (bits - more), task)
    return out.sortWithinPartitions("shard") if more else out


def joined(table: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items()]


def build_words(train: DataFrame, folder: str, bits: int) -> DataFrame:
    """Writes level 1: (tokens, types, ends, heavy words and counts) of each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            shard = shard_of(words, bits)
            cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[s], cuts[s + 1])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), *binary(words[own], *packed_counts(counts[own]))], ["shard", "words", "counts", "large"])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                block = Block(part.column("text"), grams=False)
                more = np.bincount(block.token, minlength=len(block.words))
                words, back = np.unique(np.concatenate((words, block.words[more > 0])), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, more[more > 0])), len(words)).astype(np.int64)
                if len(words) > GATHER:
                    yield from send()
                    words, counts = words[:0], counts[:0]
        yield from send()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "shard"):
            shard = table.column("shard")[0].as_py()
            words, small, large = joined(table, words=np.uint64, counts=np.uint8, large=np.int64)
            words, back = np.unique(words, return_inverse=True)
            counts = np.bincount(back, unpacked_counts(small, large), len(words)).astype(np.int64)
            sums = np.cumsum(counts)
            save(folder, f"words-{shard}", nested("words", below(words, bits), 64 - bits) | nested("sums", sums, int(sums[-1]).bit_length()))
            heavy = counts > HEAVY
            yield pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in (sums[-1], len(words), counts[words == END].sum())), *binary(words[heavy], counts[heavy])], ["tokens", "types", "ends", "heavy", "counts"])

    sent = arrow(train, count, "shard long, words binary, counts binary, large binary")
    return stored(arrow(dealt(sent, bits), total, "tokens long, types long, ends long, heavy binary, counts binary"), "level1")


def build_trie(train: DataFrame, trie: Trie) -> DataFrame:
    """Writes levels 2 and 3: the nodes of each shard."""
    folder, bits, law = trie.folder, trie.bits2, trie.law

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy(load(folder, "heavy"))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                block = Block(part.column("text"))
                v = block.words[block.v]
                context = heavy.contexts(block.words[block.u], v)
                order = np.argsort(context, kind="stable")  # v stays sorted within a context
                each = np.bincount(block.pair, minlength=len(context))
                first = np.concatenate(([0], np.cumsum(each)))[:-1]
                context, v, first, each = context[order], v[order], first[order], each[order]
                at = np.concatenate(([0], np.cumsum(each)))
                triple = np.arange(int(at[-1])) - np.repeat(at[:-1], each) + np.repeat(first, each)
                w, counts = tail(block.words[block.w[triple]]).astype(np.uint32), block.count[triple]
                cuts = np.searchsorted(shard_of(context, bits), np.arange((1 << bits) + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    own = slice(at[a], at[b])
                    names, runs = np.unique(context[a:b], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), *binary(names, runs.astype(np.uint32), tail(v[a:b]).astype(np.uint32), each[a:b].astype(np.uint32), w[own], *packed_counts(counts[own]))], ["shard", "contexts", "runs2", "tails2", "runs3", "tails3", "counts", "large"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy(load(folder, "heavy"))
        for table in grouped(batches, "shard"):
            shard = table.column("shard")[0].as_py()
            names, runs2, tails2, runs3, tails3, small, large = joined(table, contexts=np.uint64, runs2=np.uint32, tails2=np.uint32, runs3=np.uint32, tails3=np.uint32, counts=np.uint8, large=np.int64)
            contexts, rank = np.unique(names, return_inverse=True)
            key2, node = np.unique((np.repeat(rank, runs2).astype(np.uint64) << TAIL) | tails2, return_inverse=True)
            key3, back = np.unique((np.repeat(node, runs3).astype(np.uint64) << TAIL) | tails3, return_inverse=True)
            count3 = np.bincount(back, unpacked_counts(small, large), len(key3))
            parent3, parent2 = (key3 >> TAIL).astype(np.int64), (key2 >> TAIL).astype(np.int64)
            count2 = np.bincount(parent3, count3, len(key2))
            total = heavy.totals(contexts, np.bincount(parent2, count2, len(contexts)))
            first2, first3 = np.searchsorted(parent2, np.arange(len(contexts) + 1)), np.searchsorted(parent3, np.arange(len(key2) + 1))
            levels = nested("contexts", below(contexts, bits), 64 - bits) | nested("first2", first2, len(key2).bit_length()) | nested("next2", key2, 32 + len(contexts).bit_length(), 32)
            levels |= nested("first3", first3, len(key3).bit_length()) | nested("next3", key3, 32 + len(key2).bit_length(), 32)
            levels |= {"code2": law.encode(count2 / (total[parent2] + MU2)), "left2": law.encode(MU3 / (count2 + MU3)), "code3": law.encode(count3 / (count2[parent3] + MU3))}
            save(folder, f"trie-{shard}", levels)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(contexts), len(key2), len(key3))], ["shard", "contexts", "bigrams", "trigrams"])

    sent = arrow(train, count, "shard long, contexts binary, runs2 binary, tails2 binary, runs3 binary, tails3 binary, counts binary, large binary")
    return stored(arrow(dealt(sent, bits), merge, "shard long, contexts long, bigrams long, trigrams long"), "levels")


def build(docs: DataFrame, folds: int = 7, held_out: int = 2) -> Trie:
    """Counts the training texts, those outside the held-out fold, and writes all levels."""
    folder = scratch_path(docs.sparkSession, "trie")
    train = docs.where(~is_held_out(F.col("doc_id"), folds, held_out)).select("text")
    size = train.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    bits1, bits2 = (max(0, int(np.ceil(np.log2(max(1, size / per))))) for per in (WORD_SHARD, TRIE_SHARD))
    level1 = build_words(train, folder, bits1)
    tokens, types, ends = level1.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "ends"))).first()
    law = Law(tokens, types, ends)
    # words of more than HEAVY tokens: fewer than tokens / HEAVY rows of 16 bytes, far fewer in any language
    found = [(np.frombuffer(r["heavy"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in level1.where(F.octet_length("heavy") > 0).select("heavy", "counts").toLocalIterator()]
    if ends > HEAVY:
        found.append((np.array([START]), np.array([ends])))
    words, counts = (np.concatenate([f[k] for f in found]) if found else np.empty(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(words)
    save(folder, "heavy", {"words": words[order], "counts": counts[order], "bits": np.ceil(np.log2(counts[order] / HEAVY)).astype(np.int64)})
    trie = Trie(folder, bits1, bits2, law)
    build_trie(train, trie)
    return trie


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[pa.RecordBatch, Block]]]:
    """Slices with their blocks, `most` at a time at most, fewer where they have many tokens."""
    held, tokens = [], 0
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            block = Block(part.column("text"))
            if held and (len(held) == most or tokens + len(block.token) > MOST_TOKENS):
                yield held
                held, tokens = [], 0
            held.append((part, block))
            tokens += len(block.token)
    if held:
        yield held


def score(docs: DataFrame, model: Trie, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Unigram base score and trie score (log10) of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out(F.col("doc_id"), folds, held_out).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        together = min(MOST_SLICES, max(1, (1 << model.bits2) // SHARDS_A_SLICE))
        for held in gathered(batches, together):
            shares, at2, at3 = reader.shares(*(block for _, block in held)), 0, 0
            for part, block in held:
                own2, own3 = slice(at2, at2 + len(block.u)), slice(at3, at3 + len(block.w))
                yield scored(part, block, reader.counts(block.words), shares[0][own2], shares[1][own2], shares[2][own3])
                at2, at3 = own2.stop, own3.stop

    def scored(part: pa.RecordBatch, block: Block, count: np.ndarray, share2: np.ndarray, left: np.ndarray, share3: np.ndarray) -> pa.RecordBatch:
        law = model.law
        unigram = law.unigram(count)
        count[block.words == START] = law.texts
        p = share2[block.pair_of] + (MU2 / (count + MU2))[block.before] * unigram[block.token]
        own = np.ones(len(p), bool)  # tokens after two others of their text
        own[block.at[:-1]] = False
        later = np.flatnonzero(own)
        p[later] = share3[block.triple_of[later - 1]] + left[block.pair_of[later - 1]] * p[later]
        sums = lambda v: np.add.reduceat(v, block.at[:-1])
        known, n = (count > 0)[block.token].astype(np.int64), len(block.n_tokens)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(x) for x in (block.n_tokens.astype(np.int64), sums(known), np.full(n, law.tokens, np.int64), sums(np.log10(unigram)[block.token]), sums(np.log10(p))))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return arrow(rows, run, OUT)
