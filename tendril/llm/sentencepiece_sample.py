"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

All ways to cut a text into pieces of a vocabulary form a lattice. A first
segmentation is drawn with the Gumbel-max trick; the next ones, without
replacement, come from an A* search over the tree of choices. A node of the
search stands for all segmentations that leave a drawn path within a range of
its choices; its perturbed score is a Gumbel at the set's log mass, truncated
at the score of the node it was split from. Backward sums over the lattice
give exact masses, so the best node always holds the next segmentation. The
(k+1)-th score is the threshold from which inclusion probabilities follow.

Pieces of a BPE model come with ranks only, so a piece's weight is
1 / (rank + ZIPF_SHIFT), the Zipf law of its rank; pass weights="scores" for
a model that holds log probabilities. A text falls apart wherever no piece has
two neighbouring characters, which keeps lattices short; equal chunks share a
lattice. Random numbers come from a hash of (row key, sample, position), so
results do not depend on partitions or retries.

Edge cases: a null or empty text has one segmentation, the empty one, with
inclusion 1; a text with fewer than k segmentations gives all of them;
characters outside the vocabulary, and a literal U+2581, become byte pieces,
so decoding gives back every text; repeated rows with one key repeat results,
and rows without an id share the key of null; equal scores do not occur but by
a chance of 2**-53; very long texts are one slice of their own, and a long run
in which no cut is possible costs one step of the backward sums a character;
an empty table gives no rows; `encode` ignores extra columns, `decode` keeps
them and replaces one named `decoded`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow
from .textvec import U64, mix64, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF_SHIFT = 2.7
SAMPLES = 2
SEED = 20
SPACE = 0x2581
#: Stands for a literal U+2581 in a text.
LITERAL = 0x110000
#: Natural log weight of each byte of a character that no piece has.
BYTE_LOG = -20.0
BYTES = -2
#: Slots of distinct chunks that a task keeps.
SLOTS = 525_000
STEP = U64(0xD6E8FEB86659FD93)
PLACE = U64(0xD1B54A32D192ED03)
NEG = -np.inf


def char_keys(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(codes.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1))


class Vocabulary:
    """Pieces by hashed prefixes, the pairs of characters that occur inside pieces, and decoding tables."""

    def __init__(self, model: str = MODEL, weights: str = "ranks"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        score = np.array([sp.get_score(i) for i in normal])
        if weights == "ranks":
            rank = np.empty(len(normal))
            rank[np.argsort(-score, kind="stable")] = np.arange(len(normal))
            score = -np.log(rank + ZIPF_SHIFT)
            score -= np.log(np.exp(score).sum())
        self.log = np.full(n + 1, NEG)  # the last one is that of no piece
        self.log[normal] = score
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [bytes([i - self.byte_ids[0]]) if sp.is_byte(i) else b"" if i not in set_ else pieces[i].replace("▁", " ").encode() for set_ in [set(normal)] for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_len)))[:-1]
        self.longest = max(len(pieces[i]) for i in normal)
        levels: list[dict[int, int]] = [{} for _ in range(self.longest)]
        alphabet = sorted({ch for i in normal if len(pieces[i]) > 1 for ch in pieces[i]})
        self.classes = np.zeros(LITERAL + 1, np.int32)
        for k, ch in enumerate(alphabet):
            self.classes[ord(ch)] = k + 1
        self.width = len(alphabet) + 1
        self.class_keys = char_keys(np.array([0, *map(ord, alphabet)]))
        self.joined = np.zeros(self.width * self.width, bool)
        keys = {ord(ch): int(v) for ch, v in zip(alphabet, char_keys(np.array([ord(c) for c in alphabet])), strict=True)}
        step, mask = int(STEP), (1 << 64) - 1
        for i in normal:
            h = 0
            for k, ch in enumerate(pieces[i]):
                key = keys.get(ord(ch))
                if key is None:
                    key = keys[ord(ch)] = int(char_keys(np.array([ord(ch)]))[0])
                h = ((h + key) * step) & mask
                levels[k].setdefault(h, -1)
                if k:
                    self.joined[self.classes[ord(pieces[i][k - 1])] * self.width + self.classes[ord(ch)]] = True
            levels[len(pieces[i]) - 1][h] = i
        self.levels = []
        for level in levels:
            h = np.array(list(level), np.uint64)
            order = np.argsort(h)
            self.levels.append((h[order], np.array(list(level.values()), np.int32)[order]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a sequence of pieces, without the leading dummy space."""
        return self._bytes(np.asarray(ids, np.int64))[1:].tobytes()

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.raw_len[ids]
        ends = np.cumsum(n)
        return self.raw[np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(self.raw_at[ids], n)]


def uniform(key: np.ndarray, sample: int, place: np.ndarray, stream: int) -> np.ndarray:
    """A number in (0, 1) for each key and place."""
    with np.errstate(over="ignore"):
        x = mix64(mix64(key + U64(sample * 8 + stream + 1) * U64(0x9E3779B97F4A7C15)) + place.astype(np.uint64) * PLACE)
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Chunks:
    """Lattices of distinct chunks, kept over the slices of a task until they hold more than SLOTS slots.

    A chunk of m characters has m + 1 slots: one for each character and its
    end. The rows of the tables hold the pieces that start at a slot by length.
    """

    def __init__(self, vocab: Vocabulary, slots: int | None = None):
        self.vocab, self.least = vocab, slots or SLOTS
        self.clear(self.least)

    def clear(self, slots: int) -> None:
        width = self.vocab.longest
        self.names, self.bases, self.used, self.room = np.empty(0, np.uint64), np.empty(0, np.int64), 0, slots
        self.end, self.codes = np.empty(slots, np.int64), np.empty(slots, np.int64)
        self.piece, self.log, self.cumulative = np.empty((slots, width), np.int32), np.empty((slots, width), np.float32), np.empty((slots, width))

    def base_of(self, names: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The first slot of each chunk (names are sorted and distinct); unknown ones are added."""
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        known = self.names[at] == names if len(self.names) else np.zeros(len(names), bool)
        new = ~known
        if self.used + int((sizes[new] + 1).sum()) > self.room:
            self.clear(max(self.least, int((sizes + 1).sum())))
            known, new, at = np.zeros(len(names), bool), np.ones(len(names), bool), np.zeros(len(names), np.int64)
        out = np.empty(len(names), np.int64)
        out[known] = self.bases[at[known]]
        if new.any():
            out[new] = self._add(starts[new], sizes[new], codes)
            names = np.concatenate((self.names, names[new]))
            order = np.argsort(names, kind="stable")
            self.names, self.bases = names[order], np.concatenate((self.bases, out[new]))[order]
        return out

    def _add(self, starts: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
        vocab, shift = self.vocab, self.used
        base = np.concatenate(([0], np.cumsum(size + 1)))
        total = int(base[-1])
        end = np.repeat(base[1:] - 1, size + 1)
        depth = np.arange(total) - np.repeat(base[:-1], size + 1)
        inside = np.arange(total) < end
        own = np.where(inside, codes[np.minimum(depth + np.repeat(starts, size + 1), len(codes) - 1)], 0)
        key = char_keys(own)
        # filled in place, for these are the largest arrays of a task
        to = slice(shift, shift + total)
        piece, log, cumulative = self.piece[to], self.log[to], self.cumulative[to]
        piece[:], log[:], cumulative[:] = -1, NEG, 0.0
        alive, h = np.flatnonzero(inside), None
        for length, (hashes, ids) in enumerate(vocab.levels, 1):
            fits = alive + length <= end[alive]
            alive = alive[fits]
            if not len(alive):
                break
            with np.errstate(over="ignore"):
                h = ((h[fits] if h is not None else U64(0)) + key[alive + length - 1]) * STEP
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[found] == h
            alive, h = alive[hit], h[hit]
            piece[alive, length - 1] = ids[found[hit]]
        bare = np.flatnonzero(inside & (piece[:, 0] < 0))
        utf8 = 1 + (own[bare] >= 0x80) + (own[bare] >= 0x800) + ((own[bare] >= 0x10000) & (own[bare] != LITERAL))
        beta = np.zeros(total + vocab.longest)
        order = np.argsort(depth.astype(np.int32), kind="stable")
        order = order[inside[order]]
        levels = np.searchsorted(depth[order], np.arange(int(size.max()) + 1))
        ahead = np.arange(1, vocab.longest + 1)
        single = np.full(total, NEG)
        single[bare] = BYTE_LOG * utf8
        for d in range(len(levels) - 2, -1, -1):
            idx = order[levels[d] : levels[d + 1]]
            v = vocab.log[piece[idx]]  # of no piece: minus infinity
            v[:, 0] = np.maximum(v[:, 0], single[idx])
            v += beta[idx[:, None] + ahead]
            top = v.max(1)
            e = np.exp(v - top[:, None])
            sums = e.sum(1)
            beta[idx] = top + np.log(sums)
            v -= beta[idx][:, None]
            log[idx] = v
            np.cumsum(e, axis=1, out=e)
            last = vocab.longest - 1 - np.argmax((v > NEG)[:, ::-1], axis=1)
            e /= sums[:, None]
            e[ahead > last[:, None]] = 2.0  # rounding never passes the last edge
            cumulative[idx] = e
        piece[bare, 0] = BYTES
        self.end[to], self.codes[to] = end + shift, own
        self.used += total
        return base[:-1] + shift


class Lattice:
    """The texts of a slice as chunks, and the slot of each place in them."""

    def __init__(self, texts: list[str | None], chunks: Chunks):
        vocab = chunks.vocab
        joined = "".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, np.int32).copy()
        codes[codes == SPACE] = LITERAL
        codes[codes == 32] = SPACE
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        n = len(codes)
        cut = np.ones(n, bool)
        kind = vocab.classes[codes]
        if n:
            cut[1:] = ~vocab.joined[kind[:-1] * vocab.width + kind[1:]]
            cut[self.offsets[:-1][sizes > 0]] = True
        self.starts = np.flatnonzero(cut)
        lens = np.diff(np.append(self.starts, n))
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text's chunks
        place = np.arange(n) - np.repeat(self.starts, lens)
        if n:
            keys = np.where(kind > 0, vocab.class_keys[kind], U64(0))
            rare = np.flatnonzero(kind == 0)
            keys[rare] = char_keys(codes[rare])
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(lens.max()) - 1, STEP))))
                name = mix64(np.add.reduceat(keys * powers[place], self.starts) + lens.astype(np.uint64))
            names, at, chunk = np.unique(name, return_index=True, return_inverse=True)
            base = chunks.base_of(names, self.starts[at], lens[at], codes)[chunk]
        else:
            base = np.empty(0, np.int64)
        #: The slot of each place.
        self.slot = place + np.repeat(base, lens)
        self.end, self.codes, self.piece, self.log, self.cumulative, self.vocab = chunks.end, chunks.codes, chunks.piece, chunks.log, chunks.cumulative, vocab

    def draw(self, place, doc, keys, sample, path) -> None:
        """Completes the chunks that hold the given places: writes edge + 1 of each piece into path at its place."""
        with np.errstate(over="ignore"):
            seeds = mix64(keys + U64(sample * 8 + 1) * U64(0x9E3779B97F4A7C15)) - self.offsets[:-1].astype(np.uint64) * PLACE
            seeds = seeds[doc]
            while len(place):
                slot = self.slot[place]
                x = mix64(seeds + place.astype(np.uint64) * PLACE)
                u = (x >> U64(11)).astype(np.float64) * 2.0**-53
                edge = np.argmax(self.cumulative[slot] > u[:, None], axis=1)
                path[place] = edge + 1
                more = slot + edge + 1 < self.end[slot]
                place, seeds = (place + edge + 1)[more], seeds[more]

    def ids(self, slot, edge) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids, and how many each choice gave."""
        got = self.piece[slot, edge]
        count = np.ones(len(got), np.int64)
        bare = np.flatnonzero(got == BYTES)
        if not len(bare):
            return got, count
        raw = [("▁" if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in self.codes[slot[bare]].tolist()]
        count[bare] = [len(x) for x in raw]
        out = np.repeat(got, count)
        out[out == BYTES] = self.vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, count


class Path:
    """One drawn segmentation of each row: the places, slots and edges of its choices and their prefix log masses."""

    def __init__(self, lat: Lattice, edges: np.ndarray):
        self.edges = edges
        self.place = np.flatnonzero(edges)
        self.slot = lat.slot[self.place]
        self.edge = edges[self.place].astype(np.int64) - 1
        self.at = np.searchsorted(self.place, lat.offsets)
        self.total = np.concatenate(([0.0], np.cumsum(lat.log[self.slot, self.edge], dtype=np.float64)))

    def mass(self, row: int, j: int) -> float:
        """Log mass of all segmentations that share the row's choices before j."""
        return self.total[j] - self.total[self.at[row]]


def log_minus(a: float, b: float) -> float:
    """log(exp(a) - exp(b)) for a >= b."""
    return a + math.log(-math.expm1(b - a)) if b < a else NEG


class Search:
    """A* over the tree of choices of one row.

    A node is a set of segmentations with its perturbed score, a Gumbel at the
    set's log mass truncated at its parent's score: (score, path, a, b, taken)
    with empty `taken` holds those that leave the path at a choice in [a, b);
    with `taken`, those that share the choices before a, then take none of it.
    """

    def __init__(self, row: int, key: int):
        self.row, self.state, self.nodes = row, key ^ 0x5851F42D4C957F2D, []

    def random(self) -> float:
        """The next number of the row's own SplitMix64 stream."""
        mask = (1 << 64) - 1
        self.state = (self.state + 0x9E3779B97F4A7C15) & mask
        x = self.state
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53

    def push(self, mass: float, top: float, node: tuple) -> None:
        if mass > NEG:
            z = mass - math.log(-math.log(self.random()))
            low, high = sorted((top, z))
            self.nodes.append((low - math.log1p(math.exp(low - high)), *node))

    def pop(self, lat: Lattice, paths: list[Path]):
        """The best node's score and where its best segmentation leaves its path: (score, path, choice index, edge)."""
        node = max(self.nodes)
        self.nodes.remove(node)
        score, s, a, b, taken = node
        path = paths[s]
        if taken:
            j = a
        else:  # the choice at which it leaves, by the masses of those that leave there
            low, high = path.mass(self.row, a), path.mass(self.row, b)
            target = self.random() * -math.expm1(high - low)
            # 1 - exp(total[j + 1] - total[a]) passes the target: total falls along the path
            j = min(int(np.searchsorted(-path.total[a + 1 : b + 1], -(path.total[a] + math.log1p(-target)), side="right")) + a, b - 1)
            while j > a and path.total[j + 1] == path.total[j]:  # no other edge there
                j -= 1
            while path.total[j + 1] == path.total[j]:
                j += 1
            taken = (int(path.edge[j]),)
            self.push(log_minus(low, path.mass(self.row, j)), score, (s, a, j, ()))
            self.push(log_minus(path.mass(self.row, j + 1), high), score, (s, j + 1, b, ()))
        p = np.exp(lat.log[path.slot[j]].astype(float))
        p[list(taken)] = 0
        edge = min(int((np.cumsum(p) <= self.random() * p.sum()).sum()), int(np.flatnonzero(p)[-1]))
        p[edge] = 0
        if p.sum() > 0:
            self.push(path.mass(self.row, j) + math.log(p.sum()), score, (s, j, j + 1, (*taken, edge)))
        return score, s, j, edge


def sample_slice(texts: list[str | None], keys: np.ndarray, chunks: Chunks, k: int = SAMPLES):
    """For each rank: (rows, ids, bounds of ids by row, log probabilities, perturbed scores); and each row's threshold."""
    lat = Lattice(texts, chunks)
    n = len(texts)
    top = -np.log(-np.log(uniform(keys, 0, np.zeros(n, np.int64), 1)))
    edges = np.zeros(len(lat.slot), np.int8)
    lat.draw(lat.starts, np.repeat(np.arange(n), np.diff(lat.first)), keys, 0, edges)
    paths = [Path(lat, edges)]
    searches = [Search(i, key) for i, key in enumerate(keys.tolist())]
    rows, out, threshold = np.arange(n), [], np.full(n, NEG)
    shared = paths[0].at[:-1]  # index of the first choice that is the newest path's own
    while True:
        path, rank = paths[-1], len(paths)
        ids, count = lat.ids(path.slot, path.edge)
        ends = np.concatenate(([0], np.cumsum(count)))[path.at]
        bounds = np.append(ends[:-1][rows], ends[-1])  # rows without a path are empty
        log = path.total[path.at[1:]] - path.total[path.at[:-1]]
        out.append((rows, ids, bounds, log[rows], top[rows]))
        following, places = [], []
        edges = np.zeros(len(lat.slot), np.int8)
        for i, j in zip(rows.tolist(), shared.tolist(), strict=True):
            search, end = searches[i], int(path.at[i + 1])
            if j < end:
                search.push(log_minus(path.mass(i, j), path.mass(i, end)), top[i], (rank - 1, j, end, ()))
            if not search.nodes:
                continue
            if rank == k:
                threshold[i] = max(search.nodes)[0]
                continue
            top[i], s, j, edge = search.pop(lat, paths)
            at, start = int(paths[s].place[j]), int(lat.offsets[i])
            edges[start:at] = paths[s].edges[start:at]
            edges[at] = edge + 1
            following.append(i)
            places.append(at)
        if rank == k or not following:
            return out, threshold
        rows, at = np.array(following), np.array(places)
        nxt = at + edges[at]
        first = np.searchsorted(lat.starts, at, side="right")
        each = lat.first[rows + 1] - first
        rest = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        inside = nxt < np.append(lat.starts, len(lat.slot))[first]  # the chunk goes on
        lat.draw(np.concatenate((nxt[inside], lat.starts[rest])), np.concatenate((rows[inside], np.repeat(rows, each))), keys, rank, edges)
        paths.append(Path(lat, edges))
        shared = np.searchsorted(paths[-1].place, at) + 1


OUT = "doc_id long, sample_rank int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded_equal boolean"


def encode(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, weights: str = "ranks", seed: int = SEED, slots: int | None = None) -> DataFrame:
    """k distinct segmentations of each text; doc_id is the row key.

    slots: what a task keeps of distinct chunks, about 270 bytes each (SLOTS if not given); more of them save work.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model, weights)
        chunks = Chunks(vocab, slots)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                texts = part.column("text").to_pylist()
                keys = part.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ranks, threshold = sample_slice(texts, keys, chunks, k)
                for rank, (at, ids, bounds, log, top) in enumerate(ranks, 1):
                    raw = vocab._bytes(ids)
                    raw_at = np.concatenate(([0], np.cumsum(vocab.raw_len[ids])))[bounds]
                    whole = raw.tobytes()
                    equal = [whole[min(a + 1, b) : b] == (texts[i] or "").encode("utf-8", "surrogatepass") for i, a, b in zip(at.tolist(), raw_at[:-1].tolist(), raw_at[1:].tolist(), strict=True)]
                    inclusion = -np.expm1(-np.exp(np.minimum(log - threshold[at], 700.0)))
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(np.full(len(at), rank, np.int32)), lists, pa.array(log), pa.array(top), pa.array(inclusion), pa.array(equal, pa.bool_())], ["doc_id", "sample_rank", "ids", "log_prob", "perturbed", "inclusion", "decoded_equal"])

    return arrow(rows, run, OUT)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds the text of each row's ids as `decoded`; null ids give a null text."""
    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x).decode("utf-8", "replace") for x in (y.values.to_numpy() if y.is_valid else None for y in batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return arrow(encoded, run, schema)
