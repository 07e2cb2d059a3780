"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window of a document has as many words as a benchmark item. Its features are
its five-word shingles, each weighted by the length of its words, and its
fingerprint is the 128-bit SimHash of these. Fingerprints of the items are cut
into 8 blocks of 16 bits; by the pigeonhole principle two fingerprints at most
RADIUS apart agree in some block up to RADIUS // 8 bits, and each block's table
lists the items for all such values, so every item within the radius is found.
Candidates are then compared exactly, by the weighted Jaccard similarity of
their shingles. The radius itself is a SimHash's promise, not a proof: of
single windows just over a similarity of 0.8 it holds 99 % or more (in the
tests 99.6 % for items of 14 words, 99.7 % for 24, all of 600 for 80); more
similar windows, and neighbours of a window, miss less.

A window without any shingle of an item has similarity 0 to it, so windows are
fingerprinted only where a shingle of some item stands; that loses nothing.
Votes are summed along runs of such windows, RUN shingles at a time, so their
work space does not grow with the text or the item.
The benchmark is a stated query set. Of at most `items` items and
BENCHMARK_BYTES it is broadcast. A larger one is dealt to buckets of about
`items` items: one pass over the documents finds those that hold one of an
item's rarest shingles, of which a similar window holds one at least (a bitmap
sized by the benchmark first, then a join of shingles), and each such document
meets those items' buckets, so the corpus is read once, whatever the size of
the benchmark, and a shingle of very many items is looked for by none of them.

Edge cases: null and empty texts, and items without a word, match nothing; an
item of fewer than five words is one shingle of all its words; a document
shorter than an item is one window; of equally similar windows the first
counts; repeated documents or items each give their rows; a document without
an id is compared and gives a null id; an empty table on either side gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import scratch_path, stored

from .common import arrow, free_name, map_arrow
from .textvec import ALNUM, LOWER, U64, Words, mix64, slices, text_bytes, window_hashes

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 31
BLOCKS = 8
#: Items and bytes of text that a task may hold at once, and items of one index.
ITEMS, BENCHMARK_BYTES, INDEX_ITEMS = 5000, 16 << 20, 1000
#: Shingles, and windows, that are worked on at once.
RUN, WINDOWS = 4096, 1 << 16
#: Bits of the map of the items' shingles: so many for each, within these powers of two. It only saves work.
MAP_BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Parts that the texts of a bucket are dealt to.
SHARES = 8
#: Ids that may be broadcast.
BROADCAST_ROWS = 200_000


def votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each shingle's weighted vote on the 128 bits."""
    both = np.column_stack((hashes, mix64(hashes ^ U64(0x5555555555555555)))).astype(">u8")
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), 16), axis=1)
    return (2 * bits.astype(np.int64) - 1) * weights[:, None]


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """128-bit SimHashes, as rows of 16 bytes, of the shingles starts[i] ... starts[i] + length - 1; starts rise."""
    out = np.empty((len(starts), 16), np.uint8)
    a = 0
    while a < len(starts):
        s = int(starts[a])
        b = int(np.searchsorted(starts, s + RUN))
        total = np.zeros(128, np.int64)
        for k in range(s, s + length, RUN):
            stop = min(k + RUN, s + length)
            total += votes(hashes[k:stop], weights[k:stop]).sum(0)
        moved = np.zeros((int(starts[b - 1]) - s + 1, 128), np.int64)
        n = len(moved) - 1
        if n:  # a step leaves one shingle and takes the next
            np.cumsum(votes(hashes[s + length : s + length + n], weights[s + length : s + length + n]) - votes(hashes[s : s + n], weights[s : s + n]), axis=0, out=moved[1:])
        out[a:b] = np.packbits(total + moved[starts[a:b] - s] > 0, axis=1)
        a = b
    return out


class Index:
    """Items by the values of their fingerprints' blocks, up to RADIUS // BLOCKS differing bits."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = prints.view(">u2").astype(np.int64)
        near = RADIUS // BLOCKS
        flips = np.array([sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(16), k)], np.int64)
        items = np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))
        self.tables = []
        for b in range(BLOCKS):
            values = (blocks[:, b][:, None] ^ flips).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((items[order], np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << 16))))))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of all pairs at most RADIUS apart."""
        blocks = prints.view(">u2").astype(np.int64)
        pairs = []
        for b, (items, at) in enumerate(self.tables):
            first, n = at[blocks[:, b]], at[blocks[:, b] + 1] - at[blocks[:, b]]
            query = np.repeat(np.arange(len(prints)), n)
            pairs.append(query * len(self.prints) + items[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])
        query, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        distance = np.bitwise_count(prints[query] ^ self.prints[item]).sum(1, dtype=np.int64)
        near = distance <= RADIUS
        return query[near], item[near], distance[near]


def shingled(array: pa.Array, widths: list[int]):
    """The words of the texts, and for each width the shingles' hashes, weights and bounds by row."""
    data, offsets = text_bytes(array)
    words = Words(data, offsets, ALNUM)
    hashes = words.hashes(LOWER)
    letters = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    out = {}
    for width in widths:
        wins, at, rows = window_hashes(hashes, words.bounds, width)
        out[width] = wins, letters[at + width] - letters[at], np.searchsorted(rows, np.arange(len(words.counts) + 1))
    return words.counts, out


class Items:
    """A pass's share of the benchmark: shingles, fingerprints and indexes by (width, words)."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        counts, by_width = shingled(pa.array(texts, pa.string()), list(range(1, WIDTH + 1)))
        self.ids, self.groups, self.sets = ids, {}, {}
        self.known = {}
        for i, n in enumerate(counts.tolist()):
            if not n:
                continue
            width = min(n, WIDTH)
            h, w, bounds = by_width[width]
            own, weight = h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]
            print_ = fingerprints(own, weight, np.zeros(1, np.int64), len(own))[0]
            names, first = np.unique(own, return_index=True)
            self.sets[i] = names, int(weight[first].sum())
            self.groups.setdefault((width, n), []).append((i, print_))
            self.known.setdefault(width, []).append(names)
        self.widths = sorted(self.known)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in self.known.items()}
        self.maps = {}
        for width, names in self.known.items():
            self.maps[width] = np.zeros(1 << 20, bool)
            self.maps[width][(names >> U64(44)).astype(np.int64)] = True
        self.sizes: dict[tuple[int, int], np.ndarray] = {}
        for (width, n), members in self.groups.items():  # shingles of the items of a size
            self.sizes[width, n] = np.unique(np.concatenate([self.sets[i][0] for i, _ in members]))
        self.indexes = {k: [([i for i, _ in v[a : a + INDEX_ITEMS]], Index(np.array([p for _, p in v[a : a + INDEX_ITEMS]]))) for a in range(0, len(v), INDEX_ITEMS)] for k, v in self.groups.items()}

    def anchored(self, array: pa.Array):
        """(row, words of the row, width, item words, starts of windows, hashes, weights) wherever an item's shingle stands."""
        counts, by_width = shingled(array, self.widths)
        for width in self.widths:
            h, w, bounds = by_width[width]
            hit = np.flatnonzero(self.maps[width][(h >> U64(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.known[width], h[hit]), len(self.known[width]) - 1)
            hit = hit[self.known[width][found] == h[hit]]
            row_of = np.searchsorted(bounds, hit, side="right") - 1
            cuts = np.flatnonzero(np.diff(row_of)) + 1
            for part in np.split(hit, cuts) if len(hit) else []:
                row = int(np.searchsorted(bounds, part[0], side="right") - 1)
                a, b = int(bounds[row]), int(bounds[row + 1])
                for (own, n), names in self.sizes.items():
                    if own != width:
                        continue
                    at = part[np.isin(h[part], names)] - a
                    if not len(at):
                        continue
                    length = min(n - width + 1, b - a)  # shingles of a window; a shorter text is one window
                    lo, hi = np.maximum(at - length + 1, 0), np.minimum(at, b - a - length)
                    lo[1:] = np.maximum(lo[1:], hi[:-1] + 1)  # windows once, in order
                    each = np.maximum(hi - lo + 1, 0)
                    starts = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
                    if len(starts):
                        yield row, width, n, length, starts, h[a:b], w[a:b]

    def matches(self, array: pa.Array, threshold: float):
        """(row, item, first word, words, similarity, distance): the best window of each item in each text."""
        for row, width, n, length, starts, h, w in self.anchored(array):
            best: dict[int, tuple] = {}
            for k in range(0, len(starts), WINDOWS):
                part = starts[k : k + WINDOWS]
                prints = fingerprints(h, w, part, length)
                for members, index in self.indexes[width, n]:
                    for q, item, distance in zip(*(x.tolist() for x in index.within(prints)), strict=True):
                        names, total = self.sets[members[item]]
                        s = int(part[q])
                        own, first = np.unique(h[s : s + length], return_index=True)
                        weight = w[s : s + length][first]
                        common = int(weight[np.isin(own, names, assume_unique=True)].sum())
                        similarity = common / (int(weight.sum()) + total - common)
                        if similarity >= threshold:
                            best[members[item]] = max(best.get(members[item], (0.0, 0)), (similarity, -s, distance))
            for item, (similarity, s, distance) in sorted(best.items()):
                yield row, self.ids[item], -s, length + width - 1, similarity, distance


OUT = "doc_id long, item_id long, first_word long, n_window_words long, similarity double, distance int"


def rows_of(part: pa.RecordBatch, index: Items, threshold: float) -> Iterator[pa.RecordBatch]:
    got = list(index.matches(part.column("text"), threshold))
    if got:
        row, item, first, words, similarity, distance = zip(*got, strict=True)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(words, pa.int64()), pa.array(similarity, pa.float64()), pa.array(distance, pa.int32())], ["doc_id", "item_id", "first_word", "n_window_words", "similarity", "distance"])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items: int = ITEMS) -> DataFrame:
    """One row for each benchmark item that a document holds, with its best window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > items or size > BENCHMARK_BYTES:
        return leaks_by_bucket(rows, asked, threshold, max(2, -(-n // items), -(-size // BENCHMARK_BYTES)))
    held = asked.orderBy("item_id", "text").toArrow()  # at most `items` rows and BENCHMARK_BYTES
    ids, texts = held.column("item_id").to_pylist(), held.column("text").to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield from rows_of(part, index, threshold)

    return arrow(rows, find, OUT)


def item_shingles(asked: DataFrame, threshold: float) -> DataFrame:
    """(name, bucket) of the shingles by which texts are sent to the items' buckets: of each item the rarest in the benchmark.

    A window that is similar enough holds the item's shingles but for a share of 1 - threshold of their weight. So of any
    shingles that weigh more than that it holds one, and the rest, common ones above all, need not be looked for.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            counts, by_width = shingled(part.column("text"), list(range(1, WIDTH + 1)))
            buckets, items = part.column("bucket").to_numpy(), part.column("item").to_numpy()
            for width, (h, w, bounds) in by_width.items():
                row = np.repeat(np.arange(len(counts)), np.diff(bounds))
                own = np.minimum(counts, WIDTH)[row] == width
                yield pa.RecordBatch.from_arrays([pa.array(items[row[own]]), pa.array(buckets[row[own]]), pa.array(h[own].view(np.int64)), pa.array(w[own].astype(np.int64))], ["item", "bucket", "name", "weight"])

    numbered = asked.select("text", "bucket", F.xxhash64("item_id", "text").alias("item"))
    found = stored(map_arrow(numbered, run, "item long, bucket int, name long, weight long").groupBy("item", "bucket", "name").agg(F.max("weight").alias("weight")), "items-shingles")
    often = found.groupBy("name").agg(F.count("*").alias("often"))
    of_item = Window.partitionBy("item", "bucket")
    before = F.coalesce(F.sum("weight").over(of_item.orderBy("often", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.join(often, "name").select("name", "bucket", before.alias("before"), F.sum("weight").over(of_item).alias("total"))
    return ranked.where(F.col("before") <= (1 - threshold) * F.col("total") + 1e-6).select("name", "bucket").distinct()


def leaks_by_bucket(rows: DataFrame, asked: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """The same rows for a benchmark that no task could hold: documents meet the buckets whose shingles they hold."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "benchmark")
    asked.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(folder)
    names = stored(item_shingles(spark.read.schema("item_id long, text string, bucket int").parquet(folder), threshold), "item-shingles")
    map_bits = min(max(math.ceil(math.log2(MAP_BITS_EACH * max(names.count(), 1))), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned("name", 64 - map_bits)
    words = names.select(F.shiftright(place, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(name, {64 - map_bits}) & 63 as int))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (MOST_BITS - 6) rows at most
    bitmap = np.zeros(1 << (map_bits - 6), np.uint64)
    bitmap[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def probe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batch, "text"):
            counts, by_width = shingled(part.column("text"), list(range(1, WIDTH + 1)))
            found: list[list[np.ndarray]] = [[] for _ in range(len(counts))]
            for h, _, bounds in by_width.values():
                at = h >> U64(64 - map_bits)
                hit = np.flatnonzero(known[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1))
                row = np.searchsorted(bounds, hit, side="right") - 1
                for r in np.unique(row).tolist():
                    found[r].append(np.unique(h[hit[row == r]]))
            some = [r for r, x in enumerate(found) if x]
            if some:
                lists = pa.array([np.concatenate(found[r]).view(np.int64) for r in some], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(some)) for c in ("doc_id", "text")), lists], ["doc_id", "text", "names"])

    anchored = map_arrow(rows, probe, "doc_id long, text string, names array<long>")
    anchored = stored(anchored.withColumn("row", F.monotonically_increasing_id()), "anchored")
    met = stored(anchored.select("row", F.explode("names").alias("name")).join(names, "name").select("row", "bucket").distinct(), "met")
    # texts move last, once for each bucket that they meet; a bucket that many meet spans tasks
    share = F.pmod(F.xxhash64("row"), F.lit(SHARES)).cast("int")
    dealt = anchored.select("row", "doc_id", "text").join(met, "row").repartition("bucket", share).sortWithinPartitions("bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        bucket, index = None, None
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and own[a] != bucket:
                    bucket = int(own[a])
                    held = pq.read_table(f"{path}/bucket={bucket}", filesystem=fs, partitioning=None).sort_by([("item_id", "ascending"), ("text", "ascending")])
                    index = Items(held.column("item_id").to_pylist(), held.column("text").to_pylist())
                for part in slices(batch.slice(a, b - a), "text"):
                    yield from rows_of(part, index, threshold)

    return arrow(dealt.select("bucket", "doc_id", "text"), find, OUT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a leak, with the columns of docs. Rows of one id are one document; a row without an id is one by itself."""

    def clean(rows: DataFrame, key: str) -> DataFrame:
        drop = stored(leaks(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(key)).distinct(), "leaks")
        if drop.count() <= BROADCAST_ROWS:
            drop = F.broadcast(drop)
        return rows.join(drop, key, "left_anti").select(*docs.columns)

    kept = clean(docs.where(F.col("doc_id").isNotNull()), "doc_id")
    rest = docs.where(F.col("doc_id").isNull())
    if rest.isEmpty():
        return kept
    number = free_name(docs, "number")
    return kept.unionByName(clean(stored(rest.withColumn(number, F.monotonically_increasing_id()), "without-ids"), number))


def oracle(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """DuckDB SQL for leaks(documents, benchmark) without `distance`: every window with a shingle of the item, compared exactly."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    cut = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))"
    weight = "coalesce(list_sum(list_transform({}, lambda g: strlen(replace(g, ' ', '')))), 0)"
    return f"""
WITH item AS (SELECT row_number() OVER () AS i, item_id, w, least({width}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
item_set AS (SELECT i, item_id, k, len(w) AS n, list_distinct({cut}) AS s FROM item),
item_known AS (SELECT i, item_id, k, n, s, {weight.format('s')} AS total FROM item_set),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
cut AS (SELECT r, doc_id, k, len(w) AS n_words, {cut} AS g FROM doc, (SELECT DISTINCT k FROM item) WHERE len(w) >= k),
anchor AS (SELECT DISTINCT r, i, pos FROM (SELECT r, k, unnest(g) AS x, unnest(range(len(g))) AS pos FROM cut) c JOIN (SELECT i, k, unnest(s) AS x FROM item_known) t USING (k, x)),
span AS (SELECT r, i, pos, least(item_known.n - item_known.k + 1, len(g)) AS size, len(g) AS all_size FROM anchor JOIN item_known USING (i) JOIN cut USING (r, k)),
start AS (SELECT DISTINCT r, i, size, unnest(range(greatest(pos - size + 1, 0), least(pos, all_size - size) + 1)) AS a FROM span),
own AS (SELECT r, i, a, size, doc_id, item_id, item_known.k, s, total, list_distinct(g[a + 1:a + size]) AS o FROM start JOIN item_known USING (i) JOIN cut USING (r, k)),
scored AS (SELECT r, i, a, size + k - 1 AS n_window_words, doc_id, item_id, total, {weight.format('o')} AS mine, {weight.format('list_intersect(o, s)')} AS common FROM own),
best AS (SELECT *, CAST(common AS DOUBLE) / CAST(mine + total - common AS DOUBLE) AS similarity FROM scored)
SELECT doc_id, item_id, CAST(a AS BIGINT) AS first_word, CAST(n_window_words AS BIGINT) AS n_window_words, similarity
FROM best WHERE similarity >= {threshold} QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY similarity DESC, a) = 1"""
