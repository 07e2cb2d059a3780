"""N-gram Jaccard join by chosen paths, and the classes of near-duplicates it gives.

A text is the set of its five-word shingles; its tokens are its least shingles
under many random orders, on each of which two sets agree with a probability
equal to their similarity. In a run every set starts at the root; a node of
more than LEAF sets splits on sampled tokens: 1 / threshold orders on average
(the whole part always, one more with the probability of the rest, by the
node's hash), and a set goes to a child for its token under each. So a pair at
the threshold shares one child on average, however deep the tree goes, and its
chance to meet in a leaf falls like 1 / depth, not like threshold ** depth.
Runs have orders of their own, hence are independent, and repeat until a pair
at the threshold has met with probability `recall`; closer pairs meet more.
A child that keeps more than STALL of its parent's sets is dense: its sets are
alike, no token tells them apart, and it is a leaf whatever its size; below the
root its sets get no second child of this parent, the others do.
Sets that share a leaf are compared by brute force. In a leaf of LEAF sets at
most those that agree with no other on enough orders drop out first; a leaf
of more than BLOCK sets, or of more than BLOCK_SHINGLES shingles, is cut into
blocks, and every pair of blocks is compared in a group of its own, so a task
holds a bounded number of sets and shingles at once (or two very long texts),
and no pair is lost. The exact check counts common shingles.

Texts with equal shingle sets are one node from the start. Comparison emits,
for each set, its number of links and the least set of its component in the
leaf, never the pairs; a pair counts in the first of the leaves it shares.
Components over leaves come from alternating stars.

Edge cases: a text without words is linked to nothing; one of one to four
words is the one shingle of all its words; very long texts are one slice of
their own; repeated rows and equal texts share a class and count as links of
each other; a class is named by its least doc_id; rows without an id are
linked like others, and a class of such rows alone has the name null; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tendril.session import shared_dir, stored

from .common import arrow, free_name, grouped, map_arrow
from .textvec import ALNUM, LOWER, U64, Words, mix64, slices, text_bytes, window_hashes

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 4
#: A pair at the threshold fails the comparison of tokens with at most this probability.
SKETCH_LOSS = 1e-7
LEAF = 400
#: The share of its parent's sets beyond which a child is dense.
STALL = 0.6
#: Sets, and shingles of all sets together, of a block of a large leaf.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Sets that share a key, up to which their pairs are counted one by one.
FEW = 24
#: Ids that may be broadcast: 16 bytes each.
BROADCAST_ROWS = 200_000


def children(threshold: float) -> tuple[int, float]:
    """The orders a node always splits on, and the probability of one more: 1 / threshold on average."""
    whole = math.floor(1 / threshold + 1e-9)
    return whole, max(0.0, 1 / threshold - whole)


def meeting(similarity: float, threshold: float, depth: int) -> float:
    """The probability that a pair meets in a leaf of one run after `depth` splits: survival of a branching process."""
    whole, more = children(threshold)
    lost = 0.0
    for _ in range(depth):
        child = 1 - similarity + similarity * lost  # that the pair is not, or no longer, together in one child
        lost = child**whole * (1 - more + more * child)
    return 1 - lost


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold was together in a leaf of `depth` splits with probability `recall`."""
    met = meeting(threshold, threshold, depth)
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def agree_for(threshold: float, orders: int, loss: float = SKETCH_LOSS) -> int:
    """The most orders on which sets must agree so that a pair at the threshold agrees on fewer with a probability of at most `loss`."""
    below = 0.0
    for k in range(orders + 1):
        below += math.comb(orders, k) * threshold**k * (1 - threshold) ** (orders - k)
        if below > loss:
            return k
    return orders


def shingle_sets(array: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their bounds by row."""
    data, offsets = text_bytes(array)
    words = Words(data, offsets, ALNUM)
    hashes = words.hashes(LOWER)
    wins, _, rows = window_hashes(hashes, words.bounds, width)
    extra_h, extra_r = [wins], [rows]
    for n in range(1, width):  # texts shorter than a window
        short = np.flatnonzero(words.counts == n)
        if len(short):
            at = words.bounds[short]
            got, _, _ = window_hashes(hashes[(at[:, None] + np.arange(n)).ravel()], np.arange(len(short) + 1) * n, n)
            extra_h.append(got)
            extra_r.append(short)
    h, r = np.concatenate(extra_h), np.concatenate(extra_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(words.counts) + 1))


def set_names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from the sum of its mixed members."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ U64(0xA5A5A5A5A5A5A5A5)))))
        sums = total[bounds[1:]] - total[bounds[:-1]]
        return mix64(sums + np.diff(bounds).astype(np.uint64))


def sketches(docs: DataFrame, coordinates: int) -> DataFrame:
    """doc_id, the set's name and size, and the least shingle under each of `coordinates` random orders."""
    factors = mix64(np.arange(1, coordinates + 1, dtype=np.uint64)) | U64(1)
    shifts = mix64(np.arange(1001, coordinates + 1001, dtype=np.uint64))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            h, bounds = shingle_sets(part.column("text"))
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            least = np.zeros((len(size), coordinates), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    for c in range(coordinates):
                        x = (h ^ shifts[c]) * factors[c]
                        x ^= x >> U64(32)
                        least[full, c] = np.minimum.reduceat(x * factors[c], bounds[:-1][full])
            names = set_names(h, bounds).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * coordinates), pa.array(least.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(size.astype(np.int64)), lists], ["doc_id", "sid", "n", "least"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, sid long, n long, least array<long>")


def split(nodes: DataFrame, level: int, depth: int, threshold: float, orders: range) -> DataFrame:
    """nodes: (run, path, sid, least, above). (run, above, parent, path, sid) of the children for some of the orders a node may split on."""
    whole, more = children(threshold)
    width = whole + (more > 0)

    def child(k: int):
        token = F.element_at("least", (F.col("run") * depth + level) * width + k + 1)
        path = F.xxhash64("path", F.lit(k), token)
        chosen = F.pmod(F.xxhash64("path", F.lit(1000 + k)), F.lit(1 << 20)) < int(more * (1 << 20))
        return path if k < whole else F.when(chosen, path)

    path = child(orders[0]) if len(orders) == 1 else F.explode(F.array_compact(F.array(*map(child, orders))))
    return nodes.select("run", "above", F.col("path").alias("parent"), path.alias("path"), "sid").where("path is not null")


def leaves(nodes: DataFrame, runs: int, depth: int, leaf: int, threshold: float, stall: float) -> DataFrame:
    """(path, sid): the leaves of each set in all runs, without sets that are alone."""
    whole, more = children(threshold)
    always, extra = range(whole), range(whole, whole + (more > 0))
    least = nodes.select("sid", "least")
    # above: the sets of the node that is split; the root counts as endless
    at = least.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "sid", "least").withColumns({"path": F.xxhash64("run"), "above": F.lit(1 << 62)})
    done = []
    for level in range(depth):
        large = []
        # below the root, the sets of a dense child need no further one: it would hold the same sets again
        for orders in [range(whole + len(extra))] if level == 0 else [always, extra] if extra else [always]:
            # a count per path, so what moves is a few numbers for each set and run
            paths = split(at if level == 0 else at.join(least, "sid"), level, depth, threshold, orders)
            sizes = stored(paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
            paths = stored(paths.join(sizes, "path"), "level")
            dense = F.col("size") > stall * F.col("above")
            ends = F.lit(level == depth - 1) | (F.col("size") <= leaf) | dense
            done.append(paths.where(ends).select("path", "sid"))
            large.append(paths.where(~ends).select("run", F.col("size").alias("above"), "path", "sid"))
            if level and orders is always:
                at = at.join(paths.where(dense).select(F.col("parent").alias("path"), "sid"), ["path", "sid"], "left_anti")
        more_sets = reduce(DataFrame.unionByName, large)
        if level == depth - 1 or more_sets.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = more_sets


def distinct_leaves(found: DataFrame) -> DataFrame:
    """(path, sid, size) of leaves of more than one set; of those with equal members, one."""
    each = found.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("name"))
    best = each.where("size > 1").groupBy("size", "name").agg(F.min("path").alias("path"))
    return found.join(best.select("path", "size"), "path").select("path", "sid", "size")


def spread(members: DataFrame, block: int, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(group, path, sid, side): a leaf is a group; one of more than `block` sets, or `shingles` shingles if `total` counts them, a group for each pair of its blocks.

    side is 0 if all pairs of the group count, else 1 or 2: then those of unlike sides do.
    """
    total = F.coalesce("total", F.lit(1)) if "total" in members.columns else F.lit(1)
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(total / shingles)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), F.lit(0)).when(F.col("own") < F.col("other"), F.lit(1)).otherwise(2)
    # blocks i < j meet in the group (i, j); those pairs within a block meet in (i, i)
    return rows.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "path", "sid", side.alias("side"))


def promising(members: DataFrame, nodes: DataFrame, threshold: float, orders: int) -> DataFrame:
    """(path, sid): the members of small leaves that agree with another one there on enough orders and may have a similar size."""
    needed = agree_for(threshold, orders)
    rows = members.join(nodes.select("sid", "n", "least"), "sid").repartition("path").sortWithinPartitions("path", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "path"):
            lists = pa.concat_arrays(table.column("least").chunks)
            least = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, orders)
            size = table.column("n").to_numpy()
            agree = np.zeros((len(size), len(size)), np.uint8 if orders < 256 else np.uint16)
            for c in range(orders):
                agree += least[:, c][:, None] == least[:, c][None, :]
            good = (agree >= needed) & (size[:, None] >= threshold * size[None, :]) & (size[None, :] >= threshold * size[:, None])
            np.fill_diagonal(good, False)
            hit = pa.array(np.flatnonzero(good.any(1)))
            if len(hit):
                yield table.select(["path", "sid"]).take(hit).combine_chunks().to_batches()[0]

    return arrow(rows.select("path", "sid", "n", "least"), run, "path long, sid long")


def overlaps(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many keys each two of n sets share (the diagonal says nothing); keys of one set stand together, as many as its size."""
    n = len(sizes)
    _, column = np.unique(keys, return_inverse=True)
    member = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    member, column = member[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common = np.zeros((n, n), np.float32)
    often = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(often)))[:-1]
    for d in np.unique(often[often <= FEW]).tolist():  # keys of few sets, pair by pair
        i, j = np.triu_indices(d, 1)
        own = first[often == d]
        for k in range(0, len(own), (1 << 22) // (d * d)):
            at = own[k : k + (1 << 22) // (d * d), None]
            one, two = member[at + i].ravel(), member[at + j].ravel()
            np.add.at(common, (one, two), 1)
            np.add.at(common, (two, one), 1)
    many = often[column] > FEW if len(column) else np.zeros(0, bool)
    member, column = member[many], np.unique(column[many], return_inverse=True)[1]
    wide = 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, wide):  # the others by matrix products
        lo, hi = np.searchsorted(column, (a, a + wide))
        block = np.zeros((n, min(wide, int(column[-1]) + 1 - a)), np.float32)
        block[member[lo:hi], column[lo:hi] - a] = 1
        common += block @ block.T
    return common


def compare(keys: np.ndarray, sizes: np.ndarray, copies: np.ndarray, earlier: np.ndarray, n_earlier: np.ndarray, side: np.ndarray | None, threshold: float):
    """Links among the sets of a group: for each set the weight and number of those counted here, its local component, and whether it has any.

    earlier: the leaves before this one that each set is in (n_earlier of them); a pair that shares one counts there.
    side: None compares all pairs, else only those of side 1 with side 2.
    """
    n, strip = len(sizes), 512
    common = overlaps(keys, sizes)
    linked = np.empty((n, n), bool)
    for a in range(0, n, strip):
        total = sizes[a : a + strip, None] + sizes[None, :] - common[a : a + strip]
        linked[a : a + strip] = common[a : a + strip] >= threshold * total - 1e-6
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    has = linked.any(1)
    root, weight, count = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if has.any():
        while True:  # the least index in reach, with shortcuts
            low = root.copy()
            for a in range(0, n, strip):
                low[a : a + strip] = np.minimum(low[a : a + strip], np.where(linked[a : a + strip], root[None, :], n).min(1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        if len(earlier):
            linked &= overlaps(earlier, n_earlier) == 0
        count = linked.sum(1)
        for a in range(0, n, strip):
            weight[a : a + strip] = np.rint(linked[a : a + strip].astype(np.float64) @ copies.astype(np.float64)).astype(np.int64)
    return weight, count, root, has


def links(docs: DataFrame, nodes: DataFrame, found: DataFrame, orders: int, leaf: int, block: int, shingles: int, threshold: float) -> DataFrame:
    """(sid, root, weight, n): for each set and group, its links there and the least set of its component."""
    first = stored(distinct_leaves(found), "leaves")
    small = promising(first.where(F.col("size") <= leaf), nodes, threshold, orders)
    kept = stored(small.unionByName(first.where(F.col("size") > leaf).select("path", "sid")), "promising")
    members = stored(distinct_leaves(kept), "members")
    paths = members.groupBy("sid").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # a few for each run
    wanted = stored(nodes.select("sid", "doc_id", "copies").join(paths, "sid"), "wanted")
    ids = wanted.where("doc_id is not null").select(F.col("sid").alias("want"), "doc_id")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            h, bounds = shingle_sets(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            same = pa.array(set_names(h, bounds).view(np.int64) == part.column("want").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column("want"), lists], ["sid", "shingles"]).filter(same)

    def nameless_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            h, bounds = shingle_sets(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_names(h, bounds).view(np.int64)), lists], ["sid", "shingles"])

    hashed = map_arrow(texts, sets, "sid long, shingles array<long>")
    nameless = wanted.where("doc_id is null").select("sid")
    if not nameless.isEmpty():  # sets that only rows without an id have, each once
        own = map_arrow(docs.where(F.col("doc_id").isNull()).select("text"), nameless_sets, "sid long, shingles array<long>")
        hashed = hashed.unionByName(own.join(nameless, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles")))
    long = members.join(nodes.select("sid", "n"), "sid").groupBy("path").agg(F.sum("n").alias("total")).where(F.col("total") > shingles)
    rows = spread(members.join(long, "path", "left"), block, shingles).join(wanted.select("sid", "copies", "paths"), "sid").join(hashed, "sid")
    rows = rows.select("group", "side", "sid", "copies", F.filter("paths", lambda p: p < F.col("path")).alias("earlier"), "shingles")
    rows = rows.repartition("group").sortWithinPartitions("group", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "group"):
            sid = table.column("sid").to_numpy()
            keep = np.ones(len(sid), bool)
            keep[1:] = sid[1:] != sid[:-1]  # repeated rows of one id give a set twice
            table = table.filter(pa.array(keep)).combine_chunks()
            if table.num_rows < 2:
                continue
            lists, earlier = (pa.concat_arrays(table.column(c).chunks) for c in ("shingles", "earlier"))
            size, before = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, earlier))
            keys, old = (x.flatten().to_numpy(zero_copy_only=False) for x in (lists, earlier))
            side, sid = table.column("side").to_numpy(), table.column("sid").to_numpy()
            weight, count, root, any_link = compare(keys, size, table.column("copies").to_numpy(), old, before, side if side.any() else None, threshold)
            hit = np.flatnonzero(any_link)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(sid[root[hit]]), pa.array(weight[hit]), pa.array(count[hit].astype(np.int64))], ["sid", "root", "weight", "n"])

    return arrow(rows, run, "sid long, root long, weight long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for all nodes of the edges (u, v), by alternating large and small stars until nothing changes."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("u"), F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def classified(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK, shingles: int = BLOCK_SHINGLES, stall: float = STALL) -> DataFrame:
    """A row for each document: doc_id, class_id, n_links, n_shingles, its set (sid) and the set its class goes by (root; null without words)."""
    shared_dir(docs.sparkSession)
    runs = runs_for(threshold, recall, depth)
    orders = runs * depth * math.ceil(1 / threshold - 1e-9)
    named = stored(sketches(docs, orders), "sketches")
    worded = named.where("n > 0")
    nodes = stored(worded.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("least").alias("least")), "nodes")
    found = stored(leaves(nodes, runs, depth, leaf, threshold, stall), "found")
    linked = stored(links(docs, nodes, found, orders, leaf, block, shingles, threshold), "links")
    root = components(linked.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    weights = linked.groupBy("sid").agg(F.sum("weight").alias("weight"))
    classes = nodes.select("sid", "doc_id", "copies").join(root.withColumnRenamed("v", "sid"), "sid", "left").join(weights, "sid", "left")
    classes = classes.withColumn("root", F.coalesce("root", "sid"))
    heads = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(heads, "root").select("sid", "root", "class_id", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = worded.select("doc_id", "sid", "n").join(classes, "sid").select("doc_id", "class_id", "n_links", F.col("n").alias("n_shingles"), "sid", "root")
    alone = named.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), "sid", F.lit(None).cast("long").alias("root"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links (documents linked to this one) and n_shingles."""
    return classified(docs, **options).select("doc_id", "class_id", "n_links", "n_shingles")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that of the least doc_id, with the columns of docs; documents without words stay.

    Rows of one id are one document. Rows without an id go if their class has an id, else one of them stays.
    """
    classes = stored(classified(docs, **options), "classes")
    drop = classes.where("doc_id <> class_id").select("doc_id").distinct()
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    kept = docs.where(F.col("doc_id").isNotNull()).join(drop, "doc_id", "left_anti").select(*docs.columns)
    rest = docs.where(F.col("doc_id").isNull())
    if rest.isEmpty():
        return kept
    sid, root = free_name(docs, "sid"), free_name(docs, "root")

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            h, bounds = shingle_sets(part.column("text"))
            worded = pa.array(np.diff(bounds) == 0)
            yield part.append_column(sid, pa.array(set_names(h, bounds).view(np.int64), mask=worded.to_numpy(zero_copy_only=False)))

    schema = StructType([*docs.schema.fields, StructField(sid, LongType())])
    named = map_arrow(rest, name, schema)
    roots = classes.where("doc_id is null and class_id is null and root is not null").select(F.col("sid").alias(sid), F.col("root").alias(root)).distinct()
    first = named.join(roots, sid).groupBy(root).agg(F.min_by(F.struct(*docs.columns), F.struct(sid, "text")).alias("first")).select("first.*")
    return kept.unionByName(named.where(F.col(sid).isNull()).select(*docs.columns)).unionByName(first)


def oracle(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """DuckDB SQL for near_duplicates(documents): all pairs that share a shingle, and what each text reaches over links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS s FROM worded),
member AS (SELECT r, unnest(s) AS g FROM sets),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM member a JOIN member b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE c >= {threshold} * (len(a.s) + len(b.s) - c) - 1e-6),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
class AS (SELECT x, min(doc_id) AS class_id FROM reach JOIN sets ON sets.r = reach.y GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM edge GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(len(s) AS BIGINT) AS n_shingles
FROM sets JOIN class ON class.x = sets.r LEFT JOIN degree ON degree.x = sets.r"""
