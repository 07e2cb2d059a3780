"""Sharding by longest-processing-time scheduling: groups stay together, shards get near equal bytes.

Groups (equal texts) are sorted by size and each goes to the least loaded
shard of a heap. On a cluster this has two levels: groups are dealt to
partitions by descending size, as many as the rows ask for, each partition
packs its groups by LPT into lanes as it streams over them, and the driver runs
LPT over the lanes, MAX_LANES numbers at most, however many groups there are.
With one partition and as many lanes as shards it is plain LPT.

Rows find their group's shard by a join. Groups of very many rows, at most
HOT_GROUPS of them by their share of all rows, are broadcast, so no task gets
all copies of a text. Slots are counted in parts of a shard, by a hash of the
row and its place.

Edge cases: a null text has size 8 and the group of the empty text; a group
larger than a shard's fair share gets a shard with little else, for groups are
never cut; very long texts are groups like others; repeated rows, with or
without an id, count as often as they stand there and stay together; ties go to
the lower shard number; an empty table gives an empty result; columns of the
input with other names are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import stored

from .common import arrow

SHARDS = 24
#: Rows that a task of a sort should take, lanes of all partitions at most, and hot groups at most.
TASK_ROWS, MAX_LANES, HOT_GROUPS = 250_000, 1 << 18, 100_000
#: Rows from which a group can be hot.
HOT_ROWS = 1000
OVERHEAD = 8


def lpt(sizes: list[int], bins: int) -> tuple[list[int], list[int]]:
    """The bin of each size, largest first to the least loaded bin, and the loads."""
    heap = [(0, b) for b in range(bins)]
    out, loads = [0] * len(sizes), [0] * bins
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, b = heapq.heappop(heap)
        out[i], loads[b] = b, load + sizes[i]
        heapq.heappush(heap, (loads[b], b))
    return out, loads


def lanes(groups: DataFrame, key: str, size: str, partitions: int, width: int) -> DataFrame:
    """(key, part, lane, size) of each group: LPT within partitions of descending size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, part = [(0, b) for b in range(width)], TaskContext.get().partitionId()
        for batch in batches:
            chosen = []
            for n in batch.column(size).to_pylist():
                load, b = heap[0]
                heapq.heapreplace(heap, (load + n, b))
                chosen.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([part] * len(chosen), pa.int32()), pa.array(chosen, pa.int32()), batch.column(size)], [key, "part", "lane", size])

    dealt = groups.select(key, size).repartitionByRange(partitions, F.desc(size), F.asc(key)).sortWithinPartitions(F.desc(size), F.asc(key))
    return arrow(dealt, pack, f"{key} binary, part int, lane int, {size} long")


def assign(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None, width: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("group"))
    rows = stored(sized.withColumn("_place", F.monotonically_increasing_id()), "sizes")
    n_rows = rows.count()
    partitions = partitions or max(1, min(-(-n_rows // TASK_ROWS), MAX_LANES // shards))
    width = width or MAX_LANES // 16 // partitions if partitions * shards < MAX_LANES // 16 else shards
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    packed = stored(lanes(groups, "group", "bytes", partitions, width), "lanes")
    loads = packed.groupBy("part", "lane").agg(F.sum("bytes").alias("bytes")).orderBy("part", "lane").collect()
    chosen, _ = lpt([r["bytes"] for r in loads], shards)
    # at most partitions * width rows
    bins = spark.createDataFrame([(r["part"], r["lane"], b) for r, b in zip(loads, chosen, strict=True)], "part int, lane int, shard int")
    where = packed.join(F.broadcast(bins), ["part", "lane"]).select("group", "shard")
    hot = groups.where(F.col("rows") > max(HOT_ROWS, n_rows // HOT_GROUPS)).select("group")
    hot = F.broadcast(stored(where.join(F.broadcast(hot), "group"), "hot"))  # HOT_GROUPS rows at most, as their rows are among n_rows
    many = rows.join(hot, "group")
    few = rows.join(hot.select("group"), "group", "left_anti").join(where, "group")
    kept = ["doc_id", "size", "text_crc32", "shard", "_place"]
    placed = stored(many.select(kept).unionByName(few.select(kept)), "placed")
    parts = max(1, -(-n_rows // (TASK_ROWS * shards)))
    return numbered(placed, parts).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(placed: DataFrame, parts: int) -> DataFrame:
    """Adds gapless slots from 0 within each shard, without gathering a shard in one task."""
    split = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32", "_place"), F.lit(parts)).cast("int"))
    counts = split.groupBy("shard", "_part").agg(F.count("*").alias("_n"))  # shards * parts rows
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size", "_place")
    return split.join(F.broadcast(starts), ["shard", "_part"]).withColumn("slot", F.col("_start") + F.row_number().over(own) - 1)
