"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo `folds`: the held-out rule of the contracts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def is_held_out(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether a row belongs to the held-out fold; a row without an id does not."""
    return F.coalesce(fold_of(doc_id, folds) == held_out, F.lit(False))


#: Rows of an Arrow batch: texts are long, and a batch stands in the memory of the executor and of its Python worker.
BATCH_ROWS = 1000


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS, unless the session chose a size of its own (default: 10,000).

    Spark reads the size when the plan runs, after this returns, so the session keeps the smaller one.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's free memory to the system, for it may wait for its next task a long time."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return arrow(df, run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_labels(labels: DataFrame, flag: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids, by hash order, so no arrival order matters; ids labelled more than once take their least label."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(flag).isNotNull()).groupBy("doc_id").agg(F.min(flag).cast("int").alias(flag))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column(key)[-1].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
