"""A listing read as a stream: rows in cursor order, until a quota is full or a page is too old, each key once.

State is kept by category: how many rows were taken, whether the cursor has
stopped, and the keys taken, which expire. It grows with the quota, not with
the stream. A batch holds later pages than those before it; within a batch rows
come in any order. Where they are read, tasks leave out rows that the reader
can't need, so a category's task gets a quota's worth of rows from each, not
the batch.
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that stateful processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COUNT, STOP, KEY = (t.StructType([t.StructField("value", kind)]) for kind in (t.LongType(), t.BooleanType(), t.LongType()))
#: A task looks through so many rows at once, and passes on what it holds beyond the second number.
LOOKED, HELD = 100_000, 400_000


def first_rows(rows: Iterator[Row], order: list[str], key: str, room: int, skip) -> list[Row]:
    """The first `room` rows of distinct keys in order, nulls last, in one pass with room for as many; `skip` says which keys are out."""
    kept: list[tuple[tuple, Row]] = []
    place = lambda row: tuple((row[c] is None, row[c]) for c in order)
    by_key: dict = {}
    for row in rows:
        at, k = place(row), row[key]
        if room <= 0 or (len(kept) == room and at >= kept[-1][0]) or (k in by_key and by_key[k] <= at) or (k not in by_key and skip(k)):
            continue
        if k in by_key:
            kept.pop(next(i for i, (_, r) in enumerate(kept) if r[key] == k))
        elif len(kept) == room:
            by_key.pop(kept.pop()[1][key])
        bisect.insort(kept, (at, row), key=lambda x: x[0])
        by_key[k] = at
    return [row for _, row in kept]


def needed(rows: DataFrame, category: str, key: str, page: str, order: list[str], quota: int, seen_on: str | None) -> DataFrame:
    """The rows of a batch or a stream that a reader can need, found within each task.

    Those are, by category, the first rows of `quota` distinct keys, nulls last: keys taken before are at most as many
    as the rows that the quota has lost by them. With them comes a newest row of each page, unless seen_on is None. Pages
    behind the last of a full quota can't end the listing before it, so they go, if the order begins with the page.
    """
    used = list(dict.fromkeys([category, key, page, *order, *([seen_on] if seen_on else [])]))

    def cut(table: pa.Table) -> pa.Table:
        df = table.select(used).to_pandas(types_mapper=pd.ArrowDtype)
        df[category] = pd.factorize(df[category], use_na_sentinel=False)[0]  # null is a category
        df = df.iloc[pc.sort_indices(table, [(c, "ascending") for c in order])]
        first = df.drop_duplicates([category, key]).groupby(category).head(quota)
        at = first.index
        if seen_on:
            if order[0] == page:
                own = first.groupby(category)[page]
                last = own.last().where(own.size() >= quota)
                df = df[~(df[page] > df[category].map(last)).fillna(False)]
            newest = df[df[seen_on].notna()].sort_values(seen_on, ascending=False).drop_duplicates([category, page])
            at = at.union(newest.index)
        return table.take(pa.array(at.sort_values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, n = None, [], 0
        for batch in batches:
            fresh.append(batch)
            n += batch.num_rows
            if n >= max(LOOKED, held.num_rows if held else 0):
                held, fresh, n = cut(pa.concat_tables([*([held] if held else []), pa.Table.from_batches(fresh)])), [], 0
                if held.num_rows > HELD:
                    yield from held.to_batches()
                    held = None
        if held or fresh:
            yield from cut(pa.concat_tables([*([held] if held else []), *([pa.Table.from_batches(fresh)] if fresh else [])])).to_batches()

    return rows.mapInArrow(run, rows.schema)


class Harvester(StatefulProcessor):
    def __init__(self, key: str, page: str, order: list[str], seen_on: str, oldest: dt.date | None, quota: int, expire_ms: int | None):
        self.key, self.page, self.order, self.seen_on = key, page, order, seen_on
        self.oldest, self.quota, self.expire_ms = oldest, quota, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", COUNT)
        self.stopped = handle.getValueState("stopped", STOP)
        self.seen = handle.getMapState("seen", KEY, STOP, ttlDurationMs=self.expire_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if self.stopped.exists():
            return
        taken = self.taken.get()[0] if self.taken.exists() else 0
        newest: dict[int, dt.date | None] = {}  # by page of this batch

        def noted() -> Iterator[Row]:
            for row in rows:
                day, page = row[self.seen_on], row[self.page]
                if self.oldest is not None:
                    newest[page] = max(filter(None, (newest.get(page), day)), default=None)
                yield row

        found = first_rows(noted(), self.order, self.key, self.quota - taken, lambda k: self.seen.containsKey((k,)))
        # a page whose newest row is too old ends the listing, itself left out
        end = min((p for p, day in newest.items() if day is not None and day < self.oldest), default=None)
        for row in found:
            if end is not None and row[self.page] >= end:
                break
            self.seen.updateValue((row[self.key],), (True,))
            taken += 1
            yield row
        self.taken.update((taken,))
        if end is not None or taken >= self.quota:
            self.stopped.update((True,))

    def close(self) -> None:
        pass


def harvest(rows: DataFrame, category: str, key: str, page: str, order: list[str], quota: int, seen_on: str, oldest: dt.date | None = None, expire: dt.timedelta | None = None) -> DataFrame:
    """The rows of a stream that a reader takes by category: at most `quota`, each key (a long) once, none from the first page on whose newest row is older than `oldest`.

    order: the cursor's order of rows. expire: how long a key is remembered (None: for ever). Sets the session's state store to the one it needs.
    """
    rows.sparkSession.conf.set(*STATE_STORE)
    few = needed(rows, category, key, page, order, quota, None if oldest is None else seen_on)
    taker = Harvester(key, page, order, seen_on, oldest, quota, None if expire is None else int(expire.total_seconds() * 1000))
    mode = "None" if expire is None else "processingTime"
    return few.groupBy(category).transformWithState(statefulProcessor=taker, outputStructType=rows.schema, outputMode="Append", timeMode=mode)


def award_outcomes(consultations: DataFrame, awards: DataFrame, key: str, published: str, awarded: str, horizon: str, late: str) -> DataFrame:
    """Two streams: consultations with their awards of the `horizon` after publication; those without one once no award can come any more.

    Rows may come `late` behind the newest of their side. Both sides are bounded by watermarks, so state older than the
    horizon goes. The award's key column is dropped.
    """
    one = consultations.withWatermark(published, late).alias("c")
    two = awards.withWatermark(awarded, late).withColumnRenamed(key, "_award_key").alias("a")
    span = F.col(awarded).between(F.col(published), F.col(published) + F.expr(f"INTERVAL {horizon}"))
    return one.join(two, (F.col(f"c.{key}") == F.col("_award_key")) & span, "left_outer").drop("_award_key")
