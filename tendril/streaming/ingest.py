"""Resumable ingest: a file stream, new keys only, appended once each.

The keys seen so far have no bound in time, so they are the stored table, not
a watermark's state. The table is cut into PARTS by a hash of the key: each
micro-batch is deduplicated (the first row by its other columns wins),
anti-joined with the parts its keys fall in, and appended under a folder of its
batch id, which a replay overwrites. Rows without a key cannot be told apart
and are all kept, as often as they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tendril.operators.relational import first_wins
from tendril.session import scratch_path

#: Parts of the stored table.
PARTS = 64


def ingest(spark: SparkSession, source: str, root: str, keys: list[str], schema: StructType) -> StreamingQuery:
    """A query over new Parquet files of a folder (or one file); run it again with the same root and it goes on where it was."""
    table = f"{root}/table"
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    keyless = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))

    def append(batch: DataFrame, batch_id: int) -> None:
        others = [F.col(c).asc_nulls_last() for c in batch.columns if c not in keys] or [F.lit(0)]
        own = first_wins(batch, keys, others).withColumn("part", part)
        if _exists(spark, table):
            met = [r.part for r in own.where(~keyless).select("part").distinct().collect()]  # PARTS numbers at most
            seen = spark.read.parquet(table).where((F.col("batch") < batch_id) & F.col("part").isin(met))
            own = own.join(seen.select("part", *keys), ["part", *keys], "left_anti")
        own.select(*batch.columns, "part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/batch={batch_id}")

    return stream_of(spark, source, schema).writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(append).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    folder, _, name = source.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    return stream.parquet(source) if _status(spark, source).isDirectory() else stream.option("pathGlobFilter", name).parquet(folder)


def ingest_once(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Ingests all that is there now and returns the table."""
    root = scratch_path(spark, "ingest")
    schema = spark.read.parquet(path).schema
    ingest(spark, path, root, keys, schema).awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/table").select(*schema.names)


def _status(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def late_awards(spark: SparkSession, awards: DataFrame, consultations: DataFrame) -> DataFrame:
    """A stream of awards joined to the stored consultations; the delay between them has no bound, so one side is static."""
    return awards.join(consultations, "ref_id", "left")


def windowed_counts(events: DataFrame, minutes: int = 60, delay: str = "1 hour") -> DataFrame:
    """Events by type and window, late ones up to a delay; works on streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"))
