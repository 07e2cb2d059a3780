"""Relational and columnar stores: JDBC tables in, Parquet by year out, reference CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, name: str, split: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric `split` column it is read in ranges by several tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split:
        reader = reader.option("partitionColumn", split).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_by_year(df: DataFrame, path: str, year: str = "annee", rows_a_file: int = 5_000_000) -> None:
    """Parquet in a folder for each year, so that filters on the year skip the others.

    Rebalancing splits large years and joins small ones by their bytes at run time; a file holds `rows_a_file` at most.
    """
    df.hint("rebalance", year).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(year).parquet(path)


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference CSV with a header and a given schema; synthetic ones must say so in a column."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Stores a table in the catalog in buckets of a key, sorted within, and reads it.

    Tables with equal numbers of buckets join on the key without a shuffle, however often they are joined. A bucket is
    one file, as the rows are dealt to it before.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def manifest_details(manifest: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """The details of each consultation of the manifest's index, on refConsultation, under its own orgAcronyme where the details name one."""
    joined = manifest.alias("m").join(details.alias("d"), "refConsultation")
    same = F.col("d.orgAcronyme").isNull() | (F.col("d.orgAcronyme") == F.col("m.orgAcronyme"))
    return joined.where(same).select("refConsultation", "m.orgAcronyme", "m.reference", *(f"d.{f}" for f in fields))
