"""Binary files: recognising PDFs, content hashes, directory scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions.fixed import EXCLUDED_STEMS


def is_pdf(content: Column, type_: Column, url: Column, disposition: Column) -> Column:
    """PDF by declared type, address, attachment name or first bytes."""
    said = lambda c: F.coalesce(c, F.lit(False))
    return said(F.lower(type_).contains("pdf")) | said(F.lower(url).endswith(".pdf")) | said(F.lower(disposition).contains(".pdf")) | said(F.substring(content, 1, 4) == F.lit(b"%PDF"))


def by_hash(files: DataFrame, content: str, position: str) -> DataFrame:
    """One row for each distinct content: its hash, first position, copies and size."""
    return files.groupBy(F.sha2(content, 256).alias("file_hash")).agg(F.min(position).alias(position), F.count("*").alias("copies"), F.max(F.octet_length(content)).cast("long").alias("bytes"))


def stem(path: Column) -> Column:
    """A file's name without folder and extension; either slash separates."""
    return F.nullif(F.regexp_extract(path, r"([^/\\]+)\.[^./\\]+$", 1), F.lit(""))


def scan(spark: SparkSession, folders: list[str], limit: int = 0, excluded: list[str] = EXCLUDED_STEMS) -> DataFrame:
    """PDFs of several folders without the excluded ones; a limit takes the first by path (0: all, in no order).

    Only paths are sorted for a limit; contents are read for the chosen ones and never move.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folders)
    kept = files.withColumn("stem", stem(F.col("path"))).where(~F.col("stem").isin(excluded))
    if limit:
        first = [r.path for r in kept.select("path").orderBy("path").limit(limit).collect()]  # `limit` paths
        kept = kept.where(F.col("path").isin(first))
    return kept.withColumn("file_hash", F.sha2("content", 256))


def size_by_year(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files and megabytes for each year of the manifest."""
    return manifest.join(files.select("file_hash", "length"), "file_hash").groupBy("year").agg(F.count("*").alias("files"), (F.sum("length") / 1e6).alias("mb"))
