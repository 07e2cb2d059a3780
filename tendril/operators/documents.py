"""Decisions on extracted text: page confidence, document status, text assembly, angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 3
SUCCESS = 60.0
MIN_ANGLE = 0.5
FLAT = 10.0
MIN_ORIENTATION = 1.0


def document_status(pages: DataFrame, key: str = "doc") -> DataFrame:
    """Status and mean confidence of documents from their pages (source, confidence, word_count, error).

    Without an OCR page a document is native; if all its OCR pages failed it
    failed; else the mean of the pages with enough words decides.
    """
    ocr = F.col("source") == "ocr"
    good = ocr & F.col("error").isNull()
    read = good & (F.col("word_count") >= MIN_WORDS)
    sums = pages.groupBy(key).agg(F.count_if(ocr).alias("ocr_pages"), F.count_if(good).alias("_good"), F.count_if(read).alias("_read"), F.avg(F.when(read, F.col("confidence"))).alias("_mean"))
    status = F.when(F.col("ocr_pages") == 0, "native").when(F.col("_good") == 0, "ocr_failed").when(F.col("_read") == 0, "ocr_low_confidence").when(F.col("_mean") >= SUCCESS, "ocr_success").otherwise("ocr_low_confidence")
    mean = F.when((F.col("ocr_pages") > 0) & (F.col("_good") > 0), F.coalesce("_mean", F.lit(0.0)))
    return sums.select(key, F.col("ocr_pages"), status.alias("ocr_status"), mean.alias("mean_confidence"))


def page_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence and number of recognised words; -1 and null mark layout boxes."""
    real = F.col("confidence").isNotNull() & (F.col("confidence") != -1)
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(real, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count_if(real).alias("word_count"))


def document_text(pages: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """The non-empty pages of each document in order, with a blank line between.

    A document's pages meet in one row, so the key must be that of a real
    document; Spark's limit of 2 GB a row is the bound.
    """
    kept = pages.where(F.btrim(F.coalesce(text, F.lit(""))) != "")
    ordered = F.array_sort(F.collect_list(F.struct(position, text)))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[text]), "\n\n").alias("text"))


def skew(segments: DataFrame, key: str) -> DataFrame:
    """Median angle of near-horizontal segments (dx, dy) by page, 0 if there is none."""
    angle = F.degrees(F.atan2("dy", "dx"))
    return segments.groupBy(key).agg(F.coalesce(F.median(F.when(F.abs(angle) < FLAT, angle)), F.lit(0.0)).alias("skew_angle_deg"))


def rotation_applies(degrees: Column, confidence: Column) -> Column:
    return (degrees != 0) & (confidence >= MIN_ORIENTATION)


def deskews(angle: Column) -> Column:
    return F.abs(angle) > MIN_ANGLE


def rotation_stats(pages: DataFrame, near: float = 3.0) -> DataFrame:
    """Count, range and mean of the confidences of rotated pages, and how many are near the threshold."""
    c = F.col("orientation_confidence")
    return pages.where(F.col("orientation_rotate_deg") != 0).agg(F.count("*").alias("n"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.avg(c).alias("mean"), F.count_if(c < near).alias("near_threshold"))


def rotations(pages: DataFrame, near: float = 3.0) -> DataFrame:
    """Rotated pages by ascending confidence, those near the threshold marked."""
    c = F.col("orientation_confidence")
    turned = pages.where(F.col("orientation_rotate_deg") != 0)
    return turned.select("doc", "page_number", "orientation_rotate_deg", "orientation_confidence", F.coalesce(c < near, F.lit(False)).alias("near_threshold")).orderBy(c, "doc", "page_number")


def run_time(runs: DataFrame, seconds: str) -> DataFrame:
    """Total seconds, documents and seconds a document of a run; the denominator is at least 1."""
    total = F.coalesce(F.sum(seconds), F.lit(0.0))
    return runs.agg(total.alias("total_seconds"), F.count("*").alias("documents"), (total / F.greatest(F.count("*"), F.lit(1))).alias("mean_seconds"))


def results(pages: DataFrame, key: str = "path") -> DataFrame:
    """OCR results: status, mean confidence, text and the pages' metadata of each document, from its page rows."""
    fields = ["page_number", "source", "confidence", "skew_angle_deg", "deskewed", "orientation_rotate_deg", "orientation_confidence", "error"]
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pages"))
    status = document_status(pages, key).select(key, "ocr_status", "mean_confidence")
    texts = document_text(pages, key, "page_number", "text")
    return status.join(listed, key).join(texts, key, "left").select(key, "ocr_status", "mean_confidence", F.coalesce("text", F.lit("")).alias("text"), "pages")
