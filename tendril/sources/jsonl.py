"""JSON-lines manifests: tolerant, silent and strict scans, ordered append, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tendril.functions import text as T
from tendril.functions.fixed import RECORD_ORDER
from tendril.operators.relational import first_wins
from tendril.session import delete
from tendril.sources import sinks
from tendril.sources.binary import stem

MANIFEST = t.StructType([t.StructField(n, t.IntegerType() if n == "year" else t.StringType()) for n in ("reference", "date_publication", "year", "pdf_url", "local_path", "file_hash", "scraped_at", "categorie_principale", "mode_passation", "acheteur_public", "objet")])
OCR = "pdf_path string, ocr_status string, mean_confidence double, pages array<struct<page_number int, source string, confidence double, skew_angle_deg double, deskewed boolean, orientation_rotate_deg int, orientation_confidence double, error string>>"


def scan(spark: SparkSession, path: str, schema: t.StructType = MANIFEST, mode: str = "tolerant") -> DataFrame:
    """mode: tolerant keeps bad lines in _corrupt, silent drops them, strict fails on the first."""
    reader = spark.read
    if mode == "tolerant":
        schema = t.StructType([*schema.fields, t.StructField("_corrupt", t.StringType())])
        return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return reader.schema(schema).option("mode", {"silent": "DROPMALFORMED", "strict": "FAILFAST"}[mode]).json(path)


def manifest_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row of each consultation, counts): counts has usable rows and skipped ones (bad lines or no keys)."""
    ref, org = T.url_keys(F.col("pdf_url"))
    keyed = rows.withColumns({"refConsultation": ref, "orgAcronyme": org, "reference_key": T.normalize_reference(F.col("reference"))})
    usable = F.col("refConsultation").isNotNull() & F.col("orgAcronyme").isNotNull()
    counts = keyed.agg(F.count_if(usable).alias("usable"), F.count_if(~usable).alias("skipped"), F.count_distinct("reference_key").alias("references"))
    return first_wins(keyed.where(usable), ["refConsultation"], [F.col("scraped_at").asc_nulls_last(), F.col("pdf_url")]), counts


def write_index(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes the first row of each consultation as Parquet; gives the counts of usable, key-less and malformed lines, taken on the way.

    One pass over the scan where manifest_index and its counts make two.
    """
    met = Observation()
    ref, org = T.url_keys(F.col("pdf_url"))
    keyed = rows.withColumns({"refConsultation": ref, "orgAcronyme": org})
    bad = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    usable = ref.isNotNull() & org.isNotNull() & ~bad
    counts = {"usable": usable, "without_keys": ~usable & ~bad, "malformed": bad}
    seen = keyed.observe(met, *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))
    first_wins(seen.where(usable), ["refConsultation"], [F.col("scraped_at").asc_nulls_last(), F.col("pdf_url")]).write.parquet(path)
    return met.get


def append(records: DataFrame, path: str) -> None:
    """Appends records with the known fields first, in order, and all others after them."""
    known = [c for c in RECORD_ORDER if c in records.columns]
    records.select(*known, *(c for c in records.columns if c not in known)).write.mode("append").option("ignoreNullFields", "false").json(path)


def todo(records: DataFrame, field: str = "categorie_principale") -> DataFrame:
    """Records that lack a field, which are still to be enriched."""
    return records.where(F.col(field).isNull())


def enrich(manifest: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """Fills empty fields of the manifest from details by pdf_url; rewrite() puts the result in its place."""
    joined = manifest.alias("m").join(details.alias("d"), "pdf_url", "left")
    return joined.select(*(F.coalesce(f"m.{c}", f"d.{c}").alias(c) if c in fields else F.col(f"m.{c}" if c != "pdf_url" else c).alias(c) for c in manifest.columns))


def rewrite(records: DataFrame, path: str) -> None:
    """Writes records beside a JSON-lines folder, then swaps it in; a failed write leaves the old one, and records may come from it."""
    spark = records.sparkSession
    fresh, old = f"{path}.new", f"{path}.old"
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(fresh)
    delete(spark, old)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place(path)):
        fs.rename(place(path), place(old))
    fs.rename(place(fresh), place(path))
    delete(spark, old)


def ocr_files(results: DataFrame) -> DataFrame:
    """(name, content): STEM.txt and STEM.json of each result (path, ocr_status, mean_confidence, text, pages), for a sink of files."""
    body = F.to_json(F.struct(F.col("path").alias("pdf_path"), "ocr_status", "mean_confidence", "pages"), {"ignoreNullFields": "false"})
    one = lambda kind, value: F.struct(F.concat(stem(F.col("path")), F.lit(kind)).alias("name"), value.cast("binary").alias("content"))
    return results.select(F.inline(F.array(one(".txt", F.coalesce("text", F.lit(""))), one(".json", body))))


def write_ocr(results: DataFrame, folder: str) -> DataFrame:
    """Writes the text and the metadata of each result as files, all or none, for other programs; Spark reads results from Parquet. Gives the files' names."""
    return sinks.write_files(ocr_files(results), folder)


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page of stored OCR results."""
    docs = spark.read.schema(OCR).option("multiLine", "true").json(path)
    return docs.select("pdf_path", "ocr_status", "mean_confidence", F.explode("pages").alias("p")).select("pdf_path", "ocr_status", "mean_confidence", "p.*")


def checkpoint_state(spark: SparkSession, path: str) -> DataFrame:
    """Saved cursors as (category, page, per_year, seen); an unreadable file gives no rows, a fresh start."""
    kind = "map<string, struct<page: int, per_year: map<string, int>, seen: array<string>>>"
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.explode(F.from_json("value", kind)).alias("category", "s")).select("category", "s.page", "s.per_year", "s.seen")


def save_checkpoint(state: DataFrame, path: str) -> None:
    """Writes cursors (category, page, per_year, seen), a row for each category, as one JSON file."""
    entries = F.collect_list(F.struct("category", F.struct("page", "per_year", F.array_sort("seen").alias("seen"))))
    whole = state.groupBy().agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)  # a row for the few categories
