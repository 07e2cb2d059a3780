"""The registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.tables import table

from . import chosen_path, decontaminate, elias_fano_lm, language_zstd, license_join, lpt_shards, lyndon_runs, quality_gbt, sentencepiece_sample, source_divergence, toxic_segments, two_fit_packing, warc


def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gbt.score(docs, quality_gbt.fit(docs, table(spark, sf_dir, "labels")))


def op6_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards.assign(table(spark, sf_dir, "documents"))


def op7_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return elias_fano_lm.score(docs, elias_fano_lm.build(docs))


def op8_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_zstd.predict(docs, language_zstd.fit(docs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "record_id")


def op10_sentencepiece_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each text: their lengths, digests, scores and whether they decode to the text."""
    out = sentencepiece_sample.encode(table(spark, sf_dir, "documents"), slots=1_500_000)  # alone on its executors, it may keep more
    return out.select("doc_id", "sample_rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "decoded_equal")


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_segments.score(docs, toxic_segments.fit(docs, table(spark, sf_dir, "labels")))


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs and of the collapsed texts, whose rewritten ends repeat."""
    return lyndon_runs.find(table(spark, sf_dir, "documents"), rewrite=True, collapsed=False).drop("runs", "collapsed")


def op13_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit_packing.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_gbt": op1_quality_gbt,
    "op2_toxic_segments": op2_toxic_segments,
    "op3_license_join": op3_license_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_chosen_path": op5_chosen_path,
    "op6_lpt_shards": op6_lpt_shards,
    "op7_elias_fano_lm": op7_elias_fano_lm,
    "op8_language_zstd": op8_language_zstd,
    "op9_warc": op9_warc,
    "op10_sentencepiece_sample": op10_sentencepiece_sample,
    "op11_source_divergence": op11_source_divergence,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_two_fit_packing": op13_two_fit_packing,
}

ORACLES: dict[str, str] = {
    "op3_license_join": license_join.oracle(),
    "op4_decontaminate": decontaminate.oracle(),
    "op5_chosen_path": chosen_path.oracle(),
    "op9_warc": warc.oracle(),
    "op11_source_divergence": source_divergence.oracle(),
}
