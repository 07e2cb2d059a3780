"""A corpus pipeline: quality rules, language ID, near-duplicates, decontamination, sampled encodings.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame. run() writes each result as Parquet in the
shared folder, reads it again for the next stage, and deletes what a stage
wrote on its way, and its input, once its result is there.

Rows without a doc_id are judged like others, each by itself; repeated rows get
equal verdicts, and near-duplicates keep all rows of the id they keep; empty
tables stay empty; very long texts are worked on whole; extra columns of the
documents pass through all but the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm import chosen_path, decontaminate, language_zstd, quality_gbt, sentencepiece_sample
from tendril.session import delete, scope, scratch_path
from tendril.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the trees; null and empty texts go."""
    return quality_gbt.keep_good(docs, quality_gbt.fit(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a certain language, which becomes their lang; null texts and those without a letter go."""
    return language_zstd.keep_certain(docs, language_zstd.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id, or a row without one where the class has none; texts without words are no duplicates."""
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; of documents with one id, all go if one has a passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encodings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with digests of their pieces; an empty text has one, the empty one."""
    out = sentencepiece_sample.encode(docs)
    return out.select("doc_id", "sample_rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", "decoded_equal")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encodings),
]

#: Trees, compression and sampling are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"), keep=True)
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
