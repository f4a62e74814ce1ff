"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; its result is written
as Parquet to shared storage and read again as the next stage's docs, so a lost executor costs at most a
part of one stage. All stages but the last return the columns of documents.

Cases: an empty table passes through every stage; rows with a null text are judged as empty texts by the
classifier; without labels nothing is rejected for quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woodlot.llm import bpe, decontaminate, line_dedup, near_dups, quality_knn
from woodlot.llm.common import documents, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours do not vote out."""
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.score(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without their sites' boilerplate lines; n_chars follows the text."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dups.dedupe(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]

#: The classifier, the signatures and the encoder have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
