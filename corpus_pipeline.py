"""A corpus from raw documents: quality, recurring lines, near-duplicates, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alike, decontaminate, line_dedup, pieces, quality
from tidemark.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECES = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs.select(*COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first; a document of which nothing is left goes too."""
    out = line_dedup.drop_recurring_lines(docs.select(*COLUMNS)).where((F.col("n_dropped") == 0) | (F.col("n_lines") > F.col("n_dropped")))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8, and what SimHash links."""
    return alike.keep_one(docs.select(*COLUMNS), size=5, least=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_uncontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text left."""
    return pieces.encoded(docs, PIECES)


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("simhash", keep_one), ("decontaminate", drop_benchmark), ("pieces", encode)]

#: A fitted classifier, templates and best paths aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
