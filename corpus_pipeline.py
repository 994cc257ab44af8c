"""The corpus pipeline: documents to training pieces, in five stages that each work on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import compression, decontam, neardup, packing, privacy
from tessitura.llm.common import fresh, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier scores under its threshold. Null text counts as empty."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = compression.learn_quality(learn, compression.training_labels(table(spark, sf_dir, "labels")))
    spare = fresh("score", docs.columns)  # where a column of that name waits meanwhile
    scored = compression.score_quality(docs.withColumnRenamed("score", spare), model, keep_text=True)
    kept = scored.filter(F.col("score") >= compression.THRESHOLD).drop("score")
    return kept.withColumnRenamed(spare, "score").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, and one row of equal ids."""
    return neardup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain three quarters of a benchmark item's shingles."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets, and brings n_chars up to date."""
    out = privacy.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each document's token ids into pieces of binary length."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("privacy", without_private),
    ("packing", packed),
]

#: Trained models and a tokenizer decide: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
