"""Corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. The first three return the columns of documents; a text that loses repeated
passages gets a new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafseek.llm import entries, near_copies, packing, substring, toxicity
from leafseek.llm.common import documents, materialize, small_batches


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each near-duplicate group of texts; all columns of it stay.

    Texts are near whose sets of 5-word shingles have a similarity of 0.8 or
    more. Candidates come from SimHash fingerprints of these shingles, through the
    operator of ``op1_simhash``, and from MinHash bands where texts differ in more
    bits than it links; the shingles decide. Decisions are by row, not by doc_id:
    of rows that share a doc_id one of each group stays, so texts that are not
    near keep theirs. Rows without a doc_id belong to no group and stay.
    """
    small_batches(spark)
    return near_copies.keep_first(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that documents of smaller doc_id hold too."""
    small_batches(spark)
    kept = substring.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(packing.cut(docs, entries.word_vocabulary()))


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("repeated_passages", unrepeated), ("packing", packed)]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
