"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. The first three return the columns of
documents (n_chars is kept true to the text); the last returns the packed pieces.

Odd rows, in every stage: a null text is judged as an empty one and stays null until it is packed (as the
end id alone); rows without a doc_id are judged by their text and are no one's duplicate; rows that repeat
with one doc_id are one document and stay or go together, rows of one doc_id with different texts are each
judged; very long texts are gone through whole; an empty table stays empty; without labels of both classes
nothing is toxic. Columns other than doc_id, text and n_chars pass through as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, near_dup, packing, suffix_dedup, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't call toxic; rows without a doc_id are judged by their text, as all are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = common.materialise(toxicity.learn(docs, labels.filter(~toxicity.held_out(F.col("doc_id")))))
    return toxicity.keep_clean(docs, model)


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: similarity 0.8 or more over five-word shingles."""
    kept = near_dup.near_duplicates(docs, words=5, percent=80).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; one of which nothing is left goes, unless it was empty before.

    A cut can fall inside a character; the bytes of it that are left are dropped.
    """
    return suffix_dedup.without_repeats(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", stage_toxicity), ("near_dup", stage_near_dup), ("suffix_dedup", stage_suffix_dedup), ("packing", stage_packing)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return docs
