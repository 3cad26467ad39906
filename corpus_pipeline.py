"""A training-corpus pipeline over the documents table: five stages, each one operator of shopspark.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that stay, with the
columns of documents; the last returns their piece ids. Each stage sees all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopspark.llm import op1_jaccard, op4_sentencepiece, op5_exact, op8_decontam, op9_quality
from shopspark.llm.common import checkpointed, read_table

#: Near duplicates: runs of five words, at least 80 % of the union shared.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labelled ones among docs) doesn't reject; see op9_quality.keep_good for nulls."""
    return op9_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, of repeated rows one; a null text counts as empty; see op5_exact.survivors."""
    return op5_exact.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id; rows without an id stay, and so do null and
    empty texts, which link with nothing. A row goes with every row of its id: the stages before leave one row per id and text."""
    found = op1_jaccard.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none and stay."""
    return op8_decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number, and whether decoding gives the text back; a null text counts as empty and has no ids."""
    out = op4_sentencepiece.encode(docs, decoded=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.xxhash64("decoded") == F.col("_h")).alias("lossless"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontaminated), ("sentencepiece", pieces)]

#: No SQL: the classifier and the lattice can't be expressed; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
