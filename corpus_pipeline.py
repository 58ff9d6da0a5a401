"""A corpus from raw documents: quality filter, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import jaccard, packing, quality, suffixes
from gneiss.llm.bloom import maybe_in
from gneiss.llm.store import persisted


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, scores at 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles, the one of smallest doc_id.

    Documents without words and rows with a null id stay; so do rows that repeat the id of a document that stays.
    """
    gone = jaccard.join(docs, k=5, percent=80).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = persisted(gone, "gone")
    maybe = maybe_in(gone)("doc_id")  # the others need no join
    return docs.where(maybe).join(gone, docs["doc_id"] == F.col("_gone"), "left_anti").unionAll(docs.where(~maybe))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that stand in more than one place; emptied ones go."""
    out = suffixes.cleaned(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None  # a learned classifier and tokenizer ids can't be expressed in SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
