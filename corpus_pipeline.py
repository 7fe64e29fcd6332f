"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.

Defined results: a null text is empty; a null source or lang is a value of its
own; rows that repeat an id share one decision of the classifier (kept if one of
them is), rows without an id likewise; of equal texts, and of near copies, one row
stays, also where rows or ids repeat; documents without words are never taken by
the mix; an empty table gives no rows; columns beyond those of documents are left
out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm import exact_dedup, mixing, ngram_join, packing, quality
from kinetrail.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scores = quality.classify(docs, table(spark, sf_dir, "labels"))
    # one decision per document, also where a row is repeated
    rejected = scores.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept")
    rejected = rejected.select(F.col("doc_id").alias("__id"))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["__id"]), "left_anti").select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest, then first, of equal texts stays."""
    return exact_dedup.survivors(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.one_of_each(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model, hashed draws and token ids are beyond SQL: the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
