"""Corpus pipeline: toxicity filter, near-duplicate removal, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. Null texts count as empty and stay; rows of a null id stay where a stage
cannot compare them; an empty table passes through all stages.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.llm import jaccard, packing, suffixdedup, toxicity
from graphloom.llm.catalog import BYTES
from graphloom.llm.sparkio import fold, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, under a model of the labelled ones outside the held-out third.

    Null and empty texts score 0 and stay, as do repeated rows and rows of a null id that score low; without labels of
    both kinds all stay; an empty table stays empty. Columns beyond COLUMNS go.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.learn(docs, labels, may_learn=fold("doc_id", 3) != 1)
    return toxicity.keep(docs.select(*COLUMNS), model, threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group that links of 5-word shingles at 0.8 connect.

    Null and empty texts are linked with nothing and stay, as do rows of a null id; of repeated rows one stays; an empty
    table stays empty. Columns beyond COLUMNS go.
    """
    return jaccard.representatives(docs.select(*COLUMNS), percent=80).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document of a smaller id has; one with nothing left stays, empty.

    lang and source are the id's (the smallest, if rows of one id differ); n_chars is counted anew. A null text becomes
    empty; rows of a null id neither remove nor lose anything; an empty table stays empty.
    """
    left = suffixdedup.without_repeats(docs, width=50)
    about = docs.groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("about"))
    both = left.join(about, left["doc_id"].eqNullSafe(about["doc_id"]), "left").select(left["doc_id"], "text", "about.lang", "about.source")
    return both.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: every row in some, a null or empty text as its end alone; none of an empty table."""
    return packing.pack(docs, public_tokenizers.path(BYTES), length=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("packing", pack)]

#: No SQL: the first stage fits a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
