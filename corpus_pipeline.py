"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import _shared, exact_dedup, packing, quality, simhash, substrings


_RUN = "pipeline"


def _stage(function):
    """A stage whose tables are deleted when the next one begins, which has what this one wrote."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _shared.release(_RUN)
        with _shared.run(_RUN):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; if all labelled documents are of one kind none does."""
    return quality.keep_good(docs, _shared.table(spark, sf_dir, "labels"))


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; other documents' texts stay as they are. n_chars still tells the length before."""
    return substrings.without_repeats(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; stages between are settled in the shared folder."""
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if (name, stage) == STAGES[-1]:
            return out
        docs = _shared.settle(out, name.replace(" ", "-"))
    return docs


#: A trained classifier, tokenisation and packing are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None
