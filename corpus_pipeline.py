"""From raw documents to packed token sequences: five operators one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docveil.llm import dartminhash, kneserney, linededup, packing, toxicity
from docveil.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trigram model doesn't reject."""
    return kneserney.keep_good(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text."""
    return linededup.with_lengths(linededup.remove_boilerplate(docs, min_chars=linededup.EVERY_LINE).drop("lines_removed"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate class."""
    return dartminhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", clean), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Tokenizing, signatures and fitted models can't be written in SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
