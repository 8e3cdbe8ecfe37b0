"""The corpus operators as queries over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, dartminhash, kmtree, kneserney, langid, linededup, packing, pagediff, sapieces, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), words=True).drop("uid")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kmtree.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("uid")


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_boilerplate(table(spark, sf_dir, "documents"), min_chars=linededup.EVERY_LINE)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sapieces.round_trip(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_neighbours, op3_language, op4_toxicity, op5_search, op6_packing, op7_line_dedup, op8_sentencepiece, op9_html, op10_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {}
