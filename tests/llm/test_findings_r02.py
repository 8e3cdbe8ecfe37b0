"""Findings of round 2 on the corpus operators."""

import os

from pyspark.sql import functions as F

from docveil.llm import kneserney, wordlm
from docveil.llm.common import shared_folder


def test_word_model_is_cut_by_its_rows_and_leaves_no_ngrams_behind(spark, monkeypatch):
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(400)) for k in range(1, 7)]  # few documents, many n-grams
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    stored = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith(("ngrams-", "bigrams-", "words-"))}
    before = stored()
    scored = lambda: {r["uid"]: (round(r["nll"], 6), r["chars"]) for r in wordlm.scores(docs, docs.where(F.col("uid") < 4)).collect()}
    whole = scored()
    monkeypatch.setattr(wordlm, "SHARD_ROWS", 100)
    assert scored() == whole and len(whole) == 6
    assert stored() == before


def test_discounts_need_no_row_for_each_ngram():
    assert kneserney.discounts_of(4e9, 1e9, 5e8, 2e8)[1] > 0.05  # as counted at tens of gigabytes
