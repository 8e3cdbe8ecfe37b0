"""Findings of round 2 on what the corpus operators write and compute."""

import os
import random

from pyspark.sql import functions as F

from docveil.llm import wordlm
from docveil.llm.common import shared_folder


def prose(seed, texts, words):
    rng = random.Random(seed)
    kinds = ["the", "of", *("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000))]
    return [" ".join(rng.choices(kinds, [900, 500, *[1] * 3000], k=words)) + "." for _ in range(texts)]


def test_trigrams_are_sent_packed(spark):
    texts = prose(3, 40, 3000)
    trusted = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, half int").coalesce(1)
    rows = wordlm.sent(trusted, 3, {}).agg(F.sum(F.length("data"))).first()
    assert rows[0] < 8 * 40 * 3000  # a row for each trigram and bigram was some 40 bytes a word


def test_dealt_words_and_rounds_change_nothing(spark, monkeypatch):
    texts = prose(5, 30, 300)
    docs = spark.createDataFrame([*enumerate(texts), (98, ""), (99, None), (3, texts[3])], "uid long, text string").repartition(4)
    trusted = docs.where(F.col("uid") % 2 == 0)
    left = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith(("trusted-", "word-model-", "word-shards-", "chunks-"))}
    before = left()
    scored = lambda: {r["uid"]: (round(r["nll"], 6), r["chars"]) for r in wordlm.scores(docs, trusted).collect()}
    whole = scored()
    monkeypatch.setattr(wordlm, "COUNT_WORDS", 500)
    monkeypatch.setattr(wordlm, "ROUND_DOCS", 8)
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    shards, heavy = wordlm.often_asked(trusted.select("text", half))
    assert shards > 1 and len(heavy) >= 2  # "the" and "of"
    assert scored() == whole and len(whole) == 30
    assert left() == before  # nothing that grows stays behind
