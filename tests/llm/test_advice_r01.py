"""Findings of the first review: the word model and the quantiles of op1_quality, short lines of op7_line_dedup."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docveil.llm import kneserney, queries, wordlm


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "uid long, text string")


def brute(texts, half, asked, d, base, spell):
    """nll of each (text, half) under plain dictionaries."""
    grams = Counter()
    for t, h in zip(texts, half, strict=True):
        w = ["", "", *re.findall(r"\w+|[^\w\s]+|\n+", t)]
        grams.update((h, *w[k - 2 : k + 1]) for k in range(2, len(w)))
    two, one = Counter((h, v, w) for h, _, v, w in grams), Counter()
    one.update((h, w) for h, _, w in two)
    after3, after2 = defaultdict(list), defaultdict(list)
    for (h, u, v, _), n in grams.items():
        after3[h, u, v].append(n)
    for (h, v, _), n in two.items():
        after2[h, v].append(n)
    out = []
    for t, h in asked:
        w, total = ["", "", *re.findall(r"\w+|[^\w\s]+|\n+", t)], 0.0
        for k in range(2, len(w)):
            words, left = base[h]
            p = max(one[h, w[k]] - d[h, 1, min(one[h, w[k]], 3)], 0) / words + left * math.exp(spell[w[k]])
            for order, n, held in ((2, two[h, w[k - 1], w[k]], after2[h, w[k - 1]]), (3, grams[h, w[k - 2], w[k - 1], w[k]], after3[h, w[k - 2], w[k - 1]])):
                if held:
                    p = (max(n - d[h, order, min(n, 3)], 0) + sum(d[h, order, min(x, 3)] for x in held) * p) / sum(held)
            total -= math.log(p)
        out.append(total)
    return out


def test_word_trigrams_against_brute_force(spark):
    rng = random.Random(23)
    words = ["der", "Der", "Haus", "été", "漢字", "12", "13", "ab", "ba", "x"]
    texts = [" ".join(rng.choices(words, k=30)) + ".\n" + " ".join(rng.choices(words, k=5)) for _ in range(40)]
    asked = texts[:10] + ["Der Der Der Der", "unseen Wörter 99 漢", "x"]
    trusted, docs = rows(spark, texts).repartition(3), rows(spark, asked)
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    of = {r["text"]: r["half"] for r in trusted.union(docs).select("text", half).collect()}
    table = wordlm.model(trusted.select("text", half))
    d, base = wordlm.summary(table)
    log_p, share = wordlm.spelling(trusted)
    every = sorted({w for t in texts + asked for w in re.findall(r"\w+|[^\w\s]+|\n+", t)})
    spell = dict(zip(every, wordlm.spelled(every, log_p, share), strict=True))
    got = {r["uid"]: r["nll"] for r in wordlm.scores(docs, trusted).collect()}
    assert np.allclose([got[k] for k in range(len(asked))], brute(texts, [of[t] for t in texts], [(t, 1 - of[t]) for t in asked], d, base, spell), rtol=1e-6)


def test_word_model_grows_with_the_input(spark):
    rng = random.Random(29)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(50)) for _ in range(80)]
    half = F.lit(0).alias("half")
    few, many = (wordlm.model(rows(spark, texts[:n]).select("text", half)).count() for n in (20, 80))
    assert many > 3.5 * few and few > 20 * 50 * 2.9


def test_order_of_words_counts(spark):
    rng = random.Random(31)
    pairs = [(f"{a}o", f"{a}i") for a in "bcdfghklmn"]
    good = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(120)]
    mixed = []
    for t in good[:5]:
        w = t.split()
        rng.shuffle(w)
        mixed.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + mixed)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in kneserney.classify(docs, labels, words=True).collect()}
    assert not any(got[i] for i in range(120, 125)) and sum(got[i] for i in range(120)) >= 118


def test_short_lines_on_many_sites_go(spark, tmp_path):
    kept = [f"text of its own {i}\n\nrare{i % 20 % 9}" for i in range(40)]
    docs = [(i, kept[i] + "\nles.\nx", "en", f"s{i % 20}", None) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (kept[i], 2) if i else (docs[0][1], 0) for i in range(40)}
    assert {r["text"] for r in corpus_pipeline.lines(spark, d, "").collect()} == {t for t, _ in got.values()}


def test_rare_languages_keep_their_own_quantiles(spark):
    counts = {"en": 900, "fr": 49, "de": 5}
    level = {"en": 1.0, "fr": 3.0, "de": 3.0}
    seen = [(lang, level[lang]) for lang, n in counts.items() for _ in range(n)]
    quantiles = kneserney.by_language(spark.createDataFrame(seen, "lang string, x double"), "x", [0.5])
    asked = spark.createDataFrame([(lang,) for lang in ("en", "fr", "de", "none")], "lang string")
    got = {r["lang"]: r["q"][0] for r in kneserney.with_language(asked, quantiles).collect()}
    k = kneserney.PRIOR_DOCS
    assert got["en"] == got["none"] == 1.0
    assert all(abs(got[x] - (3.0 * counts[x] + k) / (counts[x] + k)) < 1e-9 for x in ("fr", "de")) and got["fr"] > 2.5
