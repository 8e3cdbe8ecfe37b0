"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model's symbols are characters folded to 64 classes (``symbols``), so each order has a bounded table: at most
64 ** 3 trigrams, whatever the size of the corpus. Counting covers all trusted documents: tasks count their trigrams,
``groupBy`` adds them up. Scoring is a join of count tables cut into shards: a document sends to every shard its own
trigrams of that shard (two bytes each and a count), each shard looks up its slice of log-probabilities, and partial
sums come back per document. The queries let the word trigrams of ``wordlm``, whose table grows with the corpus, judge too.

A document's perplexity is exp of its mean negative log-probability a character, shrunk towards its language's median
as if ``PRIOR_CHARS`` median characters were added (short texts vary more). It is rejected above
``q50 + SPREAD * (q95 - q50)`` of the trusted documents of its language, in logarithms. A language's quantiles are drawn
towards those of all languages as if these had ``PRIOR_DOCS`` documents; one without trusted documents uses the latter.

Null and empty texts have null perplexity and are rejected. A null language is a language of its own. Without any
trusted document nothing can be rejected but empty texts. Repeated rows get the same result, as if each stood alone. Other columns
aren't read (``keep_good`` passes them through as they are); no rows give no rows. Repeated label rows count once: a
document is trusted if any of its labels is 1.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordlm
from .common import code_points, dealt, forget_shuffles, in_chunks, materialize, small_enough, sums_by_row, unused

K = 64
SHARDS = 8
SLICE = K**3 // SHARDS
GROUP_DOCS = 8000
PRIOR_CHARS = 300
SPREAD = 3.0
PRIOR_DOCS = 10
BROADCAST_IDS = 500_000
BROADCAST_LANGS = 10_000

#: Symbols 3 to 28 are a to z; the rest as listed.
BOUNDARY, BLANK, NEWLINE, UPPER, DIGIT, LOWER, LETTER, OTHER = 0, 1, 2, 29, 30, 31, 32, 63
ACCENTED = "àâäáãåæçèéêëìíîïñòóôöõøùúûüßœ"
MARKS = {c: 33 + k for k, c in enumerate(".,;:!?'\"-()")}
PAIRS = {c: 44 + k % 18 for k, c in enumerate(ACCENTED)}


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    table = np.full(0x30000, OTHER, dtype=np.uint8)
    for c in range(0x30000):
        kind, char = unicodedata.category(chr(c)), chr(c)
        if char == "\n":
            table[c] = NEWLINE
        elif char.isspace():
            table[c] = BLANK
        elif "a" <= char <= "z":
            table[c] = 3 + c - ord("a")
        elif char in PAIRS:
            table[c] = PAIRS[char]
        elif char in MARKS:
            table[c] = MARKS[char]
        elif kind in ("Lu", "Lt"):
            table[c] = UPPER
        elif kind == "Ll":
            table[c] = LOWER
        elif kind[0] in "LM":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = DIGIT
    table[0] = BOUNDARY
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all characters, each text after two boundaries, and the row of each."""
    codes, starts = code_points(["\0\0" + t for t in texts])
    s = symbols()[np.minimum(codes, 0x2FFFF)].astype(np.int64)
    tri = np.zeros(len(s), dtype=np.int64)
    tri[2:] = (s[:-2] * K + s[1:-1]) * K + s[2:]
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    own = np.ones(len(s), dtype=bool)
    own[starts[:-1]] = own[starts[:-1] + 1] = False
    return tri[own], row[own]


def count_trigrams(texts: DataFrame) -> np.ndarray:
    """Counts of all K ** 3 trigrams in the column text: at most K ** 3 rows come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K**3, dtype=np.int64)
        for batch in batches:
            held = [t for t in batch["text"] if isinstance(t, str) and t]
            for a, b in in_chunks(held, 2_000_000):
                total += np.bincount(trigrams(held[a:b])[0], minlength=K**3)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"g": seen, "n": total[seen]})

    counts = np.zeros(K**3, dtype=np.float64)
    rows = texts.select("text").mapInPandas(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["g"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return counts


def discounts(counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    return discounts_of(*(float((counts == k).sum()) for k in (1, 2, 3, 4)))


def discounts_of(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """The same from how many n-grams have counts 1 to 4."""
    if min(n1, n2) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def smoothed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(c | context) for counts of shape (contexts, K) and the lower order's probabilities of the same shape."""
    d = discounts(counts)
    cut = d[np.minimum(counts, 3).astype(int)]
    total = counts.sum(axis=1, keepdims=True)
    back = np.where(total > 0, cut.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
    return np.where(total > 0, (counts - cut) / np.maximum(total, 1), 0.0) + back * lower


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P of all K ** 3 trigrams; lower orders use continuation counts."""
    tri = counts.reshape(K, K, K)
    after = (tri > 0).sum(axis=0).astype(float)  # distinct symbols before a bigram
    before = (after > 0).sum(axis=0).astype(float)  # distinct symbols before a symbol
    p1 = smoothed(before.reshape(1, K), np.full((1, K), 1.0 / K))
    p2 = smoothed(after, np.broadcast_to(p1, (K, K)))
    p3 = smoothed(tri.reshape(K * K, K), np.broadcast_to(p2, (K, K, K)).reshape(K * K, K))
    return np.log(p3).astype(np.float32).ravel()


def shard_rows(docs: DataFrame, salts: int) -> DataFrame:
    """shard, salt, uid, the document's trigrams of that shard as uint16 and their counts as uint8 (255 and more repeat)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch[[isinstance(t, str) and bool(t) for t in batch["text"]]]
            texts, uids = list(held["text"]), held["uid"].to_numpy()
            for a, b in in_chunks(texts, 1_000_000):
                tri, row = trigrams(texts[a:b])
                key, n = np.unique(row * K**3 + tri, return_counts=True)
                times = (n + 254) // 255
                key, last = np.repeat(key, times), np.cumsum(times) - 1
                c = np.full(len(key), 255, dtype=np.uint8)
                c[last] = n - 255 * (times - 1)
                part = key // SLICE
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                ids, c = (key % SLICE).astype("<u2").tobytes(), c.tobytes()
                ends = [*cut[1:].tolist(), len(key)]
                yield pd.DataFrame({
                    "shard": (part[cut] % SHARDS).astype(np.int32), "uid": uids[a:b][part[cut] // SHARDS],
                    "ids": [ids[2 * x : 2 * y] for x, y in zip(cut.tolist(), ends, strict=True)], "n": [c[x:y] for x, y in zip(cut.tolist(), ends, strict=True)],
                })

    rows = docs.select("uid", "text").mapInPandas(run, "shard int, uid long, ids binary, n binary")
    return rows.withColumn("salt", F.pmod("uid", F.lit(salts)).cast("int"))


def scores(docs: DataFrame, log_p: np.ndarray) -> DataFrame:
    """uid, nll, chars of the non-empty texts of docs (uid, text)."""
    spark = docs.sparkSession
    salts = max(1, -(-docs.count() // GROUP_DOCS))
    slices = spark.createDataFrame([(k, bytearray(log_p[k * SLICE : (k + 1) * SLICE].astype("<f4").tobytes())) for k in range(SHARDS)], "shard int, p binary")
    slices = slices.select("shard", "p", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def look_up(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"uid": [], "shard": [], "nll": [], "chars": []}).astype({"uid": "int64", "shard": "int32", "nll": "float64", "chars": "int64"})
        p = np.frombuffer(side["p"].iloc[0], dtype="<f4")
        n = np.frombuffer(b"".join(rows["n"]), dtype=np.uint8).astype(np.float64)
        ids = np.frombuffer(b"".join(rows["ids"]), dtype="<u2")
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows["n"]])])
        return pd.DataFrame({"uid": rows["uid"].to_numpy(), "shard": rows["shard"].to_numpy(), "nll": -sums_by_row(p[ids] * n, at), "chars": sums_by_row(n, at).astype(np.int64)})

    parts = shard_rows(docs, salts).groupBy("shard", "salt").cogroup(slices.groupBy("shard", "salt")).applyInPandas(look_up, "uid long, shard int, nll double, chars long")
    # repeated rows have one uid and the same parts, which count once
    parts = parts.groupBy("uid", "shard").agg(F.max("nll").alias("nll"), F.max("chars").alias("chars"))
    return parts.groupBy("uid").agg(F.sum("nll").alias("nll"), F.sum("chars").alias("chars"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words: bool = False) -> DataFrame:
    """doc_id, lang, chars, perplexity, threshold, keep, and uid (a hash of id and text) for each row of docs.

    labels: doc_id, quality; documents labelled 1 are the trusted text. words: the word trigrams of ``wordlm`` judge too,
    a row is kept if both models keep it, and its figures are those of the model under which it lies nearer to the limit, or further above.
    """
    base = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("t")).distinct()
    side = F.broadcast(trusted) if small_enough(trusted, BROADCAST_IDS) else trusted  # texts need not move then
    texts = base.join(side, F.col("doc_id") == F.col("t"), "left_semi")
    rows = base.select("uid", "doc_id", "lang").join(trusted, F.col("doc_id") == F.col("t"), "left").select("uid", "doc_id", "lang", F.col("t").isNotNull().alias("trusted"))
    out = judged(rows, scores(base.select("uid", "text"), log_probabilities(count_trigrams(texts))))
    if words:
        forget_shuffles(docs.sparkSession)
        more = judged(rows, wordlm.scores(base.select("uid", "text"), texts))
        more = more.groupBy("uid").agg(F.first("score").alias("score_w"), F.first("limit").alias("limit_w"))
        worse = F.coalesce(F.col("score_w") - F.col("limit_w") > F.col("score") - F.col("limit"), F.lit(False))
        both = out.join(more, "uid", "left")
        out = both.select("uid", "doc_id", "lang", "chars", "mean", F.when(worse, F.col("score_w")).otherwise(F.col("score")).alias("score"), F.when(worse, F.col("limit_w")).otherwise(F.col("limit")).alias("limit"))
    keep = F.when(F.col("mean").isNull(), False).otherwise(F.coalesce(F.col("score") <= F.col("limit"), F.lit(True)))
    return out.select("uid", "doc_id", "lang", F.coalesce("chars", F.lit(0)).alias("chars"), F.exp("score").alias("perplexity"), F.exp("limit").alias("threshold"), keep.alias("keep"))


def judged(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """rows (uid, doc_id, lang, trusted) with chars, mean, score and limit of one model's scores (uid, nll, chars)."""
    rows = rows.join(scored, "uid", "left").select(*rows.columns, "chars", (F.col("nll") / F.col("chars")).alias("mean"))
    rows = materialize(rows, "perplexity")
    good = rows.where("trusted and mean is not null")
    middle = by_language(good, "mean", [0.5])
    rows = with_language(rows, middle).withColumn("prior", F.col("q")[0]).drop("q")
    shrunk = (F.col("mean") * F.col("chars") + F.col("prior") * PRIOR_CHARS) / (F.col("chars") + PRIOR_CHARS)
    rows = rows.withColumn("score", F.coalesce(shrunk, F.col("mean")))
    limits = by_language(rows.where("trusted and score is not null"), "score", [0.5, 0.95])
    return with_language(rows, limits).withColumn("limit", F.col("q")[0] + SPREAD * (F.col("q")[1] - F.col("q")[0])).drop("q", "prior")


def by_language(rows: DataFrame, column: str, at: list[float]) -> DataFrame:
    """Quantiles of a column per language and its number of rows, and those of all languages under the language null."""
    q = F.percentile_approx(column, at, 10_000)
    own = rows.groupBy("lang").agg(q.alias("q"), F.count("*").alias("n"))
    return own.unionByName(rows.agg(F.lit(None).cast("string").alias("lang"), q.alias("q"), F.count("*").alias("n")))


def with_language(rows: DataFrame, quantiles: DataFrame) -> DataFrame:
    """rows with q: their language's quantiles, drawn towards those of all languages as by PRIOR_DOCS more documents.

    A third of all rows may have one language, so the few rows of quantiles are broadcast; if there are many, large languages are dealt.
    """
    quantiles = materialize(quantiles, "quantiles")
    every = quantiles.where("lang is null").first()["q"]  # one row; null without trusted documents
    q_all = F.lit(None).cast("array<double>") if every is None else F.array(*[F.lit(float(x)) for x in every])
    own = quantiles.where("lang is not null").select("lang", F.zip_with("q", q_all, lambda x, y: (x * F.col("n") + y * PRIOR_DOCS) / (F.col("n") + PRIOR_DOCS)).alias("q"))
    if small_enough(own, BROADCAST_LANGS):
        out = rows.join(F.broadcast(own), "lang", "left")
    else:
        left, side = dealt(rows, own, "lang", "uid")
        out = left.join(side, ["lang", "salt"], "left").drop("salt")
    return out.withColumn("q", F.coalesce("q", q_all))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    uid = unused(docs, "uid")
    kept = classify(docs, labels, id_col, text_col, lang_col, words=True).where("keep").select(F.col("uid").alias(uid)).distinct()
    return docs.withColumn(uid, F.xxhash64(F.col(id_col), F.col(text_col))).join(kept, uid, "left_semi").drop(uid)
