"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-case letters of the whole text, weighted by term frequency and
inverse document frequency. The weights are fitted by follow-the-regularised-leader (proximal, per coordinate) with an
elastic-net penalty on a bounded sample: at most about ``MAX_TRAIN`` labelled documents, the same number for each
language (at least one), chosen by a hash of the id. A fifth of the sample is kept from the fit and sets the temperature that
calibrates the probabilities. Prediction reads text only and is one pass without a shuffle; the model (2 ** 16 rows by
number of languages) is a bounded table.

A null text, or one without letters, gives ``und`` with score 1.0. Repeated rows get the same result. Ties go to the language that sorts
first. With no labelled document every text with letters is ``und`` with score 0. Other columns aren't read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, held_out, in_chunks, materialize, mix64, small_enough

BITS = 16
MAX_TRAIN = 4000
SCALE = 30.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 3
UNKNOWN = "und"
BROADCAST_LANGS = 100_000
SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and where each text's begin (no letters: none)."""
    codes, starts = code_points([" " + t.lower() + " " for t in texts])
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    own = letter.copy()
    own[1:] |= letter[:-1]  # of a run of other characters only the first stays, as a blank
    row_start = np.searchsorted(np.flatnonzero(own), starts)
    c = codes[own].astype(np.uint32)
    n = len(c)
    out = np.zeros((n, 3), dtype=np.int64)
    for k in range(3):
        h = np.zeros(n, dtype=np.uint32)
        for j in range(k + 1):
            h[k:] += c[j : n - k + j] * SEEDS[j] + np.uint32(j + 7 * k)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[:, k] = h >> np.uint32(32 - BITS)
    return out.ravel(), row_start * 3


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # of shape (features + 1, languages); the last row is the bias
    temperature: float = 1.0

    def logits(self, x: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[x] + self.weights[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], held: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """rows: distinct features, their counts and the language of each document, in a fixed order."""
    langs = sorted({lang for *_, lang in rows})
    df = np.zeros(2**BITS)
    for x, _, _ in rows:
        df[x] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n = np.zeros((2**BITS + 1, len(langs))), np.zeros((2**BITS + 1, len(langs)))
    where = {lang: k for k, lang in enumerate(langs)}

    def leader(x: np.ndarray) -> np.ndarray:
        own = z[x]
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for x, count, lang in rows:
            at = np.append(x, 2**BITS)
            value = np.append(SCALE * count * idf[x] / count.sum(), 1.0)
            w = leader(at)
            p = softmax(value @ w)
            p[where[lang]] -= 1
            g = value[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    model = Model(langs, idf, leader(np.arange(2**BITS + 1)))
    logits = [(model.logits(x, SCALE * c * idf[x] / c.sum()), where[lang]) for x, c, lang in held if lang in where]
    if logits:
        a, y = np.array([v for v, _ in logits]), np.array([k for _, k in logits])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(a / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """Training documents: id, lang, text; about most / languages for each language, by hash of id."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota = max(1, most // max(1, counts.count()))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(quota) / F.col("n")).alias("share"))
    few = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    return rows.join(F.broadcast(share) if small_enough(share, BROADCAST_LANGS) else share, "lang").where(few < F.col("share") * 1_000_000).drop("share")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAIN) -> Model:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in in_chunks(texts, 500_000):
                x, at = features(texts[a:b])
                own = [np.unique(x[s:e], return_counts=True) for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].astype(str), "lang": batch["lang"].iloc[a:b], "x": [u.astype("<i4").tobytes() for u, _ in own], "n": [n.astype("<i4").tobytes() for _, n in own]})

    rows = sample(docs, id_col, text_col, lang_col, most).mapInPandas(run, "id string, lang string, x binary, n binary").toPandas()
    rows["order"] = mix64(np.array([int.from_bytes(i.encode()[-8:], "big") for i in rows["id"]], dtype=np.uint64)) if len(rows) else []
    rows = rows.sort_values(["order", "id"])
    every = [(np.frombuffer(x, "<i4"), np.frombuffer(n, "<i4"), lang) for x, n, lang in zip(rows["x"], rows["n"], rows["lang"], strict=True) if len(x)]
    if not every:
        return Model([], np.ones(2**BITS), np.zeros((2**BITS + 1, 0)))
    held = every[::5] if len(every) >= 50 else []
    return fit([r for k, r in enumerate(every) if k % 5 or not held], held)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    side = docs.sparkSession.sparkContext.broadcast((model.langs, (model.weights[:-1] * model.idf[:, None] * SCALE).astype(np.float32), model.weights[-1], model.temperature))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, table, bias, temperature = side.value
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in in_chunks(texts, 500_000):
                x, at = features(texts[a:b])
                n = np.diff(at)
                pred, score = np.full(b - a, UNKNOWN, dtype=object), np.where(n > 0, 0.0, 1.0)
                if len(langs) and (some := n > 0).any():
                    sums = np.add.reduceat(table[x], at[:-1][some], axis=0, dtype=np.float64)
                    p = softmax((sums / n[some][:, None] + bias) / temperature)
                    best = p.argmax(axis=1)
                    pred[some], score[some] = np.array(langs, dtype=object)[best], np.clip(p.max(axis=1), 0, 1)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b], "held_out": batch["held_out"].iloc[a:b], "lang_pred": pred, "score": score})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return base.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
