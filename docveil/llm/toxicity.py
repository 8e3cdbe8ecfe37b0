"""Toxicity by weak supervision.

Voters: words of a fixed lexicon, phrase patterns, and word stems that labelled training documents show to go with the
label (labels choose these voters). A voter that finds nothing abstains. A generative label model over the votes alone, which never
sees a document's own label, estimates by expectation maximisation how accurate each voter is (how often the class is
toxic where it fires) and the correlations that are left between voters given the class: voters that agree beyond what the
class explains, such as stems of one word, share one vote. The share of toxic documents is held at that of the labels.
The posteriors are the soft labels on which a linear (logistic) classifier over voter counts is trained. Labels are read
only for training rows, in a bounded sample: at most about ``MAX_TRAIN`` labelled documents of each class, chosen by a
hash of the id.

Prediction finds all voters in one pass over the whole text with an Aho-Corasick automaton, without a shuffle; the
model is bounded by ``MAX_VOTERS``. Null, empty and wordless texts get the score of a text without any hit. Without labels the
lexicon alone votes. Repeated rows get the same result; repeated label rows count once, toxic if any says so. Other columns are
not read (``keep_clean`` passes them through as they are).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_chunks

MAX_TRAIN = 4000
MAX_VOTERS = 400
LEAST_DOCS = 4
LEAST_PRECISION = 0.7
ROUNDS = 30
ACCURACY, STRENGTH = 0.9, 20.0  # what is thought of a voter before votes are seen, and of how many votes
SAME_VOTE = 0.6

LEXICON = """
idiot moron stupid dumb loser pathetic worthless disgusting trash scum clown garbage fool imbecile jerk creep freak vermin
filth ugly hate bastard bitch bullshit crap damn fuck fucking shit asshole dickhead retard retarded whore slut
idiota estupido estúpido imbécil basura asco asqueroso mierda puta cabrón maldito tonto inútil patético escoria
idiote stupide imbécile crétin débile ordure connard salope merde putain pathétique dégoûtant minable raclure abruti
dumm dummkopf blöd blödmann arschloch scheiße scheisse hure abschaum müll wertlos erbärmlich widerlich versager trottel
""".split()
PATTERNS = ["shut up", "go to hell", "kill yourself", "i hate you", "you are an idiot", "drop dead", "piece of shit", "halt die klappe", "ferme la", "ta gueule", "cállate"]
NOT_WORD = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    return f" {NOT_WORD.sub(' ', text.lower())} "


def stems(word: str) -> set[str]:
    """What a mined voter may look for: the beginning of a word, or the whole word (ends in a blank)."""
    return {f" {word[:k]}" for k in range(4, 8) if len(word) >= k} | {f" {word} "}


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # per voter, then any hit, then all hits a word, then the bias
    seen: dict = field(default_factory=dict)  # of the label model


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def intercept(s: np.ndarray, mean: float) -> float:
    """What to add to s so that the mean of its sigmoid is as asked."""
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sigmoid(s + middle).mean() > mean else (middle, high)
    return (low + high) / 2


def label_model(votes: np.ndarray, balance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, accuracy of each voter and share of its vote; votes: boolean (rows, voters), false: abstains."""
    v = votes.astype(np.float64)
    fired = v.sum(axis=0)
    accuracy, share = np.full(v.shape[1], ACCURACY), np.ones(v.shape[1])
    for round_ in range(ROUNDS):
        evidence = v @ (share * (np.log(accuracy / (1 - accuracy)) - np.log(balance / (1 - balance))))
        q = sigmoid(evidence + intercept(evidence, balance))
        accuracy = np.clip((q @ v + STRENGTH * ACCURACY) / (fired + STRENGTH), balance + 1e-3, 0.99)
        if round_ % 5 == 4:  # what the class leaves unexplained
            rates = (q @ v) / max(q.sum(), 1e-9), ((1 - q) @ v) / max((1 - q).sum(), 1e-9)
            left = v - (q[:, None] * rates[0] + (1 - q)[:, None] * rates[1])
            sd = np.sqrt((left**2).mean(axis=0)) + 1e-9
            correlation = (left.T @ left) / len(left) / sd[:, None] / sd[None, :]
            np.fill_diagonal(correlation, 1.0)
            share = 1.0 / np.where(correlation > SAME_VOTE, correlation, 0.0).sum(axis=1)
    return q, accuracy, share


def logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 25) -> np.ndarray:
    """Newton steps for soft labels y; penalty is per column."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def inputs(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    hits = counts.sum(axis=1)
    return np.column_stack([np.log1p(counts), hits > 0, np.log1p(1000.0 * hits / np.maximum(words, 20)), np.ones(len(counts))])


def automaton(voters: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in enumerate(voters):
        a.add_word(v, k)
    a.make_automaton()
    return a


def find(texts: list[str], found, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts, words = np.zeros((len(texts), n)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        flat = folded(text)
        words[i] = max(0, flat.count(" ") - 1)
        for _, k in found.iter(flat):
            counts[i, k] += 1
    return counts, words


def base_voters() -> list[str]:
    return [f" {w} " for w in dict.fromkeys([*LEXICON, *PATTERNS])]


def mine(rows: list[tuple[str, int]]) -> list[str]:
    """Stems that go with the label in (folded text, label) rows, most telling first, one of those that mark the same rows."""
    seen = [Counter(), Counter()]
    total = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    for text, y in rows:
        seen[y].update(set().union(*(stems(w) for w in set(text.split()) if len(w) >= 4)) if text.strip() else ())
    if not min(total):
        return []
    telling = {s: n - 3 * seen[0][s] for s, n in seen[1].items() if n >= LEAST_DOCS and n >= LEAST_PRECISION * (n + seen[0][s])}
    best = sorted(telling, key=lambda s: (-telling[s], len(s), s))[: 8 * MAX_VOTERS]
    out: list[str] = []
    marks: set[tuple] = set()
    for s in best:
        if (mark := (seen[1][s], seen[0][s], s.strip()[:4])) not in marks:
            marks.add(mark)
            out.append(s)
    return out[: MAX_VOTERS - len(base_voters())]


def train_on(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, label), in a fixed order; copies of a text count once."""
    rows = list(dict.fromkeys((folded(t), int(y)) for t, y in rows))
    base = base_voters()
    voters = list(dict.fromkeys([*base, *mine(rows)]))
    if not rows or len({y for _, y in rows}) < 2:
        weights = np.zeros(len(voters) + 3)
        weights[: len(base)], weights[-1] = 2.0, -1.0
        return Model(voters, weights)
    counts, words = find([t for t, _ in rows], automaton(voters), len(voters))
    y = np.array([k for _, k in rows], dtype=float)
    q, accuracy, share = label_model(counts > 0, float(y.mean()))
    x = inputs(counts, words)
    penalty = np.full(x.shape[1], 2.0)
    penalty[-1] = 0.0
    return Model(voters, logistic(x, q, penalty), {"accuracy": accuracy, "share": share, "posterior": q})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Model:
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).where(~held_out("doc_id"))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).where("y in (0, 1)").collect()}
    if not n:
        return train_on([])
    rate = F.create_map(*[x for y, c in n.items() for x in (F.lit(y), F.lit(min(1.0, most / c)))])
    marks = marks.where(F.col("y").isin(list(n)) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("y")] * 1_000_000)).select(F.col("doc_id").alias("id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(marks), "id").select("id", "text", "y").toPandas()
    rows = rows.sort_values(["id", "text"])
    return train_on(list(zip(rows["text"], rows["y"], strict=True)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and uid (a hash of id and text)."""
    side = docs.sparkSession.sparkContext.broadcast((model.voters, model.weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters, weights = side.value
        found = automaton(voters)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in in_chunks(texts, 2_000_000):
                z = inputs(*find(texts[a:b], found, len(voters))) @ weights
                score = sigmoid(z)
                yield batch.iloc[a:b].drop(columns="text").assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(text_col).alias("text"))
    return base.mapInPandas(run, "doc_id long, held_out boolean, uid long, score double, predicted int").select("doc_id", "held_out", "score", "predicted", "uid")


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns, in one pass without a shuffle."""
    side = docs.sparkSession.sparkContext.broadcast((model.voters, model.weights))

    def run(batches):
        import pyarrow as pa

        voters, weights = side.value
        found = automaton(voters)
        at = docs_columns.index(text_col)
        for batch in batches:
            texts = [t if t is not None else "" for t in batch.column(at).to_pylist()]
            keep = [np.zeros(0, dtype=bool)]
            for a, b in in_chunks(texts, 2_000_000):
                keep.append(inputs(*find(texts[a:b], found, len(voters))) @ weights < 0)
            yield batch.filter(pa.array(np.concatenate(keep)))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)
