"""Near-duplicate classes by DartMinHash signatures and a banded join.

An element of weight w owns the strip [0, w) of a plane weight x rank. Hashed darts fall on the plane of each element
as a Poisson process of rate 1: the plane is cut into cells of area 1, each cell's hash gives its number of darts and
their places. Darts outside the strip are ignored. Each dart belongs to one of t coordinates, which keeps the dart of
least rank; two documents agree in a coordinate with the probability of their weighted Jaccard similarity. About
t ln t + 2t darts are thrown for a document, however many elements it has.

Elements are the text's shingles of five words, weighted by how often they occur (``weighted=False``: 1), and documents are
linked if their weighted Jaccard similarity is at least 0.8: the sum of the lesser counts over the sum of the greater. Bands of
the signature are bucket keys: 40 bands of 8 coordinates find a pair of similarity 0.8 with probability 0.9994, and
one of 0.1 (a passage in common) with 4e-7. Documents with equal elements are one vertex.

Links are found without listing all pairs of a bucket, and none is lost after the banding:

1. Each member of a bucket is compared with the bucket's pivot, the member that shares most buckets with others (so the middle
   of a cluster). Links are contracted to components.
2. In buckets that still hold several components, a member goes if it can't reach the similarity with any other there: too many of
   its shingles are nowhere else in these buckets, or its size differs too much from all. Both bounds are exact.
3. Members outside a bucket's largest component are paired with members of other components; large buckets are dealt over
   salts. A pair goes on only if exact bounds allow it: sizes, shingles that none else has, and the number of bits in
   which the parities of the documents' shingles differ (at most the number of shingles in which the documents differ).

Every link is verified by the exact similarity of whole texts. A class is a connected component of links. Step 3 is still
quadratic in the members of a bucket that lie just under the similarity of its largest component; the README has counts.

A row's class is that of its text, its class_id the smallest doc_id there: rows that share a doc_id but not a text may have
several classes, and a row of null doc_id has a null class_id if all its class has. Null, empty and wordless texts are classes
of their own (class_id is their doc_id). Texts under ``size`` words are compared by their whole word sequence. Repeated rows share
a class. Vertices are 64-bit hashes of texts. No rows give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, dealt, in_chunks, materialize, mix64, small_enough, unused
from .graph import components
from .shingles import shingle_sets

SIMILARITY, SIZE, BANDS, ROWS = 0.8, 5, 40, 8
EDGE = 1e-9
BROADCAST_IDS = 500_000
PARITY_BITS = 512

CELL, LEVEL, DART, SIDE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
#: P(Poisson(1) <= k)
POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(20)])


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, limit: float, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate, rank and hash of all darts of rank under ``limit`` in the elements' strips."""
    seeds, low, width, cell, weight = [], [], [], [], []
    level, edge, wide = 1, 0.0, 1.0
    while (held := weights > edge).any():
        n = int(np.ceil(limit * wide))  # cells of height 1 / wide
        own = elements[held] + np.uint64(int(LEVEL) * level % 2**64)
        grid = (own[:, None] + CELL * np.arange(1, n + 1, dtype=np.uint64)[None, :]).ravel()
        seeds.append(mix64(grid))
        low.append(np.full(len(grid), edge))
        width.append(np.full(len(grid), wide))
        cell.append(np.tile(np.arange(n, dtype=np.float64), len(own)))
        weight.append(np.repeat(weights[held], n))
        level, edge, wide = level + 1, edge + wide, edge + wide
    seed, lo, wd, ce, we = (np.concatenate(x) for x in (seeds, low, width, cell, weight))
    n = np.searchsorted(POISSON, unit(seed), side="right")
    some = np.repeat(np.arange(len(seed)), n)
    order = np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n)
    h = mix64(mix64(seed[some]) + DART * (order.astype(np.uint64) + np.uint64(1)))
    rank = (ce[some] + unit(h)) / wd[some]
    side = mix64(h + SIDE)
    inside = (rank < limit) & (lo[some] + wd[some] * unit(side) < we[some])
    return (side[inside] % np.uint64(t)).astype(np.int64), rank[inside], h[inside]


def signature(elements: np.ndarray, weights: np.ndarray | None, t: int) -> np.ndarray:
    """The hash of the earliest dart per coordinate; elements must not be empty."""
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=np.float64)
    limit = (t * np.log(t) + 2 * t) / weights.sum()
    while True:
        coordinate, rank, h = darts(elements, weights, limit, t)
        latest_first = np.argsort(-rank, kind="stable")
        out, filled = np.zeros(t, dtype=np.uint64), np.zeros(t, dtype=bool)
        out[coordinate[latest_first]] = h[latest_first]
        filled[coordinate] = True
        if filled.all():
            return out
        limit *= 2


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * CELL
    for k in range(rows):
        key = mix64(key + parts[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, v, h1, h2 (of the elements), n (sum of weights), keys, bits (parities). Without words keys and bits are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in in_chunks(texts, 1_000_000):
                h1, h2, count, keys, bits = [], [], [], [], []
                for own, n in shingle_sets(texts[a:b], size, counts=True):
                    every = expanded(own, n) if weighted else own
                    h1.append(int(every.sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(mix64(every + SIDE).sum(dtype=np.uint64).view(np.int64)))
                    count.append(len(every))
                    sig = signature(own, n if weighted else None, bands * rows) if len(own) else None
                    keys.append(None if sig is None else band_keys(sig, bands, rows))
                    bits.append(None if sig is None else parities(every))
                part = batch.iloc[a:b]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "h1": h1, "h2": h2, "n": count, "keys": keys, "bits": bits}).astype({"id": "Int64"})

    return docs.mapInPandas(run, "id long, v long, h1 long, h2 long, n long, keys array<long>, bits array<long>")


def expanded(elements: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One element for each occurrence: the Jaccard similarity of these sets is the weighted one of the counts."""
    if not len(n) or n.max() == 1:
        return elements
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(np.where(nth > 0, mix64(np.repeat(elements, n) + CELL * nth.astype(np.uint64)), np.repeat(elements, n)))


def parities(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements has each value of a hash; two sets differ in no fewer elements than bits."""
    odd = np.bincount((mix64(elements + DART) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def allowed(similarity: float):
    """Condition on na, nb, bits_a, bits_b that every pair of at least this similarity meets."""
    both = F.col("na") + F.col("nb")
    differ = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    return (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - EDGE) & (differ <= both * F.lit((1 - similarity) / (1 + similarity)) + EDGE)


def sets_of(ids: DataFrame, docs: DataFrame, size: int, weighted: bool) -> DataFrame:
    """v, s (elements as of ``expanded``) of the texts named in ids, a written table; one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in in_chunks(list(batch["text"]), 1_000_000):
                found = shingle_sets(list(batch["text"].iloc[a:b]), size, counts=True)
                yield pd.DataFrame({"v": batch["v"].iloc[a:b].to_numpy(), "s": [(expanded(*x) if weighted else x[0]).view(np.int64) for x in found]})

    side = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    rows = docs.join(side, "v", "left_semi").groupBy("v").agg(F.any_value("text").alias("text"))
    return materialize(rows.mapInPandas(run, "v long, s array<long>"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float, weighted: bool) -> DataFrame:
    """The pairs (a, b), of a written table, whose exact similarity is at least ``similarity``."""
    ids = materialize(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct(), "ids")
    sets = sets_of(ids, docs, size, weighted)
    given = pairs
    for key, other in (("a", "b"), ("b", "a")):
        rows, side = dealt(pairs, sets.select(F.col("v").alias(key), F.col("s").alias(f"s{key}")), key, other, given)
        pairs = rows.join(side, [key, "salt"]).drop("salt")
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(common * F.lit(1 + similarity) >= F.lit(similarity) * (F.size("sa") + F.size("sb")) - EDGE).select("a", "b")


def with_sketches(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b), of a written table, with na, nb, bits_a and bits_b."""
    given = pairs
    for key, other in (("a", "b"), ("b", "a")):
        rows, side = dealt(pairs, reps.select(F.col("rep").alias(key), F.col("n").alias(f"n{key}"), F.col("bits").alias(f"bits_{key}")), key, other, given)
        pairs = rows.join(side, [key, "salt"]).drop("salt")
    return pairs


def in_mixed(entries: DataFrame) -> DataFrame:
    """The entries (key, c, ...) of keys that hold several components."""
    mixed = entries.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    mixed = materialize(mixed, "mixed")
    return entries.join(F.broadcast(mixed) if small_enough(mixed, BROADCAST_IDS) else mixed, "key", "left_semi")


def across(entries: DataFrame, base: DataFrame, size: int, similarity: float, weighted: bool) -> DataFrame:
    """Pairs (a, b) of members of different components of a bucket that may be similar; entries: key, rep, c, n, bits."""
    open_ = materialize(in_mixed(entries), "open")
    ids = materialize(open_.select(F.col("rep").alias("v")).distinct(), "ids")
    elements = sets_of(ids, base, size, weighted).select("v", F.explode("s").alias("h"))
    alone = elements.groupBy("h").agg(F.count("*").alias("m"), F.min("v").alias("rep")).where("m = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    open_ = open_.join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    sizes = open_.groupBy("key").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    known = F.col("n") - F.col("alone")  # the best partner has these and, if it is larger, others
    best = known >= F.lit(similarity) * (F.greatest(known, F.col("least")) + F.col("alone")) - EDGE
    rows, side = dealt(materialize(open_, "open"), sizes, "key", "rep")
    left = rows.join(side, ["key", "salt"]).where(best & (F.lit(similarity) * F.col("n") <= F.col("most") + EDGE)).select("key", "rep", "c", "n", "bits", "alone")
    left = materialize(in_mixed(materialize(left, "left")), "still")
    by_component = left.groupBy("key", "c").agg(F.count("*").alias("m"))
    largest = by_component.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.ceil(F.sum("m") / HEAVY).alias("salts"))
    rows, side = dealt(left, largest, "key", "rep")
    members = materialize(rows.join(side, ["key", "salt"]).drop("salt"), "members")
    of = lambda x: [F.col("rep").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"), F.col("alone").alias(f"alone_{x}")]
    outside = members.where("c <> top").select("key", *of("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    every = members.select("key", "top", *of("b"), F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"))
    shared = F.least(F.col("na") - F.col("alone_a"), F.col("nb") - F.col("alone_b"))
    near = allowed(similarity) & (shared * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("na") + F.col("nb")) - EDGE)
    pairs = outside.join(every, ["key", "salt"]).where(F.expr("ca <> cb and (cb = top or a < b)") & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def vertices(docs: DataFrame, id_col: str, text_col: str, similarity: float, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, v, words, and for texts with words the class_id and the first (id, v) of the class, for every row of docs."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("v"), F.col(text_col).alias("text"))
    sketch = materialize(sketches(base, size, bands, rows, weighted), "sketch")
    worded = sketch.where("keys is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v"))  # null ids come last
    reps = materialize(worded.groupBy("h1", "h2").agg(F.min("v").alias("rep"), first.alias("first"), F.count("*").alias("m"), *[F.any_value(x).alias(x) for x in ("n", "keys", "bits")]), "reps")
    buckets = reps.select("rep", F.explode("keys").alias("key"))
    many = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    narrow, side = dealt(buckets, many, "key", "rep")
    shared = materialize(narrow.join(side, ["key", "salt"]).drop("salt"), "shared")
    busy = shared.groupBy("rep").agg(F.sum("m").alias("busy"))
    pivots = shared.join(materialize(busy, "busy"), "rep").groupBy("key").agg(F.max_by("rep", F.struct("busy", "rep")).alias("pivot"))
    narrow, side = dealt(shared, pivots, "key", "rep")
    pairs = narrow.join(side, ["key", "salt"]).where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    texts = base.where("text is not null").select("v", "text")
    pairs = with_sketches(materialize(pairs, "pairs"), reps).where(allowed(similarity)).select("a", "b")
    links = materialize(verified(materialize(pairs, "pairs"), texts, size, similarity, weighted), "links")
    labels = materialize(components(links).select(F.col("v").alias("rep"), "c"), "labels")
    entries = shared.join(labels, "rep", "left").join(reps.select("rep", "n", "bits"), "rep").select("key", "rep", F.coalesce("c", "rep").alias("c"), "n", "bits")
    more = verified(materialize(across(materialize(entries, "entries"), texts, size, similarity, weighted), "pairs"), texts, size, similarity, weighted)
    labels = components(links.unionByName(more)).select(F.col("v").alias("rep"), "c")
    grouped = materialize(reps.join(labels, "rep", "left").select("h1", "h2", "first", "m", F.coalesce("c", "rep").alias("c")), "groups")
    # one row for each set of elements, so copies don't make a class hot
    firsts = grouped.groupBy("c").agg(F.min("first").alias("top"))
    rows_, side = dealt(grouped, firsts, "c", "h1")
    of_set = materialize(rows_.join(side, ["c", "salt"]).select("h1", "h2", "m", "top"), "classes")
    heavy = of_set.where(F.col("m") > HEAVY).select("h1", "h2", "top")  # at most rows / HEAVY sets
    rows_ = sketch.select("id", "v", "h1", "h2", F.col("keys").isNotNull().alias("words")).join(F.broadcast(heavy), ["h1", "h2"], "left")
    light = rows_.where("top is null").drop("top").join(of_set.where(F.col("m") <= HEAVY).select("h1", "h2", "top"), ["h1", "h2"], "left")
    return light.unionByName(rows_.where("top is not null")).select("id", "v", "words", F.when(F.col("words"), F.col("top")).alias("top"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) for every row of docs."""
    found = vertices(docs, id_col, text_col, similarity, size, bands, rows, weighted)
    return found.select(F.col("id").alias("doc_id"), F.when(F.col("words"), F.col("top.id")).otherwise(F.col("id")).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """docs with one row of each class, one of smallest doc_id (null ids last); rows without words all stay. All columns stay as they are."""
    found = vertices(docs, id_col, text_col, similarity, size, bands, rows, weighted)
    kept = found.where("words and v = top.v and id <=> top.id").select("v").distinct()
    wordless = found.where("not words").select("v").distinct()
    v, number, kind = unused(docs, "v"), unused(docs, "number"), unused(docs, "kind")
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marks = materialize(kept.withColumn("kind", F.lit(1)).unionByName(wordless.withColumn("kind", F.lit(0))), "kept").select(F.col("v").alias(v), F.col("kind").alias(kind))
    held = docs.withColumn(v, own).join(marks, v)
    # of the rows of a kept text the first stays: found by a pre-aggregated minimum, not by gathering them
    ranked = held.withColumn(number, F.monotonically_increasing_id())
    ranked = materialize(ranked, "ranked")
    first = ranked.where(F.col(kind) == 1).groupBy(v).agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("i"), F.col(number).alias("k"))).alias("f")).select(F.col("f.k").alias(number))
    only = ranked.where(F.col(kind) == 1).join(first, number, "left_semi")
    return only.unionByName(ranked.where(F.col(kind) == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
