"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample (about ``SAMPLE`` vectors, chosen by a hash of the id); all vectors are then
assigned to its leaves. A query pops the nearest node from a priority queue, pushes an inner node's children, and
visits a leaf; it widens until it has seen the calibrated number of leaves and enough candidates. That number is the
least one at which ``TARGET`` of the true neighbours of ``CALIBRATION`` vectors, found by brute force over the
whole table, lie in visited leaves. Neighbouring leaves make up shards; a shard and the queries that visit any of its
leaves are joined in blocks of bounded size, so a leaf full of copies is spread over tasks. Distances are exact, in double precision, on the original vectors.

Vectors that are null, empty, zero, hold null or non-finite components, or have another length than most of the table's, take no part;
neither do null ids. Rows that share an id are one candidate (their nearest vector) and one query (their smallest
vector). Ties go to the smaller id. Fewer candidates than asked for are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SAMPLE, BRANCHES, LEAF_ROWS, LEAST_SAMPLE = 20_000, 8, 256, 4
CALIBRATION, TARGET = 128, 0.97
SHARD_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048, 512


@dataclass
class Tree:
    centre: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centre: np.ndarray) -> int:
        self.centre.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centre) - 1

    def close(self, node: int) -> None:
        self.leaf[node] = self.leaves
        self.leaves += 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going to the nearest child at every node."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = nearest(x[rows], np.array([self.centre[c] for c in self.children[node]]))
            todo += [(c, rows[near == k]) for k, c in enumerate(self.children[node]) if (near == k).any()]
        return out

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            own = self.children[node]
            d = ((np.array([self.centre[c] for c in own]) - q) ** 2).sum(axis=1)
            for c, v in zip(own, d, strict=True):
                heapq.heappush(queue, (float(v), c))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k-means: centres and the centre of each row; empty centres go."""
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        centres = np.array([x[near == c].mean(axis=0) for c in range(len(centres)) if (near == c).any()])
    return centres, nearest(x, centres)


def grow(x: np.ndarray, most: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """Splits nodes until they hold at most ``most`` rows of the sample, or can't be split."""
    rng, tree = np.random.default_rng(seed), Tree()
    todo = [(tree.add(x.mean(axis=0) if len(x) else np.zeros(1)), x)]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= max(most, branches):
            tree.close(node)
            continue
        centres, near = split(rows, branches, rng)
        if len(np.unique(near)) < 2:
            tree.close(node)
            continue
        for k, c in enumerate(centres):
            if (near == k).any():
                child = tree.add(c)
                tree.children[node].append(child)
                todo.append((child, rows[near == k]))
    return tree


def usable(vectors: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """id, v (double) of the vectors that take part: those of this length, or of the most frequent one."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(fine & F.exists(v, lambda x: x != 0))
    if length is not None:
        return rows.where(F.size("v") == length)
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("v") == (most[0]["n"] if most else 0))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def nearest_in(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, visited: list[np.ndarray] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k nearest rows (of those visited) that don't bear its id: (query's row, ids, exact distances)."""
    out = []
    rough = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q @ x.T
    slack = 1e-9 * (1.0 + np.abs(rough).max(initial=0.0))
    for i in range(len(q)):
        other = np.flatnonzero(ids != own[i] if visited is None else (ids != own[i]) & visited[i])
        if not len(other):
            continue
        r = rough[i, other]
        if len(other) > k:
            other = other[r <= np.partition(r, k - 1)[k - 1] + slack]
        d = np.sqrt(((x[other] - q[i]) ** 2).sum(axis=1))
        first = np.lexsort((ids[other], d))
        _, once = np.unique(ids[other][first], return_index=True)
        first = first[np.sort(once)][:k]
        out.append((i, ids[other][first], d[first]))
    return out


def calibrate(rows: DataFrame, tree: Tree, k: int, n: int, target: float) -> int:
    """How many leaves to visit."""
    total = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.lit(int(min(1.0, 1.5 * n / max(total, 1)) * 1_000_000) + 1)).limit(4 * n).toPandas()
    chosen = chosen.sort_values("id").head(n)
    q, own = matrix(chosen["v"]), chosen["id"].to_numpy()
    if len(q) < 2:
        return tree.leaves
    side = rows.sparkSession.sparkContext.broadcast((q, own, tree))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own, tree = side.value
        for batch in batches:
            x, ids = matrix(batch["v"]), batch["id"].to_numpy()
            leaf = dict(zip(ids.tolist(), tree.assign(x).tolist(), strict=True))
            for i, near, d in nearest_in(q, own, x, ids, k):
                yield pd.DataFrame({"q": i, "id": near, "d": d, "leaf": [leaf[j] for j in near.tolist()]})

    best = Window.partitionBy("q").orderBy("d", "id")
    truth = rows.mapInPandas(run, "q int, id long, d double, leaf int").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).toPandas()
    at = np.zeros(tree.leaves + 1)
    for i, leaves in truth.groupby("q")["leaf"]:
        place = {leaf: p for p, leaf in enumerate(tree.best_bins(q[i]))}
        for leaf in leaves:
            at[place[leaf]] += 1
    return int(np.searchsorted(np.cumsum(at) / at.sum(), target)) + 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest found rows of vectors but itself."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    rate = min(1.0, sample / max(1, total))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000) + 1)).toPandas().sort_values("id")
    tree = grow(matrix(chosen["v"]), max(LEAST_SAMPLE, int(LEAF_ROWS * rate)))
    side = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=side.value.assign(matrix(batch["v"])).astype(np.int32))

    placed = materialize(rows.mapInPandas(to_leaf, "id long, v array<double>, leaf int"), "leaves")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row per leaf of the bounded tree
    visits = calibrate(rows, tree, k, CALIBRATION, target)

    shard_of, shard, held = {}, 0, 0
    for leaf in sorted(sizes):  # leaves are numbered by depth first, so neighbours in number are neighbours in the tree
        shard_of[leaf] = shard
        held += sizes[leaf]
        if held >= SHARD_ROWS:
            shard, held = shard + 1, 0

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, v in zip(batch["id"], batch["v"], strict=True):
                held, wanted = 0, {}
                for n, leaf in enumerate(side.value.best_bins(np.asarray(v))):
                    if n >= visits and held > k:
                        break
                    if size := sizes.get(leaf, 0):
                        held += size
                        wanted.setdefault(shard_of[leaf], []).append(leaf)
                out += [(i, v, s, leaves) for s, leaves in wanted.items()]
            yield pd.DataFrame(out, columns=["qid", "q", "shard", "leaves"]).astype({"qid": "int64", "shard": "int32"})

    asked = usable(queries, id_col, vector_col, len(chosen["v"].iloc[0]) if len(chosen) else 0).groupBy("id").agg(F.min("v").alias("v"))
    bins = materialize(asked.mapInPandas(to_bins, "qid long, q array<double>, shard int, leaves array<int>"), "bins")
    asks = {r["shard"]: r["n"] for r in bins.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    rows_of: dict[int, int] = {}
    for leaf, n in sizes.items():
        rows_of[shard_of[leaf]] = rows_of.get(shard_of[leaf], 0) + n
    cut = F.broadcast(spark.createDataFrame([(leaf, s, -(-rows_of[s] // BLOCK_ROWS), -(-asks.get(s, 1) // BLOCK_QUERIES)) for leaf, s in shard_of.items()] or [(-1, -1, 1, 1)], "leaf int, shard int, vs int, qs int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = bins.join(F.broadcast(cut.select("shard", "vs", "qs").distinct()), "shard").select("shard", "qid", "q", "leaves", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int").alias("qb"), every("vs").alias("vb"))
    right = placed.join(cut, "leaf").select("shard", "leaf", "id", "v", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int").alias("vb"), every("qs").alias("qb"))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            own, leaf = a["qid"].to_numpy(), b["leaf"].to_numpy()
            visited = [np.isin(leaf, x) for x in a["leaves"]]
            for i, ids, d in nearest_in(matrix(a["q"]), own, matrix(b["v"]), b["id"].to_numpy(), k, visited):
                out += [(own[i], j, s) for j, s in zip(ids, d, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["shard", "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
