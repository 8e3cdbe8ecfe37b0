"""Interpolated modified Kneser-Ney word trigrams over all trusted text, in a distributed table that grows with it.

Words are runs of letters and digits as written, marks are words too (``kinds``); each n-gram is a 48-bit hash. Tasks send the
trigrams (u, v, w) of their chunks packed to the shard of v, which has all that counts them, their contexts (u, v) and v, and
the continuation counts of (v, w); those of words are added up from all shards. A word v that would fill a shard by itself (seen in
``SAMPLE_TEXTS`` texts, which decides only where rows go) is dealt over several by u, and its bigrams are added up by ``groupBy``. The base
distribution, which unseen words back off to, spells a word in characters: the trigrams over 64 classes of ``kneserney``,
counted over the words of the trusted text, times the probability of the character within its class.

A trusted text would find its own n-grams in the table, so there are two models, one of each half of the trusted texts (by
a hash of the text; the half is the lowest bit of each key), and each document is scored by the half it isn't part of.

Scoring sends the distinct keys of each chunk of documents to the shards of the table (ranges of keys), and counts come back to
the chunk. Documents go in ``ROUNDS`` rounds, so that only a part of the keys and counts is on disk at a time.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneserney
from .common import code_points, drop, forget_shuffles, give_back_memory, in_chunks, materialize, mix64, sums_by_row

CHUNK_CHARS = 2_500_000
COUNT_CHARS = 2_500_000
COUNT_WORDS = 1_000_000
SAMPLE_TEXTS, SAMPLE_CHARS = 2000, 5000
SHARD_ROWS = 400_000
ROUNDS, ROUND_DOCS = 8, 5000
BITS = 48
EMPTY = 1  # the hash of what stands before each text
FIELDS = ("n", "n1", "n2", "n3")
BLANK, WORD, MARK, LINE = 0, 1, 2, 3
STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """BLANK, WORD (letters, marks, digits, underscores), LINE or MARK (all else) for each code point."""
    table = np.full(0x110000, MARK, dtype=np.uint8)
    for c in range(0x110000):
        char = chr(c)
        if char == "\n":
            table[c] = LINE
        elif char.isspace():
            table[c] = BLANK
        elif char == "_" or char.isalnum() or unicodedata.category(char)[0] == "M":
            table[c] = WORD
    return table


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2 ** 64."""
    out = []
    for x in (STEP, pow(STEP, -1, 2**64)):
        row = np.full(COUNT_CHARS, x, dtype=np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and their hashes, the word numbers of all texts one after another, and where each text begins."""
    texts = [t + " " for t in texts]
    points, begins = code_points(texts)
    kind = kinds()[points]
    cut = np.flatnonzero(np.diff(kind, prepend=255))
    end = np.append(cut[1:], len(kind))
    end, cut = end[kind[cut] > 0], cut[kind[cut] > 0]
    hashes = np.empty(len(cut), dtype=np.uint64)
    up, down = powers() if len(kind) <= COUNT_CHARS else longer(len(kind))
    total = np.zeros(len(kind) + 1, dtype=np.uint64)
    mixed = mix64(points + np.uint32(1))
    mixed *= up[: len(kind)]
    np.cumsum(mixed, dtype=np.uint64, out=total[1:])
    del mixed
    hashes = mix64((total[end] - total[cut]) * down[cut])
    codes, found = pd.factorize(hashes)
    first = np.empty(len(found), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    joined = "".join(texts)
    words = [joined[x:y] for x, y in zip(cut[first].tolist(), end[first].tolist(), strict=True)]
    return words, found >> np.uint64(64 - BITS), codes.astype(np.int32), np.searchsorted(cut, begins)


def longer(n: int) -> tuple[np.ndarray, np.ndarray]:
    """powers() for more than a chunk of counting."""
    rows = [np.full(n, x, dtype=np.uint64) for x in (STEP, pow(STEP, -1, 2**64))]
    for row in rows:
        row[0] = 1
    return np.cumprod(rows[0], dtype=np.uint64), np.cumprod(rows[1], dtype=np.uint64)


def key_of(kind: int, hashes: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Keys of n-grams: 1 to 3 words as such, 4 a bigram and 5 a word as context."""
    return ((mix64(hashes + np.uint64(kind)) >> np.uint64(65 - BITS)) << np.uint64(1) | half).astype(np.int64)


def longer_gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context) * np.uint64(3) + word


def keys_of(hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The distinct keys of the texts' n-grams, and for each word the places there of w, vw and uvw and of the contexts v and uv; half: 0 or 1 for each text."""
    first = starts[:-1][np.diff(starts) > 0]
    bit = np.repeat(half.astype(np.int64), np.diff(starts))
    # word 0 stands before each text
    w, words = pd.factorize(np.concatenate([(codes.astype(np.int64) + 1) * 2 + bit, [0, 1]]))
    empty, w, n = w[-2:], w[:-2], len(words)
    v = np.roll(w, 1)
    v[first] = empty[bit[first]]
    vw, pairs = pd.factorize(np.concatenate([v * n + w, empty * n + empty]))
    none, vw = vw[-2:], vw[:-2]
    uv = np.roll(vw, 1)
    uv[first] = none[bit[first]]
    uvw, triples = pd.factorize(uv * n + w)
    side = (words % 2).astype(np.uint64)
    h1 = np.concatenate([np.full(1, EMPTY, dtype=np.uint64), hashes])[words // 2]
    h2 = longer_gram(h1[pairs // n], h1[pairs % n])
    h3 = longer_gram(h2[triples // n], h1[triples % n])
    kinds_of = ((1, h1, side), (2, h2, side[pairs % n]), (3, h3, side[triples % n]), (4, h2, side[pairs % n]), (5, h1, side))
    ends = np.cumsum([len(h) for _, h, _ in kinds_of])
    return np.concatenate([key_of(*x) for x in kinds_of]), {"w": w, "vw": vw + ends[0], "uvw": uvw + ends[1], "uv": uv + ends[2], "v": v + ends[3]}


def planes(x: np.ndarray) -> bytes:
    """Byte planes one after another: those of zeros compress to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, n).T.copy().view(kind).ravel()


def zipped(*parts: bytes) -> bytes:
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def often_asked(trusted: DataFrame) -> tuple[int, dict[int, tuple[int, int]]]:
    """How many shards count, and for the hash of each word that would fill half of one: the first of its own shards and their number."""
    words = max(1, (trusted.agg(F.sum(F.length("text"))).first()[0] or 0) // 5)
    shards = -(-words // COUNT_WORDS)
    if shards == 1:
        return 1, {}
    texts = [r[0] for r in trusted.where("text is not null").select(F.substring("text", 1, SAMPLE_CHARS)).limit(SAMPLE_TEXTS).collect()]
    seen: dict[int, int] = {EMPTY: len(texts)}
    for a, b in in_chunks(texts, COUNT_CHARS):
        _, hashes, codes, _ = words_of(texts[a:b])
        for h, n in zip(hashes.tolist(), np.bincount(codes, minlength=len(hashes)).tolist(), strict=True):
            seen[h] = seen.get(h, 0) + n
    total, out, free = sum(seen.values()), {}, shards
    for h, n in sorted(seen.items()):
        if (parts := -(-2 * n * words // (total * COUNT_WORDS))) > 1:
            out[h] = (free, parts)
            free += parts
    return shards, out


def sent(trusted: DataFrame, shards: int, heavy: dict[int, tuple[int, int]]) -> DataFrame:
    """shard, data: the trigrams of each chunk by the shard of their middle word; trusted: text, half."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back_memory()
        for batch in batches:
            batch = batch[[isinstance(t, str) and bool(t) for t in batch["text"]]]
            texts, half = list(batch["text"]), batch["half"].to_numpy()
            for a, b in in_chunks(texts, COUNT_CHARS):
                _, hashes, codes, starts = words_of(texts[a:b])
                if not len(codes):
                    continue
                hashes = np.append(hashes, np.uint64(EMPTY))
                order = np.argsort(hashes, kind="stable")  # words are numbered by their hashes
                hashes, number = hashes[order], np.empty(len(order), dtype=np.int32)
                number[order] = np.arange(len(order))
                first, empty = starts[:-1][np.diff(starts) > 0], number[-1]
                w = number[codes]
                v = np.roll(w, 1)
                v[first] = empty
                u = np.roll(v, 1)
                u[first] = empty
                shard = (mix64(hashes) % np.uint64(shards)).astype(np.int32)[v]
                for h, (own, parts) in heavy.items():
                    at = np.searchsorted(hashes, np.uint64(h))
                    if at < len(hashes) and hashes[at] == h:
                        rows = np.flatnonzero(v == at)
                        shard[rows] = own + (mix64(hashes[u[rows]]) % np.uint64(parts)).astype(np.int32)
                v2 = v * 2 + np.repeat(half[a:b].astype(np.int32), np.diff(starts))
                by = np.lexsort((u, v2, shard))
                u, v2, w, shard = u[by], v2[by], w[by], shard[by]
                cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
                out = []
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    used = np.zeros(len(hashes), dtype=np.int32)
                    used[u[x:y]] = used[w[x:y]] = used[v2[x:y] // 2] = 1
                    place = np.cumsum(used, dtype=np.int32) - 1
                    own = hashes[used > 0]
                    head = np.array([len(own), y - x], dtype="<i8").tobytes()
                    v2_own = place[v2[x:y] // 2] * 2 + v2[x:y] % 2
                    out.append(zipped(head, packed(own.astype(np.int64)), planes(np.diff(v2_own, prepend=0).astype("<i4")), planes(place[u[x:y]].astype("<i4")), planes(place[w[x:y]].astype("<i4"))))
                yield pd.DataFrame({"shard": shard[cut[:-1]], "data": out})

    return trusted.mapInPandas(run, "shard int, data binary")


def received(data: bytes) -> list[np.ndarray]:
    """For each trigram of a chunk the keys of uvw, of the context uv, of vw, of the context v and of w."""
    raw = unzipped(data)
    n_words, n = np.frombuffer(raw, dtype="<i8", count=2).tolist()
    h = unpacked(raw[16 : 16 + 8 * n_words]).astype(np.uint64)
    v2, u, w = (from_planes(raw[16 + 8 * n_words + 4 * n * k : 16 + 8 * n_words + 4 * n * (k + 1)], "<i4", n) for k in range(3))
    v2 = np.cumsum(v2)
    half, hu, hv, hw = (v2 % 2).astype(np.uint64), h[u], h[v2 // 2], h[w]
    uv = longer_gram(hu, hv)
    return [key_of(3, longer_gram(uv, hw), half), key_of(4, uv, half), key_of(2, longer_gram(hv, hw), half), key_of(5, hv, half), key_of(1, hw, half)]


TABLE = "key long, level int, n long, n1 long, n2 long, n3 long"


def add_up(shard: int, pdf: pd.DataFrame, shards: int) -> Iterator[pd.DataFrame]:
    """Rows of TABLE with context and lower. Level 3 and 2: n-grams with their (continuation) counts; 0: contexts, n is their total; -1: words, to be
    added up over all shards; -2: bigrams of a word that was dealt over several shards, with the keys of the context v and of w."""

    def rows(level: int, key: np.ndarray, n: np.ndarray, some: tuple = (0, 0, 0), context=0, lower=0) -> pd.DataFrame:
        return pd.DataFrame({"key": key, "level": np.full(len(key), level, dtype=np.int32), "n": n, **{f"n{k}": np.broadcast_to(x, len(key)) for k, x in enumerate(some, 1)}, "context": np.broadcast_to(context, len(key)), "lower": np.broadcast_to(lower, len(key))})

    def contexts(of: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        key, at = np.unique(of, return_inverse=True)
        some = [np.bincount(at[n == k], minlength=len(key)) for k in (1, 2)] + [np.bincount(at[n >= 3], minlength=len(key))]
        return rows(0, key, np.bincount(at, n, minlength=len(key)).astype(np.int64), tuple(some))

    give_back_memory()
    parts = [received(x) for x in pdf["data"]]
    uvw, uv, vw, v, w = (np.concatenate([x[k] for x in parts]) for k in range(5))
    del parts
    key, at, n = np.unique(uvw, return_index=True, return_counts=True)
    uv, vw, v, w = uv[at], vw[at], v[at], w[at]
    yield rows(3, key, n)
    yield contexts(uv, n)
    del uvw, uv
    key, at, n = np.unique(vw, return_index=True, return_counts=True)
    if shard >= shards:
        yield rows(-2, key, n, context=v[at], lower=w[at])
        return
    yield rows(2, key, n)
    yield contexts(v[at], n)
    yield rows(-1, *np.unique(w[at], return_counts=True))


def model(trusted: DataFrame) -> DataFrame:
    """key, n (count, or continuation count below trigrams; a context's total) and for contexts n1, n2, n3; level of n (0: context)."""
    shards, heavy = often_asked(trusted)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(add_up(int(key[0]), pdf, shards)))

    counted = sent(trusted, shards, heavy).groupBy("shard").applyInPandas(count, TABLE + ", context long, lower long")
    grams = materialize(counted, "word-model", "zstd", deltas=True)
    split = materialize(grams.where("level = -2").groupBy("key", "context", "lower").agg(F.sum("n").alias("n")), "bigrams", "zstd")
    forget_shuffles(trusted.sparkSession)
    none = [F.lit(0).cast("long").alias(x) for x in FIELDS[1:]]
    words = grams.where("level = -1").select("key", "n").unionByName(split.select(F.col("lower").alias("key"), F.lit(1).cast("long").alias("n")))
    words = words.groupBy("key").agg(F.sum("n").alias("n")).select("key", F.lit(1).alias("level"), "n", *none)
    some = [F.count(F.when(F.col("n") >= 3 if k == 3 else F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3)]
    contexts = split.groupBy(F.col("context").alias("key")).agg(F.lit(0).alias("level"), F.sum("n").alias("n"), *some)
    more = materialize(words.unionByName(split.select("key", F.lit(2).alias("level"), "n", *none)).unionByName(contexts), "word-model", "zstd", deltas=True)
    drop(split)
    return grams.where("level >= 0").select("key", "level", *FIELDS).unionByName(more)


def summary(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Discounts of each half, order and count 0 to 3, and of each half the total of words' counts and the mass left to spelling."""
    rows = table.where("level > 0").groupBy((F.col("key") % 2).alias("half"), "level").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), *[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()
    d, base = np.zeros((2, 4, 4)), np.array([[0.0, 1.0], [0.0, 1.0]])
    for r in rows:
        cut = d[r["half"], r["level"]] = kneserney.discounts_of(*(float(r[f"n{k}"]) for k in (1, 2, 3, 4)))
        if r["level"] == 1:
            more = r["kinds"] - r["n1"] - r["n2"]
            base[r["half"]] = r["total"], (cut[1] * r["n1"] + cut[2] * r["n2"] + cut[3] * more) / r["total"]
    return d, base


def spelling(trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ln P of the class trigrams and of each character within its class, from the words of each chunk."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back_memory()
        for batch in batches:
            texts = [t for t in batch["text"] if isinstance(t, str) and t]
            for a, b in in_chunks(texts, COUNT_CHARS):
                yield pd.DataFrame({"text": [w + " " for w in words_of(texts[a:b])[0]]})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x30000, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.minimum(code_points(list(batch["text"]))[0], 0x2FFFF), minlength=0x30000)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"c": seen, "n": total[seen]})

    all_words = materialize(trusted.select("text").mapInPandas(words, "text string"), "words")
    n = np.ones(0x30000)
    rows = all_words.mapInPandas(members, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    n[rows["c"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
    symbol = kneserney.symbols()
    share = np.log(n / np.bincount(symbol, weights=n, minlength=kneserney.K)[symbol])
    log_p = kneserney.log_probabilities(kneserney.count_trigrams(all_words))
    drop(all_words)
    return log_p, share.astype(np.float32)


def spelled(words: list[str], log_p: np.ndarray, share: np.ndarray) -> np.ndarray:
    """ln of the base probability of each word: its characters and the blank after it."""
    ended = [w + " " for w in words]
    tri, _ = kneserney.trigrams(ended)
    codes, starts = kneserney.code_points(ended)
    return sums_by_row(log_p[tri] + share[np.minimum(codes, 0x2FFFF)], starts)


def probabilities(stats: dict[str, np.ndarray], half: np.ndarray, p0: np.ndarray, d: np.ndarray, base: np.ndarray) -> np.ndarray:
    """P(w | u v) of each word, from the rows (FIELDS) of its keys w, v, vw, uv and uvw, 0 where the model has none."""
    total, left = base[half, 0], base[half, 1]
    n = stats["w"][:, 0]
    p = np.where(total > 0, np.maximum(n - d[half, 1, np.minimum(n, 3)], 0) / np.maximum(total, 1), 0) + np.where(total > 0, left, 1) * p0
    for order, own, context in ((2, "vw", "v"), (3, "uvw", "uv")):
        n, c = stats[own][:, 0], stats[context]
        cut = d[half, order]
        back = (cut[:, 1:] * c[:, 1:]).sum(axis=1)
        p = np.where(c[:, 0] > 0, (np.maximum(n - cut[np.arange(len(n)), np.minimum(n, 3)], 0) + back * p) / np.maximum(c[:, 0], 1), p)
    return p


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes one after another (high planes are zeros and compress)."""
    return planes(np.diff(keys, prepend=0).astype("<i8"))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<i8", len(raw) // 8))


def in_shards(table: DataFrame, shards: int, width: int) -> DataFrame:
    """shard, data: rows of the table, sorted by key and packed, by ranges of keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back_memory()
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 4 * SHARD_ROWS:
                yield cut(held)
                held = []
        if held:
            yield cut(held)

    def cut(held: list[pd.DataFrame]) -> pd.DataFrame:
        keys = np.concatenate([x["key"].to_numpy() for x in held])
        order = np.argsort(keys)
        keys = keys[order]
        values = [np.minimum(np.concatenate([x[f].to_numpy() for x in held])[order], 2**32 - 1).astype("<u4") for f in FIELDS]
        edge = np.searchsorted(keys, np.arange(shards + 1, dtype=np.int64) * width)
        own = [s for s in range(shards) if edge[s] < edge[s + 1]]
        return pd.DataFrame({"shard": np.array(own, dtype=np.int32), "data": [zipped(packed(keys[edge[s] : edge[s + 1]]), *(planes(x[edge[s] : edge[s + 1]]) for x in values)) for s in own]})

    return table.select("key", *FIELDS).mapInPandas(run, "shard int, data binary")


def rows_in(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a shard and a row of FIELDS for each."""
    keys, values = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(FIELDS)), dtype="<u4")]
    for raw in map(unzipped, data):
        n = len(raw) // (8 + 4 * len(FIELDS))
        keys.append(unpacked(raw[: 8 * n]))
        values.append(np.stack([from_planes(raw[8 * n + 4 * n * k : 8 * n + 4 * n * (k + 1)], "<u4", n) for k in range(len(FIELDS))], axis=1))
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate(values)[order]


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """uid, nll, chars of the non-empty texts of docs (uid, text); trusted: text."""
    spark = docs.sparkSession
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    trusted = materialize(trusted.select("text", half.alias("half")), "trusted", "zstd")
    log_p, share = spelling(trusted)
    forget_shuffles(spark)
    rows = model(trusted)
    drop(trusted)
    d, base = summary(rows)
    shards = max(8, -(-rows.count() // SHARD_ROWS))  # a task holds one with all that is asked of it
    width = -(-(2**BITS) // shards)
    forget_shuffles(spark)
    table = materialize(in_shards(rows, shards, width), "word-shards")
    drop(rows)
    rounds = max(1, min(ROUNDS, docs.count() // ROUND_DOCS))
    docs, out = docs.select("uid", "text", half.alias("half")), []
    for k in range(rounds):
        out.append(looked_up(docs.where(F.pmod("uid", F.lit(rounds)) == k), table, d, base, log_p, share, shards, width))
        forget_shuffles(spark)
    drop(table)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def looked_up(docs: DataFrame, table: DataFrame, d: np.ndarray, base: np.ndarray, log_p: np.ndarray, share: np.ndarray, shards: int, width: int) -> DataFrame:
    """uid, nll, chars of some documents (uid, text, half)."""

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back_memory()
        for batch in batches:
            batch = batch[[isinstance(t, str) and bool(t) for t in batch["text"]]]
            texts, uid, other = list(batch["text"]), batch["uid"].to_numpy(), 1 - batch["half"].to_numpy()
            for a, b in in_chunks(texts, CHUNK_CHARS):
                words, w, codes, starts = words_of(texts[a:b])
                chunk = uuid.uuid4().int >> 65
                keys = np.sort(keys_of(w, codes, starts, other[a:b])[0])
                edge = np.searchsorted(keys, np.arange(shards + 1, dtype=np.int64) * width)
                held = [s for s in range(shards) if edge[s] < edge[s + 1]]
                yield pd.DataFrame({"chunk": chunk, "shard": np.array(held, dtype=np.int32), "data": [packed(keys[edge[s] : edge[s + 1]]) for s in held]})
                chars = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
                parts = (w, spelled(words, log_p, share), codes.astype("<i4"), starts, other[a:b].astype(np.int64), uid[a:b].astype(np.int64), chars)
                head = np.array([len(w), len(codes), b - a], dtype=np.int64)
                yield pd.DataFrame({"chunk": [chunk], "shard": np.array([-1], dtype=np.int32), "data": [b"".join(x.tobytes() for x in (head, *parts))]})

    chunks = materialize(docs.mapInPandas(prepare, "chunk long, shard int, data binary"), "chunks", "zstd")

    def look_up(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        give_back_memory()
        keys, values = rows_in(list(side["data"]))
        out = []
        for raw in rows["data"]:
            asked = unpacked(raw)
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            got = np.where((keys[at] == asked)[:, None], values[at], np.uint32(0)) if len(keys) else np.zeros((len(asked), len(FIELDS)), dtype="<u4")
            out.append(zipped(*(planes(np.ascontiguousarray(x)) for x in got.T)))
        return pd.DataFrame({"chunk": rows["chunk"].to_numpy(dtype=np.int64), "shard": rows["shard"].to_numpy(dtype=np.int32), "found": out})

    def finish(whole: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        give_back_memory()
        raw = whole["data"].iloc[0]
        n_words, n_codes, n_docs = np.frombuffer(raw, dtype=np.int64, count=3)
        at, parts = 24, []
        for kind, n in (("u8", n_words), ("f8", n_words), ("<i4", n_codes), ("i8", n_docs + 1), ("i8", n_docs), ("i8", n_docs), ("i8", n_docs)):
            parts.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += parts[-1].nbytes
        w, p0, codes, starts, other, uid, chars = parts
        if not n_codes:
            return pd.DataFrame({"uid": uid, "nll": np.zeros(n_docs), "chars": chars})
        keys, places = keys_of(w, codes, starts, other)
        counts = [np.frombuffer(unzipped(x), dtype=np.uint8).reshape(len(FIELDS), 4, -1).transpose(0, 2, 1).copy().view("<u4")[:, :, 0].T for x in found.sort_values("shard")["found"]]
        rows = np.empty((len(keys), len(FIELDS)), dtype=np.int64)
        rows[np.argsort(keys, kind="stable")] = np.concatenate(counts)
        per_word = np.repeat(other, np.diff(starts))
        nll = np.empty(n_codes)
        for a in range(0, int(n_codes), 200_000):  # scratch arrays stay small
            cut = slice(a, a + 200_000)
            stats = {name: rows[x[cut]] for name, x in places.items()}
            nll[cut] = -np.log(np.maximum(probabilities(stats, per_word[cut], np.exp(p0[codes[cut]]), d, base), 1e-300))
        return pd.DataFrame({"uid": uid, "nll": sums_by_row(nll, starts), "chars": chars})

    found = chunks.where("shard >= 0").groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(look_up, "chunk long, shard int, found binary")
    parts = chunks.where("shard < 0").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(finish, "uid long, nll double, chars long")
    done = materialize(parts.groupBy("uid").agg(F.max("nll").alias("nll"), F.max("chars").alias("chars")), "word-scores")
    drop(chunks)
    return done
