"""Best-fit packing of token sequences, improved by swaps.

``pieces`` encodes documents and cuts the ones longer than a sequence; ``pack`` puts pieces into sequences.

Whole pieces of full length are sequences of their own. The others are dealt at random into groups of bounded size.
Each group is packed by best fit, largest first, and then improved by local search: the emptiest sequence gives
documents away by moving one, exchanging one for one, or two for one, always so that the sum of squared fills grows,
until it is empty. What is still in underfull sequences of all groups is pooled into fewer, new groups and packed again.

The search gives up on a group after ``PATIENCE`` of its emptiest sequences can't be emptied; all documents stay packed.

Null and empty texts give one piece that holds only the separator. Repeated rows are separate documents. Names of special tokens
in a text become those tokens, as the vocabulary's library has it. A null doc_id stays null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_ids, materialize

CAPACITY = 2048
SEPARATOR = 0
GROUP_ROWS = 6000
PATIENCE = 8


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None):
    """byte_bpe_50k as tiktoken ranks: the vocabulary and merges of byte_bpe_50k.json, at a quarter of the time."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}  # found in texts too, as that library does
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(encoder(ranks_path).encode, allowed_special="all")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["d"].array, batch["t"].array, strict=True):
                ids = np.array([*(encode(text) if isinstance(text, str) and text else ()), SEPARATOR], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((None if pd.isna(doc) else int(doc), k, start, length, crc_of_ids(ids[start : start + length])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in sizes. Largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r set: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        if above := rooms >> s:
            room = s + (above & -above).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - s:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def exchange(giver: list[int], taker: list[int], sizes: list[int], room: int) -> tuple[int, tuple, tuple] | None:
    """The move, one-for-one or two-for-one exchange that fills the taker most: (gain, given, returned)."""
    best: tuple[int, tuple, tuple] | None = None
    given = [(sizes[i], (i,)) for i in giver] + [(sizes[i] + sizes[j], (i, j)) for n, i in enumerate(giver) for j in giver[:n]]
    back = [(0, ())] + [(sizes[i], (i,)) for i in taker] + [(sizes[i] + sizes[j], (i, j)) for n, i in enumerate(taker) for j in taker[:n]]
    for s, a in given:
        for t, b in back:
            if len(a) == 2 and len(b) == 2:
                continue
            gain = s - t
            if 0 < gain <= room and (best is None or gain > best[0]):
                best = (gain, a, b)
                if gain == room:
                    return best
    return best


def swap_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empties the emptiest bins into the rooms of others; every step makes the sum of squared fills larger."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    alive = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=fill.__getitem__)
    full = [b for b in range(len(bins)) if fill[b] == capacity]
    stuck: list[int] = []
    while alive and len(full) + len(alive) + len(stuck) > least:
        giver, moved = alive[0], True
        while moved and bins[giver]:
            moved = False
            for exactly in (True, False):  # first what fills a taker to the brim
                for taker in reversed(alive[1:]):
                    room = capacity - fill[taker]
                    step = exchange(bins[giver], bins[taker], sizes, room) if room else None
                    # more squared fill: the taker ends fuller than the giver was
                    if step is None or (exactly and step[0] < room) or fill[taker] + step[0] <= fill[giver]:
                        continue
                    gain, given, back = step
                    bins[giver] = [i for i in bins[giver] if i not in given] + list(back)
                    bins[taker] = [i for i in bins[taker] if i not in back] + list(given)
                    fill[giver] -= gain
                    fill[taker] += gain
                    moved = True
                    if not bins[giver]:
                        break
                if moved:
                    break
        rest = alive[1:]
        full += [b for b in rest if fill[b] == capacity]
        if bins[giver]:
            stuck.append(giver)
            if len(stuck) >= PATIENCE:  # the emptiest ones are stuck, so fuller ones are too
                alive = [b for b in rest if fill[b] < capacity]
                break
        alive = sorted((b for b in rest if fill[b] < capacity), key=fill.__getitem__)
    return [bins[b] for b in (*full, *alive, *stuck) if bins[b]]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return swap_search(best_fit(sizes, capacity), sizes, capacity)


def _pack_groups(rows: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """rows: uid, length. Adds sequence_id, offset and the fill of the sequence."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes = [int(x) for x in pdf["length"]]
        n = len(sizes)
        seq, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b, held in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in held:
                seq[i], offset[i] = (int(key[0]) * 2 + level) << 24 | b, at
                at += sizes[i]
            fill[held] = at
        return pd.DataFrame({"uid": pdf["uid"], "length": pdf["length"], "sequence_id": seq, "offset": offset, "fill": fill})

    grouped = rows.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
    return grouped.groupBy("g").applyInPandas(run, "uid long, length long, sequence_id long, offset long, fill long")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of at most ``capacity``; keeps all their columns."""
    rows = materialize(cut_pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    sizes = rows.select("uid", F.col(length_col).cast("long").alias("length"))
    loose = sizes.where(F.col("length") < capacity)
    n = loose.count()
    first = materialize(_pack_groups(loose, max(1, -(-n // group_rows)), 0, capacity), "packed")
    poor = first.where(F.col("fill") < int(capacity * 0.98)).select("uid", "length")
    m = poor.count()
    again = _pack_groups(poor, max(1, -(-m // group_rows)), 1, capacity)
    placed = (
        first.where(F.col("fill") >= int(capacity * 0.98))
        .unionByName(again)
        .select("uid", "sequence_id", "offset")
        .unionByName(sizes.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    )
    return rows.join(placed, "uid").drop("uid")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    return pack(pieces(docs, capacity=capacity, ranks_path=ranks_path), capacity)
