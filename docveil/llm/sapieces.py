"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words (a run of blanks and what follows up to the next blank) are joined into one text. Its suffix
array, ordered by as many characters as the longest piece has, is searched for every piece: two binary searches, done
for all pieces at once, give the range of suffixes that begin with it. Every occurrence is an edge from its first to its
last position; edges are sorted by position.

The lattice of edges is then relaxed. In a BPE model the best path doesn't give the model's segmentation, as merges are
greedy by score; so the edges are relaxed in the model's order: of all edges that span exactly two present symbols of a
word, the one of best score (then the leftmost) becomes a symbol, until none is left. Characters without a piece become
their bytes' pieces, or unknown. Words of up to ``LONG_WORD`` characters are relaxed all at once, a merge a round; longer ones
(text without blanks) each from a heap, in n log n.

Words are encoded once for a batch, and the first ``REMEMBERED`` ones of a worker are remembered. Null and empty texts have no ids. Repeated rows get
the same ids; a null doc_id stays null; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_ids, in_chunks

BLANK = "▁"
REMEMBERED = 800_000
CHUNK = 1_500_000
LONG_WORD = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file: texts, scores and kinds."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.bytes = np.full(256, self.unknown, dtype=np.int64)
        self.text: list[str] = []
        self.kind: list[str] = []
        held: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            kind = "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal"
            self.text.append(piece)
            self.kind.append(kind)
            if kind == "byte":
                self.bytes[int(piece[3:5], 16)] = i
            elif kind == "normal":
                held[piece] = (i, sp.get_score(i))
        order = sorted(held)
        self.pieces = order
        self.ids = np.array([held[p][0] for p in order], dtype=np.int64)
        self.scores = np.array([held[p][1] for p in order])
        self.longest = max(map(len, order))
        self.memory: dict[str, bytes] = {}


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Pieces:
    return Pieces(path or default_model())


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes at least, by prefix doubling."""
    seen, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    base, length = len(seen) + 1, 1
    while length < depth:
        if base < 2**31:
            after = np.zeros_like(rank)
            after[:-length] = rank[length:]
            rank, base, length = rank * base + after, base * base, 2 * length
        else:  # too wide to take in more: number the ranks anew
            order = np.argsort(rank)
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.diff(rank[order], prepend=rank[order[:1]]) != 0) + 1
            rank, base = new, int(new.max()) + 1
    return np.argsort(rank)


def edges(codes: np.ndarray, vocab: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece number of all occurrences of pieces in codes, sorted by position."""
    order = suffix_array(codes, vocab.longest)
    padded = np.concatenate([codes, np.zeros(vocab.longest, dtype=codes.dtype)])
    size = np.array([len(p) for p in vocab.pieces])
    wanted = np.zeros((len(size), vocab.longest), dtype=np.int64)
    for k, p in enumerate(vocab.pieces):
        wanted[k, : len(p)] = [ord(c) for c in p]

    def bound(after: bool) -> np.ndarray:
        """The first suffix that isn't below the piece, or (after) that is above all suffixes beginning with it."""
        low, high = np.zeros(len(size), dtype=np.int64), np.full(len(size), len(order), dtype=np.int64)
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) // 2
            cmp = np.zeros(len(k), dtype=np.int64)
            todo = np.arange(len(k))
            for j in range(vocab.longest):
                todo = todo[(j < size[k[todo]]) & (cmp[todo] == 0)]
                if not len(todo):
                    break
                cmp[todo] = np.sign(padded[order[middle[todo]] + j].astype(np.int64) - wanted[k[todo], j])
            up = (cmp <= 0) if after else (cmp < 0)
            low[k[up]] = middle[up] + 1
            high[k[~up]] = middle[~up]
        return low

    first, last = bound(False), bound(True)
    n = last - first
    piece = np.repeat(np.arange(len(size)), n)
    start = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    by_place = np.lexsort((size[piece], start))
    start, piece = start[by_place], piece[by_place]
    return start, start + size[piece], piece


def merge_long(first: int, last: int, symbols: list[int], key: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same relaxation of one long word, from a heap of the edges over two neighbouring symbols."""
    a, b = np.searchsorted(key, (first * 64, last * 64))
    known = dict(zip(key[a:b].tolist(), piece[a:b].tolist(), strict=True))
    n = last - first
    stop, before, own = list(range(1, n + 1)), list(range(-1, n - 1)), symbols
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        """The edge over the symbol at ``left`` and the next one, if there is a piece."""
        right = stop[left]
        if right < n and (p := known.get((first + left) * 64 + stop[right] - left)) is not None:
            heapq.heappush(heap, (int(rank[p]), left, stop[right], p))

    for left in range(n - 1):
        offer(left)
    while heap:
        _, left, end, p = heapq.heappop(heap)
        right = stop[left] if alive[left] else n
        if right >= n or stop[right] != end:
            continue  # one of its symbols has become another since
        alive[right] = False
        stop[left], own[left] = end, p
        if end < n:
            before[end] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    at = [k for k in range(n) if alive[k]]
    return np.array(at, dtype=np.int64) + first, np.array([own[k] for k in at], dtype=np.int64)


def merge(n: int, word: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy relaxation of all words at once: the symbols' starts and piece numbers (-1: a character without a piece)."""
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    key = start * 64 + (end - start)
    single = np.full(n, -1, dtype=np.int64)
    one = (end - start) == 1
    single[start[one]] = piece[one]
    begin = np.flatnonzero(word >= 0)  # separators belong to no word
    size = np.bincount(word[begin], minlength=1)
    final_start, final_piece = [], []
    for long in np.flatnonzero(size > LONG_WORD):  # as many rounds as merges would be too many
        a = int(np.searchsorted(word[begin], long))
        first, last = int(begin[a]), int(begin[a]) + int(size[long])
        s, p = merge_long(first, last, single[first:last].tolist(), key, piece, rank)
        final_start.append(s)
        final_piece.append(p)
    begin = begin[size[word[begin]] <= LONG_WORD]
    own = single[begin]
    w = word[begin]
    stop = begin + 1
    while len(begin):
        pair = np.flatnonzero(w[:-1] == w[1:])
        wanted = begin[pair] * 64 + (stop[pair + 1] - begin[pair])
        at = np.searchsorted(key, wanted)
        at[at == len(key)] = 0
        hit = (key[at] == wanted) if len(key) else np.zeros(len(at), dtype=bool)
        pair, at = pair[hit], at[hit]
        if not len(pair):
            final_start.append(begin)
            final_piece.append(own)
            break
        best = np.lexsort((pair, rank[piece[at]], w[pair]))
        pair, at = pair[best], at[best]
        first = np.flatnonzero(np.diff(w[pair], prepend=-1) != 0)
        pair, at = pair[first], at[first]
        stop[pair] = stop[pair + 1]
        own[pair] = piece[at]
        alive = np.ones(len(begin), dtype=bool)
        alive[pair + 1] = False
        moving = np.isin(w, w[pair])  # words without a merge are done
        final_start.append(begin[~moving])
        final_piece.append(own[~moving])
        alive &= moving
        begin, stop, own, w = begin[alive], stop[alive], own[alive], w[alive]
    s, p = np.concatenate(final_start or [begin]), np.concatenate(final_piece or [own])
    order = np.argsort(s, kind="stable")
    return s[order], p[order]


def encode_words(words: list[str], vocab: Pieces) -> list[bytes]:
    """Ids of each word, as packed little-endian uint32."""
    out: list[bytes] = []
    for a, b in in_chunks(words, CHUNK):
        text = "\n".join(words[a:b]) + "\n"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words[a:b]])
        word = np.repeat(np.arange(b - a), size + 1)
        cut = np.cumsum(size + 1) - 1
        word[cut] = -1
        codes = codes.copy()
        codes[cut] = 0  # no piece holds it
        start, end, piece = edges(codes, vocab)
        s, p = merge(len(codes), word, start, end, piece, vocab.scores)
        ids = np.where(p >= 0, vocab.ids[np.maximum(p, 0)], -1)
        if (ids < 0).any():
            full, of = [], []
            for k, i in enumerate(ids.tolist()):
                new = [i] if i >= 0 else vocab.bytes[list(text[s[k]].encode("utf-8", "surrogatepass"))].tolist()
                full += new
                of += [s[k]] * len(new)
            ids, s = np.array(full, dtype=np.int64), np.array(of, dtype=np.int64)
        at = np.searchsorted(s, np.concatenate([[0], cut]))
        packed = ids.astype("<u4").tobytes()
        out += [packed[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def words_of(text: str) -> list[str]:
    """The text after the model's normalisation (blanks become U+2581, one is put in front), cut before each run of them."""
    import re

    return re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", BLANK + text.replace(" ", BLANK))


def encode_texts(texts: list[str], vocab: Pieces) -> list[np.ndarray]:
    split = [words_of(t) if t else [] for t in texts]
    held = vocab.memory
    new = list(dict.fromkeys(w for ws in split for w in ws if w not in held))
    ids = dict(zip(new, encode_words(new, vocab), strict=True))
    for w in new[: max(0, REMEMBERED - len(held))]:
        held[w] = ids[w]
    return [np.frombuffer(b"".join([held[w] if w in held else ids[w] for w in ws]), "<u4") for ws in split]


def decode_ids(ids, vocab: Pieces) -> str:
    """Text of the ids: the inverse of encoding where the model has pieces or bytes for all characters."""
    out = bytearray()
    for i in ids:
        kind = vocab.kind[i]
        if kind == "byte":
            out.append(int(vocab.text[i][3:5], 16))
        elif kind == "normal":
            out += vocab.text[i].replace(BLANK, " ").encode("utf-8", "surrogatepass")
        elif kind == "unknown":
            out += " ⁇ ".encode()
    text = out.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row; a null text has null ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in in_chunks(texts, 8_000_000):
                ids = encode_texts(texts[a:b], vocab)
                part = batch.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [x.astype(np.int32) if isinstance(t, str) else None for x, t in zip(ids, part["text"], strict=True)]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """doc_id and text of each row; null ids have a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [decode_ids(x, vocab) if x is not None else None for x in batch["ids"]]})

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding gives the text back, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in in_chunks(texts, 8_000_000):
                ids = encode_texts(texts[a:b], vocab)
                same = [decode_ids(x.tolist(), vocab) == t for x, t in zip(ids, texts[a:b], strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b], "n_ids": [len(x) for x in ids], "ids_crc32": [crc_of_ids(x) for x in ids], "same": same})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, same boolean")
