"""Cross-site boilerplate lines, found by their spread over distinct sites.

Every line has a 64-bit hash of its folded form (lower case, white space collapsed). HyperLogLog sketches of the sites
that show a hash merge by aggregation, so a very common line costs one sketch per task. Lines whose estimate is near the
threshold get exact distinct counts; the rest are decided by the estimate. Lines on at least ``min_sites`` sites are
boilerplate: all their occurrences go but the first one (smallest doc_id, then position), so that a page copied to many
sites still stays once, with its whole text.

Copies of one document vote once: only the smallest doc_id of each exact text counts towards the spread.
Empty lines are never boilerplate, nor are lines shorter than ``min_chars`` after folding; the queries pass 1 (``EVERY_LINE``), so that spread alone decides. A null site is one site of its
own. Null texts stay null; a null doc_id sorts before all others. Repeated rows with one doc_id share their first place.
Extra columns pass through unchanged, also those named like columns used inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, materialize, small_enough, unused

MIN_SITES = 10
MIN_CHARS = 16
EVERY_LINE = 1
LG_K = 10
BROADCAST_LINES = 200_000


def folded(line):
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def row_hash(*columns: str):
    return F.xxhash64(*[F.col(c) for c in columns])


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """uid, doc, site, pos and hash of each line that may be boilerplate."""
    lines = docs.where(F.col(text_col).isNotNull()).select(
        row_hash(id_col, text_col, site_col).alias("uid"), F.col(id_col).alias("doc"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.xxhash64(text_col).alias("copy"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"),
    ).withColumn("line", folded(F.col("line")))
    return lines.where(F.length("line") >= min_chars).select("uid", "doc", "site", "copy", "pos", F.xxhash64("line").alias("hash"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """hash and first place (doc, pos) of the lines on at least min_sites distinct sites.

    A sketch of 2**lg_k registers errs by 1.04 / sqrt(2**lg_k); four times that counts as near.
    """
    near = 4 * 1.04 / 2 ** (lg_k / 2)
    votes = materialize(lines.groupBy("hash", "copy").agg(F.min(F.struct("doc", "pos", "site")).alias("first")), "votes")
    spread = votes.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("first.site"), lg_k)).alias("sites"), F.min(F.struct("first.doc", "first.pos")).alias("first"))
    wide = materialize(spread.where(F.col("sites") >= F.lit(int(min_sites * (1 - near)))), "lines")
    close = wide.where(F.col("sites") <= F.lit(int(min_sites * (1 + near)) + 1))
    exact = votes.join(F.broadcast(close.select("hash")) if small_enough(close, BROADCAST_LINES) else close.select("hash"), "hash", "left_semi")
    exact = exact.select("hash", F.col("first.site").alias("site")).distinct().groupBy("hash").agg(F.count("*").alias("n"))
    sure = wide.where(F.col("sites") > F.lit(int(min_sites * (1 + near)) + 1)).select("hash", "first")
    return sure.unionByName(close.join(exact.where(F.col("n") >= min_sites), "hash").select("hash", "first"))


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """docs with their text cleaned, and lines_removed (with underscores in front if docs has such a column)."""
    lines = materialize(line_rows(docs, id_col, text_col, site_col, min_chars), "hashes")  # texts are split and hashed once
    found = materialize(boilerplate(lines, min_sites), "boilerplate")
    if small_enough(found, BROADCAST_LINES):
        hit = lines.join(F.broadcast(found), "hash")
    else:
        left, side = dealt(lines, found, "hash", "uid")
        hit = left.join(side, ["hash", "salt"])
    hit = hit.where(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.pos") == F.col("pos"))))
    uid, gone = unused(docs, "uid"), unused(docs, "gone")
    places = hit.groupBy(F.col("uid").alias(uid)).agg(F.collect_set("pos").alias(gone))
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(F.col(gone), i))
    out = docs.withColumn(uid, row_hash(id_col, text_col, site_col)).join(places, uid, "left")
    return out.select(
        *[F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(gone), F.lit(0)).alias(unused(docs, "lines_removed")),
    )


def with_lengths(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Sets the length column, if there is one, to the text's length."""
    if length_col not in docs.columns:
        return docs
    kind = dict(docs.dtypes)[length_col]
    return docs.withColumn(length_col, F.length(text_col).cast(kind))
