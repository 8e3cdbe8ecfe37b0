"""Clean files, scan the copies and compare."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.operators import clean as op
from docveil.operators import findings as fo
from docveil.sources.batches import in_batches, rows_of

from .inspect import Scan, scan

ARROW = pa.schema([("file_id", pa.string()), ("path", pa.string()), ("length", pa.int64())])


def plan(s: Scan, actions: list[str] | None = None) -> DataFrame:
    """file_id and actions: those asked for, or the default ones that each file is offered."""
    offered = fo.offered_actions(s.findings, s.types)
    if actions is None:
        return offered.where("default").groupBy("file_id").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    return s.types.select("file_id", F.array(*map(F.lit, actions)).cast("array<string>").alias("actions"))


def clean(s: Scan, actions: list[str] | None = None, force_signed: bool = False, force_provenance: bool = False) -> DataFrame:
    """file_id, name, mime, content, removed, transformed, warnings, error, and the comparison of original and copy."""
    rows = s.files.join(s.types.select("file_id", "kind", "type_name", "mime"), "file_id").join(plan(s, actions), "file_id", "left")
    copies = op.cleaned(rows, force_signed, force_provenance).join(rows.select("file_id", tx.output_filename(F.col("name")).alias("name"), "mime"), "file_id").persist()
    again = scan(copies.where("content is not null").select("file_id", "name", F.col("mime").alias("claimed_mime"), "content"))
    return copies.join(verification(s, again), "file_id", "left")


def verification(before: Scan, after: Scan) -> DataFrame:
    prints = lambda s, c: s.facts.where("fact = 'fingerprint'").select("file_id", F.col("value").alias(c))
    counts = lambda s, c: s.summary.select("file_id", F.col("actionable").alias(c))
    rows = counts(after, "sanitized_findings").join(counts(before, "original_findings"), "file_id").join(prints(before, "original_fingerprint"), "file_id", "left").join(prints(after, "sanitized_fingerprint"), "file_id", "left")
    same = F.coalesce(F.col("original_fingerprint") == F.col("sanitized_fingerprint"), F.lit(False))
    return rows.select("file_id", same.alias("same_content"), "original_fingerprint", "sanitized_fingerprint", "original_findings", "sanitized_findings", F.greatest(F.lit(0), F.col("original_findings") - F.col("sanitized_findings")).alias("reduced_by"))


def write_copies(copies: DataFrame, folder: str) -> DataFrame:
    """Writes the copies (file_id, name, content) under a folder or URI that all executors share, each task its own.

    A copy's place is <folder>/<first 16 digits of the SHA-256 of its file_id>/<name>. It is written beside that and moved, so a
    task that runs again leaves whole files only. Gives file_id, path and length; files without content (errors) have no path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            for r in rows_of(batch):
                if r["content"] is None:
                    yield r["file_id"], None, None
                    continue
                store, root = FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)
                place = f"{root}/{hashlib.sha256(r['file_id'].encode()).hexdigest()[:16]}"
                store.create_dir(place, recursive=True)
                beside = f"{place}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(r["content"])
                store.move(beside, f"{place}/{r['name']}")
                yield r["file_id"], f"{place}/{r['name']}", len(r["content"])

        for batch in batches:
            yield from in_batches(each(batch), ARROW)

    return copies.select("file_id", "name", "content").mapInArrow(run, "file_id string, path string, length bigint")
