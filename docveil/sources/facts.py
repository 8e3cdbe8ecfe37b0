"""From files to facts: one pass over file contents gives one table of small rows.

A fact has file_id, seq (its place in the file), fact (what it is), path, key, value, n. Parsing is the only part
that looks into bytes; all policy (severity, category, titles) is in ``docveil.operators.rules``, on columns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.operators import dims

from . import images, pdfs
from .batches import in_batches, rows_of
from .zipfiles import Archive, ZipError

SCHEMA = "file_id string, seq int, fact string, path string, key string, value string, n bigint"
ARROW = pa.schema([("file_id", pa.string()), ("seq", pa.int32()), *((x, pa.string()) for x in ("fact", "path", "key", "value")), ("n", pa.int64())])
FILES = "file_id string, name string, claimed_mime string, length bigint, content binary"
TEXT_PARTS = 2000


def read_files(spark: SparkSession, *paths: str, glob: str | None = None, largest: int = dims.MAX_FILE) -> DataFrame:
    """Files of paths or globs. Those that are empty or too large are left out before their content is read; ``refused`` lists them."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return from_table(reader.load(list(paths)).where((F.col("length") > 0) & (F.col("length") <= largest)).select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def refused(spark: SparkSession, *paths: str, largest: int = dims.MAX_FILE) -> DataFrame:
    rows = spark.read.format("binaryFile").load(list(paths)).where((F.col("length") == 0) | (F.col("length") > largest))
    return rows.select(F.col("path").alias("file_id"), "length", F.when(F.col("length") == 0, F.lit("empty")).otherwise(F.lit("too large")).alias("error"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of newly arriving files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).load(path).where((F.col("length") > 0) & (F.col("length") <= dims.MAX_FILE))
    return rows.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", "modificationTime")


def from_table(rows: DataFrame) -> DataFrame:
    """Files of any table with file_id and content; name and claimed_mime are filled in where missing."""
    name = F.coalesce(F.col("name"), F.lit("unnamed-file")) if "name" in rows.columns else F.lit("unnamed-file")
    rows = rows.withColumn("name", F.when(name == "", "unnamed-file").otherwise(name))
    claimed = tx.null_if_empty(F.col("claimed_mime")) if "claimed_mime" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("file_id").cast("string").alias("file_id"), "name", F.coalesce(claimed, tx.mime_of(F.col("name"))).alias("claimed_mime"), F.octet_length("content").cast("bigint").alias("length"), "content")


def magic_kind(content) -> F.Column:
    """Kind by first bytes; Office packages are still ``zip``."""
    starts = lambda h: F.startswith(content, F.unhex(F.lit(h)))
    riff = starts("52494646") & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    return F.when(starts("FFD8FF"), "jpeg").when(starts("89504E470D0A1A0A"), "png").when(riff, "webp").when(starts("255044462D"), "pdf").when(starts("504B0304"), "zip").otherwise("unknown")


OFFICE = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}

# Visible text of Word and PowerPoint parts
_DROP = re.compile(r"<w:del\b[^>]*>.*?</w:del>|<w:moveFrom\b[^>]*>.*?</w:moveFrom>", re.I | re.S)


def decoded(xml: str) -> str:
    for entity, char in tx.ENTITIES:
        xml = xml.replace(entity, char)
    return xml


def docx_text(xml: str) -> str:
    xml = re.sub(r"<w:tab\b[^>]*/>", "\t", xml, flags=re.I)
    xml = re.sub(r"<w:(?:br|cr)\b[^>]*/>|</w:p>", "\n", xml, flags=re.I)
    xml = decoded(re.sub(r"<[^>]+>", "", _DROP.sub("", xml)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", xml)).strip()


#: What stands before the next closing tag, in runs without a "<".
SHOWN = re.compile(r"<a:t(?:\s[^>]*)?>([^<]*(?:<(?!/a:t>)[^<]*)*)</a:t>", re.I)


def pptx_text(xml: str) -> str:
    return "\n".join(map(decoded, SHOWN.findall(xml)))


def fingerprint(zip_: Archive, office: str) -> str | None:
    """SHA-256 of what a reader sees; raises if a part can't be read."""
    need = lambda n: (zip_.read(n) or b"").decode("utf-8", "replace")
    if office == "docx":
        return hashlib.sha256(docx_text(need("word/document.xml")).encode()).hexdigest()
    pattern = r"ppt/slides/slide\d+\.xml" if office == "pptx" else r"xl/sharedStrings\.xml|xl/worksheets/sheet\d+\.xml"
    names = sorted(n for n in zip_.entries if re.fullmatch(pattern, n, re.I))
    parts = [f"{n}\n{pptx_text(need(n))}\n".encode() if office == "pptx" else n.encode() + (zip_.read(n) or b"") for n in names]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def image_facts(kind: str, b: bytes) -> Iterator[tuple]:
    where = {"jpeg": "JPEG APP1 / EXIF", "png": "PNG eXIf", "webp": "WebP EXIF"}[kind]
    for p in images.PIECES[kind](b):
        what = images.role(kind, p)
        yield ("piece", "", p.kind, what, len(p.data))
        if kind == "png" and zlib.crc32(p.kind.encode("latin-1") + p.data) != p.crc:
            yield ("bad_crc", f"PNG {p.kind}", p.kind, None, None)
        if what == "exif":
            ok, error, fields, place = images.tiff(p.data.removeprefix(b"Exif\0\0") if kind != "png" else p.data)
            if place:
                yield ("gps", where, None, place, None)
            for tag, value in fields:
                yield ("tiff", where, dims.TIFF_TAGS[tag][1], value, tag)
            if not ok and kind == "jpeg":
                yield ("bad_exif", where, None, error, None)
        elif what == "xmp":
            raw = p.data[: dims.TEXT_METADATA]
            head, zero, rest = raw.partition(b"\0") if kind == "jpeg" and b"\0" in raw[:64] else (b"", b"", raw)
            values = images.xmp_values(rest.decode("utf-8", "replace"))
            if kind == "webp":
                more = " · metadata truncated at 4 MB safety limit" if len(p.data) > len(raw) else ""
                yield ("webp_xmp", "WebP XMP", None, (" · ".join(f"{k}: {v}" for k, v in values) or "XMP packet") + more, len(values))
            else:
                for k, v in values:
                    yield ("xmp", "JPEG APP1 / XMP", k, v, None)
                if not values:
                    yield ("xmp_packet", "JPEG APP1 / XMP", None, None, None)
        elif what == "iptc":
            yield ("iptc", "JPEG APP13", None, re.sub(r"[^\x20-\x7e]", " ", p.data[:64].decode("latin-1")).strip() or "APP13 metadata", None)
        elif what == "comment":
            yield ("comment", "JPEG COM", None, p.data.decode("utf-8", "replace"), None)
        elif what == "text":
            key, value = images.png_text(p)
            yield ("png_text", f"PNG {p.kind}", key, value, None)
        elif what == "time":
            d = p.data
            yield ("png_time", "PNG tIME", None, f"{d[0] << 8 | d[1]}-{d[2]:02}-{d[3]:02} {d[4]:02}:{d[5]:02}:{d[6]:02} UTC" if len(d) >= 7 else "tIME chunk", None)
        elif what == "provenance":
            yield ("provenance", {"jpeg": "JPEG APP11", "png": "PNG caBX", "webp": "WebP container"}[kind], None, None, None)
    yield ("fingerprint", "", None, hashlib.sha256(images.pixel_bytes(kind, b)).hexdigest(), None)


#: Names and words that mark a PDF feature, in inflated streams and the bytes outside of them.
PDF_MARKS = {
    "javascript": r"/(?:JavaScript|JS)(?![A-Za-z0-9_])",
    "opens": r"/(?:OpenAction|AA)(?![A-Za-z0-9_])",
    "launch": r"/(?:Launch|SubmitForm|ImportData)(?![A-Za-z0-9_])",
    "embedded": r"/(?:EmbeddedFiles|FileSpec|EmbeddedFile|RichMedia)(?![A-Za-z0-9_])",
    "form": r"/(?:AcroForm|XFA)(?![A-Za-z0-9_])",
    "signature": r"/Type\s*/Sig(?![A-Za-z0-9_])|/ByteRange\s*\[",
    "provenance": r"(?i)c2pa|jumbf|content credentials",
}
PDF_PATTERNS = {mark: re.compile(p) for mark, p in PDF_MARKS.items()}
ENCRYPTED = re.compile(r"/Encrypt(?![A-Za-z0-9_])")


def pdf_facts(b: bytes) -> Iterator[tuple]:
    outside, more = pdfs.split(b)
    raw = pdfs.cp1252(outside)
    whole = "\n".join([raw, *map(pdfs.cp1252, more)])
    info, linked = pdfs.values(whole)
    for key, value in pdfs.properties(whole, info):
        yield ("pdf_property", "PDF Info/XMP", key, value, None)
    if links := pdfs.urls(whole, linked):
        yield ("pdf_urls", "PDF annotations/actions", None, " · ".join(links[:12]), len(links))
    marks = [mark for mark, p in PDF_PATTERNS.items() if p.search(whole)] + ["encrypted"] * bool(ENCRYPTED.search(raw))
    ends, refs = outside.count(b"%%EOF"), outside.count(b"startxref")
    yield ("pdf", "", (re.match(r"%PDF-([0-9.]+)", raw) or [None, None])[1], " ".join(marks), len(more))
    yield ("pdf_saves", "", None, f"{ends} EOF markers · {refs} startxref markers", max(ends, refs))
    yield ("fingerprint", "", None, hashlib.sha256(b).hexdigest(), None)


#: The characters of both classes; counting each by itself costs nothing in texts that can't hold it.
INVISIBLE = {kind: [c for c in map(chr, range(0x10000)) if re.match(p, c)] for kind, p in (("zero_width", tx.ZERO_WIDTH), ("bidi", tx.BIDI))}
#: Parts whose text the rules read; of others only what is counted here becomes a fact.
LOOKED_INTO = re.compile(r"\.rels$|^docProps/|^word/(?:document|settings)\.xml$|^xl/workbook\.xml$|^ppt/slides/slide\d+\.xml$|(?:^|/)(?:comments|threadedComments|persons)\d*\.xml$|^word/(?:commentsExtended|commentsIds|people)\.xml$", re.I)

#: Of a slide the rules read no more than the attribute that hides it; its text would be kept as often as there are slides.
SLIDE = re.compile(r"ppt/slides/slide\d+\.xml$", re.I)
HIDING = re.compile(r"""(?<![A-Za-z0-9_])show=["']0["']""", re.I | re.A)


def hiding(xml: str) -> str:
    found = HIDING.search(xml) if "show=" in xml.lower() else None
    return found[0] if found else ""


def zip_facts(b: bytes) -> Iterator[tuple]:
    try:
        zip_ = Archive(b)
    except ZipError as x:
        yield ("type", "", "zip", str(x), None)
        yield ("zip_error", "ZIP central directory", x.code, str(x), None)
        return
    office = next((k for n, k in OFFICE.items() if n in zip_.entries), None)
    yield ("type", "", office or "zip", None, len(zip_.entries))
    if office is None:
        return
    texts = 0
    for n, e in zip_.entries.items():
        yield ("entry", n, "encrypted" if e.encrypted else "directory" if e.directory else "file", str(e.crc), e.size)
        if n.endswith((".xml", ".rels")) and (value := zip_.text(n)):
            if n.endswith(".xml") and not n.startswith("_xmlsignatures/"):
                texts += 1
                for kind, chars in INVISIBLE.items():
                    if texts <= TEXT_PARTS and (found := sum(map(value.count, chars))):
                        yield ("invisible", n, kind, None, found)
            if LOOKED_INTO.search(n):
                yield ("part", n, office, hiding(value) if SLIDE.match(n) else value, None)
    try:
        yield ("fingerprint", "", None, fingerprint(zip_, office), None)
    except ZipError as x:
        yield ("unreadable", "OOXML package", x.code, str(x), None)
    if office == "docx" and (document := zip_.text("word/document.xml")):
        yield ("preview", "word/document.xml", None, pdfs.shorten(docx_text(document), 800), None)


def file_facts(kind: str, b: bytes) -> Iterator[tuple]:
    if kind == "zip":
        yield from zip_facts(b)
        return
    yield ("type", "", kind, None, None)
    if kind in images.PIECES:
        yield from image_facts(kind, b)
    elif kind == "pdf":
        yield from pdf_facts(b)


def facts(files: DataFrame) -> DataFrame:
    """All facts of the files, without a shuffle; the first one of each file has its name, claimed type, length and SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(every(batch), ARROW)

    def every(batch: pa.RecordBatch) -> Iterator[tuple]:
        for r in rows_of(batch):
            content = r["content"]
            yield (r["file_id"], 0, "file", r["name"], r["claimed_mime"], hashlib.sha256(content).hexdigest(), len(content))
            for k, (fact, path, key, value, n) in enumerate(file_facts(r["kind"], content), 1):
                yield (r["file_id"], k, fact, clean_text(path), clean_text(key), clean_text(value), n)

    return files.select("file_id", "name", "claimed_mime", magic_kind(F.col("content")).alias("kind"), "content").where("content is not null").mapInArrow(run, SCHEMA)


def clean_text(value: str | None) -> str | None:
    """Text that can be written as UTF-8 (lone surrogates become question marks)."""
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode()
