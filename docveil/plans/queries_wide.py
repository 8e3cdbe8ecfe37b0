"""Further queries over carriers: rules, limits, cleaning and reports that ``queries`` doesn't reach.

Each carrier holds its document's whole text, so that what is found in it depends on the text.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.operators import dims
from docveil.sources import carriers as make
from docveil.sources import facts as source
from docveil.sources.zipfiles import END, build

from . import cleaning, inspect
from .queries import CHECKED, carried, docx_of, expected, query, shown, table
from .queries import oracle_sql as oracle_sql  # noqa: PLC0414
from .queries import queries as queries  # noqa: PLC0414

PRINTED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def cut(sql: str, n: int) -> str:
    return f"CASE WHEN length({sql}) > {n} THEN left({sql}, {n - 1}) || '…' ELSE {sql} END"


# --- Office packages

CORE = {"cp:keywords": "lang", "dc:subject": "'s' || (doc_id % 7)", "cp:category": "'c' || (doc_id % 3)", "dcterms:created": "'2026-01-02T03:04:05Z'", "dcterms:modified": "'2026-02-03T04:05:06Z'", "cp:lastPrinted": "'2026-03-04T05:06:07Z'"}
APP = {"Company": "source", "Manager": "'m' || (doc_id % 5)", "Template": "'Normal.dotm'", "Application": "'Writer'", "AppVersion": "'16.0'", "HyperlinkBase": "'https://base.example/' || (doc_id % 9)"}


def properties_of(r) -> bytes:
    d = r.doc_id
    core = {"cp:keywords": r.lang, "dc:subject": f"s{d % 7}", "cp:category": f"c{d % 3}", "dcterms:created": "2026-01-02T03:04:05Z", "dcterms:modified": "2026-02-03T04:05:06Z", "cp:lastPrinted": "2026-03-04T05:06:07Z"}
    app = {"Company": r.source, "Manager": f"m{d % 5}", "Template": "Normal.dotm", "Application": "Writer", "AppVersion": "16.0", "HyperlinkBase": f"https://base.example/{d % 9}"}
    xml = lambda root, cells: f"<{root}>{''.join(f'<{k}>{v}</{k}>' for k, v in cells.items() if v)}</{root}>".encode()
    custom = "".join(f'<property fmtid="{k}" name="P{k}"><vt:lpwstr>v{d % 4}</vt:lpwstr></property>' for k in range(32))
    return make.docx(r.text or "", extra=(("docProps/app.xml", xml("Properties", app)), ("docProps/custom.xml", f"<Properties>{custom}</Properties>".encode())), core_xml=xml("cp:coreProperties", core))


def property_rows() -> list[tuple]:
    listed = [(t, c, s, CORE[tag]) for tag, t, c, s in dims.CORE_PROPERTIES if tag in CORE] + [(t, c, s, APP[tag]) for tag, t, c, s in dims.APP_PROPERTIES]
    listed = [(t, c, s, v, f"{v} IS NOT NULL") for t, c, s, v in listed]
    thirty = " || ' · ' || ".join(f"'P{k}: v' || (doc_id % 4)" for k in range(30))  # no more than 30 are shown
    return [*listed, ("Custom document properties", "privacy", "medium", cut(f"({thirty})", 360), "true")]


@query(expected(*property_rows()))
def docx_properties(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "docx", properties_of)))


def active_of(r) -> bytes:
    d = r.doc_id
    codes = "".join(f"<w:instrText> DDEAUTO c{k} </w:instrText>" for k in range(d % 11))
    body = f"<w:document><w:body><w:p><w:r>{codes}<w:instrText>PAGE</w:instrText><w:t>{make.escape(r.text or '')}</w:t></w:r></w:p></w:body></w:document>".encode()
    extra = [(f"word/header{k}.xml", "<w:hdr>\u202e\u2066</w:hdr>".encode()) for k in range(d % 10)]
    extra += [(f"word/embeddings/o{k:02}.xlsx", b"PK") for k in range(d % 14)]
    extra += [("word/vbaProject.bin", b"1"), ("word/activeX/activeX1.xml", b"<a/>")] if d % 7 == 0 else []
    return make.encrypted(make.docx("", document=body, extra=(*extra, ("word/media/locked.dat", b"x"))), "word/media/locked.dat") if d % 3 == 0 else make.docx("", document=body, extra=tuple(extra))


def listed(item: str, n: str, most: int, sep: str = ", ") -> str:
    """The first items of a list in SQL; {k} is the item's number."""
    return f"array_to_string(list_transform(range(least({n}, {most})), lambda k: {item}), '{sep}')"


@query(expected(
    ("External or dynamic field codes", "active", "high", listed("'DDEAUTO c' || k", "doc_id % 11", 8, " · "), "doc_id % 11 > 0"),
    ("Bidirectional control characters", "active", "high", "(2 * (doc_id % 10)) || ' controls in ' || " + listed("'word/header' || k || '.xml'", "doc_id % 10", 8), "doc_id % 10 > 0"),
    ("Embedded files or OLE objects", "embedded", "high", listed("'word/embeddings/o' || lpad(k::VARCHAR, 2, '0') || '.xlsx'", "doc_id % 14", 12), "doc_id % 14 > 0"),
    ("Macros or ActiveX content", "active", "critical", "CASE WHEN doc_id % 7 = 0 THEN 'word/vbaProject.bin, word/activeX/activeX1.xml' ELSE 'Macro-enabled file extension' END", "doc_id % 7 = 0 OR doc_id % 5 = 0"),
    ("Encrypted package entries", "structure", "high", "'1 encrypted entries'", "doc_id % 3 = 0"),
))
def docx_active(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "docx", active_of, lambda r: f"doc{r.doc_id}.{'docm' if r.doc_id % 5 == 0 else 'docx'}")))


@query(f"SELECT 'd' || doc_id AS file_id, {cut(PRINTED, 800)} AS preview FROM documents")
def docx_preview(spark, sf_dir):
    s = inspect.scan(carried(spark, sf_dir, "docx", lambda r: make.docx(r.text or "")))
    return s.facts.where("fact = 'preview'").select("file_id", F.col("value").alias("preview"))


def slides_of(r) -> bytes:
    slides = [(f"ppt/slides/slide{k}.xml", f"<p:sld><a:t>{make.escape(r.text or '')}</a:t><a:t>{k}</a:t></p:sld>".encode()) for k in range(1, 13)]
    return build([("[Content_Types].xml", b"<Types/>"), ("ppt/presentation.xml", b"<p:presentation/>"), *slides])


@query("SELECT 'd' || doc_id AS file_id, sha256(string_agg('ppt/slides/slide' || k || '.xml' || chr(10) || text || chr(10) || k || chr(10), '' ORDER BY 'ppt/slides/slide' || k || '.xml')) AS fingerprint FROM documents, range(1, 13) AS s(k) GROUP BY doc_id")
def pptx_fingerprint(spark, sf_dir):
    facts = source.facts(source.from_table(carried(spark, sf_dir, "pptx", slides_of)))  # read once, so not kept
    return facts.where("fact = 'fingerprint'").select("file_id", F.col("value").alias("fingerprint"))


# --- packages that must be refused


def limits_of(r) -> bytes:
    body = (r.text or "x").encode()
    b = build([("word/document.xml", body), ("a.bin", b"1234"), ("b.bin", b"1234"), ("c.bin", b"1234")])
    which = r.doc_id % 5
    if which == 1:  # says it holds too many entries
        at = b.rindex(END)
        return b[: at + 8] + struct.pack("<2H", 10_001, 10_001) + b[at + 12 :]
    sizes = {2: {"a.bin": 130 << 20}, 3: {"a.bin": 2 << 20}, 4: dict.fromkeys(("a.bin", "b.bin", "c.bin"), 119 << 20)}.get(which, {})
    for name, size in sizes.items():
        b = make.forged(b, name, size, packed=0 if which == 4 else None)
    return b


@query("SELECT 'd' || doc_id AS file_id, list_value(NULL, 'TOO_MANY_ENTRIES', 'ZIP_BOMB', 'ZIP_BOMB', 'ZIP_BOMB')[doc_id % 5 + 1] AS code, list_value(NULL, 'Archive contains too many entries (10001).', 'Archive expands beyond the configured safety limit.', 'Suspicious compression ratio in a.bin.', 'Archive expands beyond the configured safety limit.')[doc_id % 5 + 1] AS message FROM documents")
def zip_limits(spark, sf_dir):
    s = inspect.scan(carried(spark, sf_dir, "docx", limits_of))
    codes = s.facts.where("fact = 'zip_error'").select("file_id", F.col("key").alias("code"))
    told = s.findings.where("title = 'Invalid or unsafe ZIP package'").select("file_id", F.col("evidence").alias("message"))
    return s.types.select("file_id").join(codes, "file_id", "left").join(told, "file_id", "left")


def plain_of(r) -> bytes:
    text = (r.text or "x").encode()
    return [text, build([("a.txt", text)]), make.jpeg(text.decode()[:200]), make.png((("Note", text.decode()),))][r.doc_id % 4]


@query(expected(
    ("File type mismatch", "compatibility", "medium", "'Detected ' || list_value('Unknown file', 'ZIP archive', 'JPEG image', 'PNG image')[doc_id % 4 + 1] || '; extension .jpg; claimed image/jpeg'", "doc_id % 4 <> 2"),
    ("Unsupported file type", "compatibility", "info", "NULL", "doc_id % 4 = 0"), ("Generic ZIP archive", "compatibility", "info", "NULL", "doc_id % 4 = 1"),
    ("JPEG comment", "privacy", "medium", "nullif(trim(regexp_replace(left(text, 200), '\\s+', ' ', 'g')), '')", "doc_id % 4 = 2"), ("PNG text: Note", "privacy", "low", cut(PRINTED, 360), "doc_id % 4 = 3"),
))
def dispatch_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "jpg", plain_of)))


# --- PDF


def hexadecimal(text: str) -> str:
    return f"<{(b'\xfe\xff' + text.encode('utf-16-be')).hex().upper()}>"


def features_of(r) -> bytes:
    d, rows = r.doc_id, []
    rows.append(f"/Author {hexadecimal(r.source or 'x')} /Title (a\\(b\\)\\101\\\\ {d % 7}) /Keywords <6B{d % 10 + 0x30:02X}>")
    rows += ["/OpenAction 5 0 R"] * (d % 2) + ["/EmbeddedFiles 6 0 R"] * (d % 3 == 0) + ["/Type /Sig"] * (d % 4 == 0) + ["/Encrypt 7 0 R"] * (d % 5 == 0) + ["(c2pa)"] * (d % 6 == 0)
    rows += [f"<xmp:CreatorTool>Tool &amp; <b>{d % 8}</b></xmp:CreatorTool>"]
    rows += [f"/URI (https://u.example/{k:02})" for k in range(d % 100)]
    text = zlib.compress((r.text or "").replace("/", " ").encode())
    while text[-1:] in (b"\r", b"\n"):  # line ends before endstream aren't data
        text = zlib.compress(zlib.decompress(text) + b" ")
    body = ("%PDF-1.6\n" + "\n".join(f"{k} 0 obj << {x} >> endobj" for k, x in enumerate(rows, 1)) + "\n9 0 obj << /Filter /FlateDecode >> ").encode("latin-1")
    return body + b"stream\n" + text + b"\nendstream endobj\nstartxref\n0\n%%EOF\n"


HAS_C2PA = "(doc_id % 6 = 0 OR regexp_matches(text, '(?i)c2pa|jumbf|content credentials'))"
URIS = listed("'https://u.example/' || lpad(k::VARCHAR, 2, '0')", "doc_id % 100", 12, " · ")


@query(expected(
    ("PDF Author", "identity", "medium", "source", "true"), ("PDF Title", "privacy", "low", "'a(b)A\\ ' || (doc_id % 7)", "true"), ("PDF Keywords", "privacy", "low", "'k' || (doc_id % 10)", "true"), ("PDF Creator tool", "privacy", "low", "'Tool & ' || (doc_id % 8)", "true"),
    ("Automatic document action", "active", "high", "NULL", "doc_id % 2 = 1"), ("Embedded files or rich media", "embedded", "high", "NULL", "doc_id % 3 = 0"), ("Digital signature data", "integrity", "info", "NULL", "doc_id % 4 = 0"),
    ("Encrypted PDF", "structure", "high", "NULL", "doc_id % 5 = 0"), ("Possible Content Credentials data", "provenance", "info", "NULL", HAS_C2PA), ("External links", "external", "medium", URIS, "doc_id % 100 > 0"),
))
def pdf_features(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "pdf", features_of)))


@query("SELECT 'd' || doc_id AS file_id, '1.6' AS version, 1::BIGINT AS streams, CASE WHEN doc_id % 100 > 0 THEN least(doc_id % 100, 80) END::BIGINT AS links FROM documents")
def pdf_facts_kept(spark, sf_dir):
    """Version, inflated streams, and distinct link targets, of which no more than 80 are read."""
    facts = inspect.scan(carried(spark, sf_dir, "pdf", features_of)).facts
    return facts.groupBy("file_id").agg(F.max(F.when(F.col("fact") == "pdf", F.col("key"))).alias("version"), F.max(F.when(F.col("fact") == "pdf", F.col("n"))).alias("streams"), F.max(F.when(F.col("fact") == "pdf_urls", F.col("n"))).alias("links"))


# --- images


def jpeg_of(r) -> bytes:
    d, text = r.doc_id, r.text or "x"
    exif = make.tiff({0x0132: f"2026:01:{d % 28 + 1:02} 00:00:00", 0x9003: "2026:02:02 00:00:00", 0x9004: "2026:03:03 00:00:00"}) if d % 2 else b"XX\0\0\0\0\0\0"
    values = [f"<dc:creator>{make.escape(r.source or 'x')}</dc:creator>", f'<x xmp:CreateDate="2026-0{d % 9 + 1}-01" exif:GPSLatitude="{d % 90},0N"/>']
    xmp = {0: "<x/>", 1: "".join(values), 2: f'<x {" ".join(f"""xmp:CreatorTool="t{k}" """ for k in range(50))}/>'}[d % 3]
    return make.jpeg(text.encode()[:60_000].decode("utf-8", "ignore"), exif, xmp=xmp)


def xmp_rows() -> list[tuple]:
    tools = [("XMP Creator tool", "privacy", "low", f"'t{k}'", "doc_id % 3 = 2") for k in range(40)]  # of 50 values 40 are read
    return [*tools, ("XMP Creator", "identity", "medium", "source", "doc_id % 3 = 1"), ("XMP Create date", "privacy", "low", "'2026-0' || (doc_id % 9 + 1) || '-01'", "doc_id % 3 = 1"), ("XMP GPS latitude", "location", "high", "(doc_id % 90) || ',0N'", "doc_id % 3 = 1"), ("XMP metadata packet", "privacy", "low", "NULL", "doc_id % 3 = 0")]


@query(expected(
    ("JPEG comment", "privacy", "medium", cut(PRINTED, 360), "true"), ("Modified time", "privacy", "low", "'2026:01:' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00'", "doc_id % 2 = 1"),
    ("Original capture time", "privacy", "low", "'2026:02:02 00:00:00'", "doc_id % 2 = 1"), ("Digitized time", "privacy", "low", "'2026:03:03 00:00:00'", "doc_id % 2 = 1"),
    ("Malformed EXIF block", "integrity", "low", "'Invalid TIFF byte order.'", "doc_id % 2 = 0"), *xmp_rows(),
))
def jpeg_metadata(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "jpg", jpeg_of)))


def png_parts(r) -> bytes:
    text, d = (r.text or "x").encode(), r.doc_id
    parts = [make.chunk(b"zTXt", b"Story\0\0" + zlib.compress(text)), make.chunk(b"iTXt", b"Author\0\0\0en\0t\0" + (r.source or "x").encode()), make.chunk(b"tEXt", b"Bad\0a\xffb")]
    parts += [make.chunk(b"tEXt", b"K\0v", damage=1)] * (d % 2)
    return make.png(extra=tuple(parts))


@query(expected(
    ("PNG text: Story", "privacy", "low", cut(PRINTED, 360), "true"), ("PNG text: Author", "identity", "medium", "source", "true"), ("PNG text: Bad", "privacy", "low", "'a�b'", "true"),
    ("PNG text: K", "privacy", "low", "'v'", "doc_id % 2 = 1"), ("Invalid PNG chunk checksum", "integrity", "high", "'tEXt'", "doc_id % 2 = 1"),
))
def png_parts_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "png", png_parts)))


def webp_of(r) -> bytes:
    text = (r.text or "x").translate(dict.fromkeys(map(ord, "<'\""), " "))
    return make.webp(xmp=f'<x xmp:CreatorTool="{make.escape(text[:200])}"/>', provenance=r.doc_id % 3 == 0)


@query(expected(("Content Credentials data detected", "provenance", "info", "NULL", "doc_id % 3 = 0"), ("WebP XMP metadata", "privacy", "medium", "'Creator tool: ' || trim(regexp_replace(translate(left(text, 200), '<''\"', '   '), '\\s+', ' ', 'g'))", "length(trim(text)) > 0")))
def webp_metadata(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "webp", webp_of)))


# --- cleaning

FULL_BEFORE = "(1 + (doc_id % 3 > 0)::INT + 2 * (doc_id % 2 = 1)::INT + (doc_id % 5 > 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 4 > 0)::INT + (doc_id % 6 = 0)::INT)"
FULL_AFTER = "((doc_id % 2 = 1)::INT + (doc_id % 4 > 0)::INT)"
FULL_GONE = "((doc_id % 5 > 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 6 = 0)::INT + (doc_id % 11 = 0)::INT + (doc_id % 2 = 1)::INT)"


@query(f"SELECT 'd' || doc_id AS file_id, true AS same_content, {FULL_BEFORE} AS original_findings, {FULL_AFTER} AS sanitized_findings, {FULL_BEFORE} - {FULL_AFTER} AS reduced_by, {FULL_GONE}::INT AS gone, (3 + (doc_id % 11 = 0)::INT)::INT AS warned FROM documents")
def clean_everything(spark, sf_dir):
    """All actions, signed packages too: what stays is hidden text and zero-width characters."""
    out = cleaning.clean(inspect.scan(carried(spark, sf_dir, "docx", docx_of)), list(dims.ACTIONS), force_signed=True)
    return out.select(*CHECKED, F.size("removed").alias("gone"), F.size("warnings").alias("warned"))


def marked_up(r) -> bytes:
    """Nested changes, comment marks with runs that get empty, and wrapped custom XML around the text."""
    text = make.escape(r.text or "")
    body = (
        f'<w:document><w:body><w:ins w:id="1"><w:r><w:t>{text}</w:t></w:r><w:del w:id="2"><w:r><w:delText>old</w:delText></w:r><w:del w:id="3"/></w:del></w:ins>'
        '<w:moveFrom w:id="4"><w:r><w:t>from</w:t></w:r></w:moveFrom><w:customXml w:element="e"><w:customXmlPr><w:attr/></w:customXmlPr><w:customXml><w:p><w:r><w:t>in</w:t></w:r></w:p></w:customXml></w:customXml>'
        '<w:commentRangeStart w:id="0"/><w:r><w:rPr><w:b/></w:rPr><w:commentReference w:id="0"/></w:r><w:commentRangeEnd w:id="0"/><w:p><w:pPr><w:pPrChange w:id="5"><w:pPr/></w:pPrChange></w:pPr></w:p></w:body></w:document>'
    )
    types = b'<Types><Override PartName="/docProps/custom.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="main"/></Types>'
    extra = (("docProps/custom.xml", b"<Properties/>"), ("word/settings.xml", b"<w:settings><w:trackRevisions/><w:zoom/></w:settings>"), ("word/_rels/document.xml.rels", make.rels(("hyperlink", "https://x.example/a", True), ("customXml", "../customXml/item1.xml", False), ("styles", "styles.xml", False))))
    return make.docx("", document=body.encode(), types=types, extra=extra)


XML_TEXT = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
CLEAN_BODY = f"'<w:document><w:body><w:r><w:t>' || {XML_TEXT} || '</w:t></w:r><w:p><w:r><w:t>in</w:t></w:r></w:p><w:p><w:pPr></w:pPr></w:p></w:body></w:document>'"


@query(f"""SELECT 'd' || doc_id AS file_id, sha256({CLEAN_BODY}) AS document, '<w:settings><w:zoom/></w:settings>' AS settings, '<Types><Override PartName="/word/document.xml" ContentType="main"/></Types>' AS types,
'{dims.REMOVED_TARGET} styles.xml' AS targets FROM documents""")
def clean_markup(spark, sf_dir):
    """Parts of cleaned copies: accepted changes, comment marks, custom XML, relationships and content types."""
    import hashlib
    import re

    import pandas as pd

    from docveil.sources.zipfiles import Archive

    def run(batches):
        for batch in batches:
            out = []
            for b in batch["content"]:
                z = Archive(bytes(b))
                out.append((hashlib.sha256(z.read("word/document.xml")).hexdigest(), z.text("word/settings.xml"), z.text("[Content_Types].xml"), " ".join(re.findall(r' Target="([^"]*)"', z.text("word/_rels/document.xml.rels")))))
            yield pd.concat([batch[["file_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["document", "settings", "types", "targets"])], axis=1)

    s = inspect.scan(carried(spark, sf_dir, "docx", marked_up))
    return cleaning.clean(s, list(dims.ACTIONS)).select("file_id", "content").mapInPandas(run, "file_id string, document string, settings string, types string, targets string")


def any_image(r) -> bytes:
    text, d = (r.text or "x"), r.doc_id
    exif = make.tiff({0x010F: "Cam"})
    return make.jpeg(text.encode()[:60_000].decode("utf-8", "ignore"), exif, "cap", d % 4 == 0) if d % 2 == 0 else make.webp(exif, "<x/>", provenance=d % 3 == 0)


IMAGE_BEFORE = "CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END"


@query(f"SELECT 'd' || doc_id AS file_id, doc_id % 4 <> 0 AS same_content, {IMAGE_BEFORE} AS original_findings, 0 AS sanitized_findings, {IMAGE_BEFORE} AS reduced_by, false AS refused FROM documents WHERE length(trim(text)) > 0")
def clean_images_forced(spark, sf_dir):
    """A JPEG's fingerprint covers its provenance segment, so taking that out by force changes it."""
    rows = carried(spark, sf_dir, "img", any_image, lambda r: f"doc{r.doc_id}.{'webp' if r.doc_id % 2 else 'jpg'}")
    some = table(spark, sf_dir, "documents").where("length(trim(text)) > 0").select(F.concat(F.lit("d"), "doc_id").alias("file_id"))
    return cleaning.clean(inspect.scan(rows.join(some, "file_id", "left_semi")), ["image-metadata"], force_provenance=True).select(*CHECKED, F.col("error").isNotNull().alias("refused"))


# --- reports of files that are just the text

MARKDOWN = """'# docveil report: doc' || doc_id || '.txt' || chr(10) || chr(10) || '- **Risk:** LOW (8/100)' || chr(10) || '- **Type:** Unknown file' || chr(10) || '- **Size:** ' || CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024 < 10 THEN printf('%.2f KB', round(n / 1024.0, 2)) ELSE printf('%.1f KB', round(n / 1024.0, 1)) END
|| chr(10) || '- **SHA-256:** `' || sha256(text) || '`' || chr(10) || '- **Generated:** 2026-01-02 03:04:05' || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || '### MEDIUM · File type mismatch' || chr(10) || chr(10) || 'Name or claimed type and content differ.' || chr(10) || chr(10)
|| '- Evidence: Detected Unknown file; extension .txt; claimed application/octet-stream' || chr(10) || '- Location: `File header`' || chr(10) || chr(10) || '### INFO · Unsupported file type' || chr(10) || chr(10) || 'JPEG, PNG, WebP, PDF, DOCX, XLSX and PPTX files are supported.' || chr(10) || '- Location: `File header`' || chr(10) || chr(10) || '---' || chr(10) || 'Generated by docveil ' || '{version}'"""


def text_reports(spark, sf_dir):
    files = carried(spark, sf_dir, "txt", lambda r: (r.text or "").encode())
    return inspect.reports(inspect.scan(files), F.lit("2026-01-02 03:04:05").cast("timestamp"))


@query(f"SELECT 'd' || doc_id AS file_id, {MARKDOWN.replace('{version}', inspect.__version__)} AS markdown FROM (SELECT *, octet_length(encode(text)) AS n FROM documents)")
def report_markdown_text(spark, sf_dir):
    return inspect.markdown_reports(text_reports(spark, sf_dir))


@query("""SELECT 'd' || doc_id AS file_id, 'doc' || doc_id || '.txt' AS name, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha, 'unknown' AS kind, true AS mismatch, 8 AS score, 'low' AS level, 2 AS findings, 'finding-1' AS first_id, 1 AS actionable, true AS inspectable, false AS sanitizable, false AS c2pa_candidate FROM documents""")
def report_json_text(spark, sf_dir):
    """JSON reports, read again."""
    rows = inspect.json_reports(text_reports(spark, sf_dir))
    at = lambda path, kind: F.get_json_object("json", f"$.{path}").cast(kind)
    cells = {"name": ("file.name", "string"), "size": ("file.size", "bigint"), "sha": ("file.sha256", "string"), "kind": ("type.kind", "string"), "mismatch": ("type.mismatch", "boolean"), "score": ("summary.score", "int"), "level": ("summary.level", "string")}
    cells2 = {"first_id": ("findings[0].finding_id", "string"), "actionable": ("summary.actionable", "int"), "inspectable": ("capabilities.inspect", "boolean"), "sanitizable": ("capabilities.sanitize", "boolean"), "c2pa_candidate": ("capabilities.c2pa_candidate", "boolean")}
    return rows.select("file_id", *[at(*v).alias(k) for k, v in cells.items()], F.size(F.from_json(F.get_json_object("json", "$.findings"), "array<struct<title: string>>")).alias("findings"), *[at(*v).alias(k) for k, v in cells2.items()])


@query(f"SELECT 'd' || doc_id AS file_id, 'LOW        8  doc' || doc_id || '.txt  (Unknown file, ' || CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024 < 10 THEN printf('%.2f KB', round(n / 1024.0, 2)) ELSE printf('%.1f KB', round(n / 1024.0, 1)) END || ')' || chr(10) || '  medium   File type mismatch: Detected Unknown file; extension .txt; claimed application/octet-stream' || chr(10) || '  info     Unsupported file type' AS line FROM (SELECT *, octet_length(encode(text)) AS n FROM documents)")
def console_text(spark, sf_dir):
    return inspect.console_lines(text_reports(spark, sf_dir))


# --- small helpers


@query("SELECT 'd' || doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'provenance,' ELSE '' END || 'xmp' AS keys FROM documents")
def metadata_keys(spark, sf_dir):
    return inspect.metadata_keys(inspect.scan(carried(spark, sf_dir, "webp", webp_of))).select("file_id", F.array_join("keys", ",").alias("keys"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN left(text, 20) ELSE '2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00.000Z' END AS iso FROM documents")
def iso_dates(spark, sf_dir):
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    value = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).otherwise(day)
    return table(spark, sf_dir, "documents").select("doc_id", tx.iso_date(value).alias("iso"))
