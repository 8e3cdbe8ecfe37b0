"""Registered queries of the inspection engine, each with its SQL where SQL can say it.

Text-native queries take findings straight from ``pages`` and ``documents``; carrier queries wrap each document into a
file of some format, scan it, and expect what follows from the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.operators import dims
from docveil.operators import findings as fo
from docveil.operators import rules
from docveil.sources import carriers as make
from docveil.sources import facts as source
from docveil.sources.batches import in_batches
from docveil.sources.zipfiles import Archive, ZipError, build

from . import cleaning, inspect

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text functions


def marked(docs: DataFrame) -> DataFrame:
    """Text with doc_id % 4 zero-width spaces and, for every tenth, a direction mark."""
    return docs.withColumn("marked", F.concat("text", F.repeat(F.lit("\u200b"), F.pmod("doc_id", F.lit(4)).cast("int")), F.when(F.col("doc_id") % 10 == 0, "\u202e").otherwise("")))


@query("""SELECT doc_id, len(regexp_extract_all(m, '[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]'))::BIGINT AS zero_width, len(regexp_extract_all(m, '[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]'))::BIGINT AS bidi
FROM (SELECT doc_id, text || repeat(chr(8203), (doc_id % 4)::INT) || CASE WHEN doc_id % 10 = 0 THEN chr(8238) ELSE '' END AS m FROM documents)""")
def invisible_chars(spark, sf_dir):
    docs = marked(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", tx.count_matches(F.col("marked"), tx.ZERO_WIDTH).cast("bigint").alias("zero_width"), tx.count_matches(F.col("marked"), tx.BIDI).cast("bigint").alias("bidi"))


@query("""SELECT page_id, u AS link, min(p)::BIGINT AS place FROM (SELECT page_id, unnest(r) AS u, generate_subscripts(r, 1) AS p FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '(?i)(?:https?://|mailto:)[^\\s<>\\[\\]()"'']+') AS r FROM pages)) GROUP BY page_id, u""")
def external_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all(F.concat("url", F.lit(" "), "html"), F.lit(r"""(?i)((?:https?://|mailto:)[^\s<>\[\]()"']+)"""), F.lit(1)).alias("r"))
    return rows.select("page_id", F.posexplode("r").alias("p", "link")).groupBy("page_id", "link").agg((F.min("p") + 1).cast("bigint").alias("place"))


@query("SELECT page_id, regexp_matches(html, '(?i)<script') AS active FROM pages")
def active_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike("(?i)<script").alias("active"))


@query("""SELECT page_id, nullif(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '') AS title FROM pages""")
def extract_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.tag_text(F.col("html"), "title").alias("title"))


@query("""SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>')) AS a FROM pages) GROUP BY ALL""")
def attribute_map(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(<a [^>]*>)"), F.lit(1))).alias("a"))
    return tags.select("page_id", tx.attribute_map(F.col("a"))["href"].alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(t) > 360 THEN left(t, 359) || '…' ELSE t END AS evidence FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def evidence_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), dims.EVIDENCE).alias("evidence"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_fingerprint_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


SAFE_SQL = "left(trim(regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|]', '-', 'g'), '\\s+', ' ', 'g')), 160)"


@query(f"SELECT page_id, {SAFE_SQL} AS name FROM pages")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_filename(F.col("url")).alias("name"))


@query(f"SELECT page_id, regexp_replace(n, '^(.+)(\\.[^.]*)$', '\\1.safe\\2') AS name FROM (SELECT page_id, {SAFE_SQL} AS n FROM pages)")
def output_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.output_filename(F.col("url")).alias("name"))


EXTENSIONS = [*dims.MIME, "txt"]
MIME_CASE = " ".join(f"WHEN {k} THEN '{dims.MIME.get(e, dims.OCTETS)}'" for k, e in enumerate(EXTENSIONS))


@query(f"SELECT doc_id, CASE doc_id % {len(EXTENSIONS)} {MIME_CASE} END AS mime FROM documents")
def mime_lookup(spark, sf_dir):
    names = F.array(*map(F.lit, EXTENSIONS))
    name = F.concat(F.lit("File."), F.upper(F.get(names, (F.col("doc_id") % len(EXTENSIONS)).cast("int"))))
    return table(spark, sf_dir, "documents").select("doc_id", tx.mime_of(name).alias("mime"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n::BIGINT || ' B' WHEN n / 1024 < 1024 THEN CASE WHEN n / 1024 >= 10 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.2f KB', round(n / 1024, 2)) END
ELSE CASE WHEN n / 1048576 >= 10 THEN printf('%.1f MB', round(n / 1048576, 1)) ELSE printf('%.2f MB', round(n / 1048576, 2)) END END AS size FROM (SELECT doc_id, (n_chars * (1 + doc_id % 1000))::DOUBLE AS n FROM documents)""")
def format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.format_bytes(F.col("n_chars") * (1 + F.col("doc_id") % 1000)).alias("size"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS html FROM documents""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.escape_html(F.col("text")).alias("html"))


@query("SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) IN ('http', 'https', 'mailto', 'ftp', 'file') AS is_url FROM pages")
def url_test(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.is_url(F.col("url")).alias("is_url"))


# --- findings of tables

FINDINGS_SQL = """f AS (
SELECT 'p' || page_id AS file_id, 0 AS stage, 'active' AS category, 'critical' AS severity, 'Embedded JavaScript' AS title, 'JavaScript action' AS evidence, 'page' AS path, NULL AS clean_action FROM pages WHERE regexp_matches(html, '<script')
UNION ALL SELECT 'p' || page_id, 1, 'external', 'medium', 'External links', url, 'page', 'office-external-links' FROM pages WHERE regexp_matches(url, '^https?:')
UNION ALL SELECT 'p' || page_id, 2, 'collaboration', 'high', 'Comments and reviewer identities', len(regexp_extract_all(html, '<!--')) || ' comment records', 'page', 'office-comments' FROM pages WHERE page_id % 3 = 0 AND contains(html, '<!--')
UNION ALL SELECT 'd' || doc_id, 3, 'structure', 'medium', 'Zero-width Unicode characters', (doc_id % 4) || ' characters', 'text', NULL FROM documents WHERE doc_id % 4 > 0
UNION ALL SELECT 'd' || doc_id, 4, 'active', 'high', 'Bidirectional control characters', '1 controls', 'text', NULL FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT 'd' || doc_id, 5, 'identity', 'medium', 'Document author', source, 'docProps/core.xml', 'office-properties' FROM documents WHERE lang = 'de'
UNION ALL SELECT 'd' || doc_id, 6, 'privacy', 'low', 'Created time', '2026', 'docProps/core.xml', 'office-properties' FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT 'd' || doc_id, 7, 'integrity', 'info', 'Digital signature data', NULL, 'text', NULL FROM documents WHERE doc_id % 8 = 0),
files AS (SELECT 'p' || page_id AS file_id FROM pages UNION ALL SELECT 'd' || doc_id FROM documents)"""
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END"
SUMMARY_SQL = f"""WITH {FINDINGS_SQL}, c AS (SELECT file_id, sum(CASE severity WHEN 'critical' THEN 28 WHEN 'high' THEN 16 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END) AS s, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) AS total, count(*) FILTER (severity <> 'info') AS actionable, count(*) FILTER (clean_action IS NOT NULL) AS cleanable FROM f GROUP BY file_id),
s AS (SELECT file_id, least(100, greatest(0, coalesce(s, 0)))::INT AS score, coalesce(critical, 0)::INT AS critical, coalesce(high, 0)::INT AS high, coalesce(medium, 0)::INT AS medium, coalesce(low, 0)::INT AS low, coalesce(info, 0)::INT AS info, coalesce(total, 0)::INT AS total, coalesce(actionable, 0)::INT AS actionable, coalesce(cleanable, 0)::INT AS cleanable FROM files LEFT JOIN c USING (file_id)),
r AS (SELECT *, CASE WHEN score >= 75 OR critical > 0 THEN 'critical' WHEN score >= 45 OR high >= 2 THEN 'high' WHEN score >= 20 OR high > 0 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'clear' END AS level FROM s) """
NUMBERS = ["score", *dims.WEIGHT, "total", "actionable", "cleanable"]


def table_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = table(spark, sf_dir, "pages"), marked(table(spark, sf_dir, "documents"))
    page = lambda *a, **k: rules.finding(*a, path="page", **k)
    comments = tx.count_matches(F.col("html"), "<!--")
    of_pages = F.concat(
        F.when(F.col("html").rlike("<script"), F.array(page(0, "active", "critical", "Embedded JavaScript", "JavaScript action"))).otherwise(EMPTY()),
        F.when(F.col("url").rlike("^https?:"), F.array(page(1, "external", "medium", "External links", F.col("url"), action=rules.LINKS))).otherwise(EMPTY()),
        F.when((F.col("page_id") % 3 == 0) & (comments > 0), F.array(page(2, "collaboration", "high", "Comments and reviewer identities", F.concat(comments.cast("string"), F.lit(" comment records")), action=rules.COMMENTS))).otherwise(EMPTY()),
    )
    zero, bidi, core = tx.count_matches(F.col("marked"), tx.ZERO_WIDTH), tx.count_matches(F.col("marked"), tx.BIDI), "docProps/core.xml"
    of_docs = F.concat(
        F.when(zero > 0, F.array(rules.finding(3, "structure", "medium", "Zero-width Unicode characters", F.concat(zero.cast("string"), F.lit(" characters")), "text"))).otherwise(EMPTY()),
        F.when(bidi > 0, F.array(rules.finding(4, "active", "high", "Bidirectional control characters", F.concat(bidi.cast("string"), F.lit(" controls")), "text"))).otherwise(EMPTY()),
        F.when(F.col("lang") == "de", F.array(rules.finding(5, "identity", "medium", "Document author", F.col("source"), core, action=rules.PROPERTIES))).otherwise(EMPTY()),
        F.when(F.col("doc_id") % 2 == 1, F.array(rules.finding(6, "privacy", "low", "Created time", "2026", core, action=rules.PROPERTIES))).otherwise(EMPTY()),
        F.when(F.col("doc_id") % 8 == 0, F.array(rules.finding(7, "integrity", "info", "Digital signature data", None, "text"))).otherwise(EMPTY()),
    )
    of_pages = rules.exploded(pages.withColumn("file_id", F.concat(F.lit("p"), "page_id")), "file_id", F.lit(0).alias("seq"), found=of_pages)
    return of_pages.unionByName(rules.exploded(docs.withColumn("file_id", F.concat(F.lit("d"), "doc_id")), "file_id", F.lit(0).alias("seq"), found=of_docs))


def EMPTY():
    return F.array().cast(f"array<struct<{rules.as_ddl()}>>")


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("file_id")).unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file_id")))


def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.summary(table_findings(spark, sf_dir), table_files(spark, sf_dir))


SHOWN = ["file_id", "category", "severity", "title", "evidence", "path", "clean_action"]


@query(f"WITH {FINDINGS_SQL} SELECT {', '.join(SHOWN)} FROM f")
def findings_union(spark, sf_dir):
    return table_findings(spark, sf_dir).select(SHOWN)


@query(f"WITH {FINDINGS_SQL} SELECT DISTINCT {', '.join(SHOWN)} FROM f")
def findings_dedupe(spark, sf_dir):
    rows = table_findings(spark, sf_dir)
    return fo.deduplicated(rows.unionByName(rows.withColumn("stage", F.col("stage") + 100))).select(SHOWN)


@query(f"WITH {FINDINGS_SQL} SELECT file_id, category, severity, title, row_number() OVER (PARTITION BY file_id ORDER BY {RANK_SQL}, category, title, stage)::INT AS place, 'finding-' || row_number() OVER (PARTITION BY file_id ORDER BY {RANK_SQL}, category, title, stage) AS finding_id FROM f")
def findings_ranked(spark, sf_dir):
    return fo.ordered(table_findings(spark, sf_dir)).select("file_id", "category", "severity", "title", "place", "finding_id")


@query(SUMMARY_SQL + "SELECT file_id, critical, high, medium, low, info FROM r")
def severity_counts(spark, sf_dir):
    return table_summary(spark, sf_dir).select("file_id", *dims.WEIGHT)


@query(f"WITH {FINDINGS_SQL} SELECT file_id, category, count(*)::INT AS n FROM f GROUP BY ALL")
def category_counts(spark, sf_dir):
    return table_summary(spark, sf_dir).select("file_id", F.explode("categories").alias("category", "n"))


@query(SUMMARY_SQL + f"SELECT file_id, level, {', '.join(NUMBERS)} FROM r")
def risk_summary(spark, sf_dir):
    return table_summary(spark, sf_dir).select("file_id", "level", *NUMBERS)


@query(SUMMARY_SQL + "SELECT level, count(*) AS files, min(score)::INT AS low_score, max(score)::INT AS high_score FROM r GROUP BY level")
def risk_level(spark, sf_dir):
    return table_summary(spark, sf_dir).groupBy("level").agg(F.count("*").alias("files"), F.min("score").alias("low_score"), F.max("score").alias("high_score"))


@query(f"WITH {FINDINGS_SQL} SELECT file_id, severity, title FROM f WHERE severity IN ('critical', 'high')")
def severity_filter(spark, sf_dir):
    return fo.with_severity(table_findings(spark, sf_dir), "high").select("file_id", "severity", "title")


@query(SUMMARY_SQL + "SELECT file_id, facet, count FROM (SELECT file_id, total, unnest(['all', 'critical', 'high', 'medium', 'low', 'info']) AS facet, unnest([total, critical, high, medium, low, info]) AS count FROM r) WHERE count > 0 OR count = total")
def facet_buttons(spark, sf_dir):
    return fo.facets(table_summary(spark, sf_dir))


LABEL_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.CATEGORY_LABEL.items()) + " ELSE category END"


@query(f"WITH {FINDINGS_SQL} SELECT category, {LABEL_SQL} AS label, count(*) AS count FROM f GROUP BY category ORDER BY count DESC, label LIMIT 4")
def top_categories(spark, sf_dir):
    return fo.category_summary(table_findings(spark, sf_dir)).limit(4).select("category", "label", "count")


@query(f"WITH {FINDINGS_SQL} SELECT category, {LABEL_SQL} AS label, count(*) AS count FROM f GROUP BY category")
def category_summary(spark, sf_dir):
    return fo.category_summary(table_findings(spark, sf_dir)).select("category", "label", "count")


@query(SUMMARY_SQL + "SELECT t AS threshold, bool_or(CASE level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END >= k) AS failed FROM r, (VALUES ('clear', 0), ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) AS v(t, k) GROUP BY t")
def threshold_gate(spark, sf_dir):
    rows = table_summary(spark, sf_dir)
    gates = [fo.gate(rows, level).select(F.lit(level).alias("threshold"), "failed") for level in dims.LEVEL_RANK]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


@query(SUMMARY_SQL + "SELECT count(*) AS files, sum(actionable)::BIGINT AS actionable FROM r")
def batch_totals(spark, sf_dir):
    return table_summary(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("actionable").alias("actionable"))


ACTION_SQL = "(VALUES " + ", ".join(f"('{k}', {str(v[1]).lower()}, {str(v[2]).lower()})" for k, v in dims.ACTIONS.items()) + ") AS a(action, is_default, destructive)"


@query(f"WITH {FINDINGS_SQL} SELECT file_id, action, is_default, destructive FROM (SELECT DISTINCT file_id, clean_action FROM f WHERE clean_action IS NOT NULL) JOIN {ACTION_SQL} ON action = clean_action")
def actions_offered(spark, sf_dir):
    types = table_files(spark, sf_dir).select("file_id", F.lit("ooxml").alias("kind"), F.lit("docx").alias("type_name"))
    return fo.offered_actions(table_findings(spark, sf_dir), types).select("file_id", "action", F.col("default").alias("is_default"), "destructive")


@query(f"WITH {FINDINGS_SQL} SELECT count(*) FILTER (severity <> 'info') AS actionable, count(*) FILTER (severity IN ('critical', 'high')) AS grave, count(*) FILTER (category IN ('identity', 'location')) AS personal, count(*) FILTER (category = 'external') AS external, count(*) FILTER (clean_action IS NOT NULL) AS cleanable FROM f")
def ui_summary_strip(spark, sf_dir):
    return fo.summary_strip(table_findings(spark, sf_dir))


# --- carriers


CARRIED = pa.schema([("file_id", pa.string()), ("name", pa.string()), ("content", pa.binary())])
WRAPPED_BYTES = 4 << 20  # a file may be many times as large as its document


def wrapped(batches: Iterator[pa.RecordBatch], suffix: str, wrap: Callable[[object], bytes], name=None) -> Iterator[pa.RecordBatch]:
    """A file for each row (doc_id, text, lang, source), few at a time."""

    def each(batch: pd.DataFrame) -> Iterator[tuple[str, str, bytes]]:
        for r in batch.itertuples():
            yield f"d{r.doc_id}", name(r) if name else f"doc{r.doc_id}.{suffix}", wrap(r)

    for batch in batches:
        for a in range(0, max(1, batch.num_rows), 1000):
            yield from in_batches(each(batch.slice(a, 1000).to_pandas()), CARRIED, WRAPPED_BYTES)


def carried(spark: SparkSession, sf_dir: str, suffix: str, wrap: Callable[[object], bytes], name=None) -> DataFrame:
    """A file for each document: file_id, name, content."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").mapInArrow(lambda batches: wrapped(batches, suffix, wrap, name), "file_id string, name string, content binary")


def shown(s: inspect.Scan) -> DataFrame:
    return s.findings.select("file_id", "category", "severity", "title", "evidence")


def expected(*rows: tuple[str, str, str, str, str], source_: str = "documents") -> str:
    """SQL of (title, category, severity, evidence SQL, condition SQL) rows."""
    one = "SELECT 'd' || doc_id AS file_id, '{}' AS category, '{}' AS severity, '{}' AS title, {} AS evidence FROM {} WHERE {}"
    return "\nUNION ALL ".join(one.format(c, s, t, e, source_, w) for t, c, s, e, w in rows)


def docx_of(r) -> bytes:
    d = r.doc_id
    return make.docx(r.text or "", r.source or "", d % 3, d % 2, f"https://example.org/{d}" if d % 2 else "", d % 5, d % 7 == 0, d % 4, d % 6 == 0, d % 11 == 0)


@query(expected(
    ("Document author", "identity", "medium", "source", "true"), ("Tracked revisions", "collaboration", "high", "(doc_id % 3) || ' revision markers'", "doc_id % 3 > 0"),
    ("Hidden Word text", "structure", "medium", "'1 hidden text markers'", "doc_id % 2 = 1"), ("External hyperlink", "external", "medium", "'https://example.org/' || doc_id", "doc_id % 2 = 1"),
    ("Comments and reviewer identities", "collaboration", "high", "(doc_id % 5) || ' comment records · authors: reviewer'", "doc_id % 5 > 0"), ("Cached document thumbnail", "privacy", "low", "'docProps/thumbnail.jpeg'", "doc_id % 7 = 0"),
    ("Zero-width Unicode characters", "structure", "medium", "(doc_id % 4) || ' characters in word/document.xml'", "doc_id % 4 > 0"), ("Custom XML data", "structure", "medium", "'1 custom XML parts'", "doc_id % 6 = 0"),
    ("Office digital signature", "integrity", "info", "'1 signature parts'", "doc_id % 11 = 0"),
))
def docx_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "docx", docx_of)))


@query(expected(("Document author", "identity", "medium", "source", "true"), ("Hidden workbook sheets", "structure", "high", "'H0 (veryHidden)'", "doc_id % 2 = 1"), ("External workbook link parts", "external", "high", "'xl/externalLinks/externalLink1.xml, xl/externalLinks/_rels/externalLink1.xml.rels'", "doc_id % 3 = 0"), ("External externalLinkPath", "external", "high", "'file:///C:/book.xlsx'", "doc_id % 3 = 0")))
def xlsx_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "xlsx", lambda r: make.xlsx(r.source or "", r.doc_id % 2, r.doc_id % 3 == 0))))


@query(expected(("Last editor", "identity", "medium", "source", "true"), ("Hidden presentation slides", "structure", "medium", "'ppt/slides/slide1.xml'", "doc_id % 2 = 1"), ("Presenter notes", "collaboration", "medium", "(doc_id % 3) || ' notes slides'", "doc_id % 3 > 0")))
def pptx_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "pptx", lambda r: make.pptx(2, r.doc_id % 2, r.doc_id % 3, r.source or ""))))


def png_of(r) -> bytes:
    d = r.doc_id
    exif = make.tiff({0x010F: f"Cam{d % 5}", 0x013B: r.source or "x"}, (d % 90, d % 60, 0), (d % 180, d % 60, 0), ("S" if d % 2 else "N", "E")) if d % 4 else b""
    return make.png((("Author", r.source or "x"), ("Note", r.lang or "x")), exif, d % 5 == 0, (make.chunk(b"tIME", bytes([7, 234, 1, 2, 3, 4, 5])),) if d % 3 == 0 else ())


@query(expected(
    ("PNG text: Author", "identity", "medium", "source", "true"), ("PNG text: Note", "privacy", "low", "lang", "true"), ("Camera make", "privacy", "low", "'Cam' || (doc_id % 5)", "doc_id % 4 > 0"), ("Artist", "identity", "medium", "source", "doc_id % 4 > 0"),
    ("Exact GPS coordinates", "location", "high", "printf('%.6f, %.6f', CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END * ((doc_id % 90) + (doc_id % 60) / 60.0::DOUBLE), (doc_id % 180) + (doc_id % 60) / 60.0::DOUBLE)", "doc_id % 4 > 0"),
    ("PNG modification time", "privacy", "low", "'2026-01-02 03:04:05 UTC'", "doc_id % 3 = 0"), ("Content Credentials data detected", "provenance", "info", "NULL", "doc_id % 5 = 0"),
))
def png_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "png", png_of)))


@query(expected(("JPEG comment", "privacy", "medium", "source", "true"), ("IPTC / Photoshop metadata", "identity", "medium", "lang", "doc_id % 3 = 0"), ("Camera model", "privacy", "low", "'Model' || (doc_id % 7)", "doc_id % 2 = 1"), ("Content Credentials data detected", "provenance", "info", "NULL", "doc_id % 5 = 0")))
def jpeg_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "jpg", lambda r: make.jpeg(r.source or "x", make.tiff({0x0110: f"Model{r.doc_id % 7}"}) if r.doc_id % 2 else b"", (r.lang or "x") if r.doc_id % 3 == 0 else "", r.doc_id % 5 == 0))))


@query(expected(("Camera body serial", "identity", "high", "source", "true"), ("WebP XMP metadata", "privacy", "medium", "'Creator tool: ' || lang", "doc_id % 2 = 1")))
def webp_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "webp", lambda r: make.webp(make.tiff({0xA431: r.source or "x"}), f'<x xmp:CreatorTool="{r.lang}"/>' if r.doc_id % 2 else ""))))


def pdf_of(r) -> bytes:
    d = r.doc_id
    return make.pdf(r.source or "x", r.lang or "x", (f"https://example.org/{d}",) if d % 5 == 0 else (), d % 3 == 0, d % 2 == 0, f"/Launch x /Subject (s{d % 6})" if d % 4 == 0 else "", 1 + d % 2)


@query(expected(
    ("PDF Author", "identity", "medium", "source", "true"), ("PDF Title", "privacy", "low", "lang", "true"), ("PDF Subject", "privacy", "low", "'s' || (doc_id % 6)", "doc_id % 4 = 0"), ("External links", "external", "medium", "'https://example.org/' || doc_id", "doc_id % 5 = 0"),
    ("Embedded JavaScript", "active", "critical", "'JavaScript with automatic or additional actions'", "doc_id % 3 = 0"), ("Interactive form data", "structure", "medium", "NULL", "doc_id % 2 = 0"), ("Launch or submit action", "active", "critical", "NULL", "doc_id % 4 = 0"),
    ("Incremental save history", "structure", "medium", "'2 EOF markers · 2 startxref markers'", "doc_id % 2 = 1"),
))
def pdf_scan(spark, sf_dir):
    return shown(inspect.scan(carried(spark, sf_dir, "pdf", pdf_of)))


def any_type(r) -> bytes:
    kinds = [lambda: make.jpeg(), lambda: make.png(), lambda: make.webp(), lambda: make.pdf(), lambda: make.docx("x"), lambda: make.xlsx(), lambda: make.pptx(), lambda: build([("a.txt", b"x")]), lambda: b"plain text"]
    return kinds[r.doc_id % 9]()


TYPE_NAMES = list(dims.TYPES)
TYPE_CASE = "list_value(" + ", ".join(f"'{k}'" for k in TYPE_NAMES) + ")[doc_id % 9 + 1]"


@query(f"SELECT 'd' || doc_id AS file_id, {TYPE_CASE} AS type_name, CASE WHEN doc_id % 9 BETWEEN 4 AND 6 THEN 'ooxml' ELSE {TYPE_CASE} END AS kind, doc_id % 9 <> 3 AS mismatch FROM documents")
def type_detect(spark, sf_dir):
    return inspect.scan(carried(spark, sf_dir, "pdf", any_type)).types.select("file_id", "type_name", "kind", "mismatch")


@query("SELECT 'd' || doc_id AS file_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha FROM documents")
def zip_roundtrip(spark, sf_dir):
    def run(batches):
        import hashlib

        for batch in batches:
            parts = [Archive(bytes(c)).read("text.txt") for c in batch["content"]]
            yield pd.DataFrame({"file_id": batch["file_id"], "size": [len(p) for p in parts], "sha": [hashlib.sha256(p).hexdigest() for p in parts]})

    return carried(spark, sf_dir, "zip", lambda r: build([("a/b.bin", b"\0"), ("text.txt", (r.text or "").encode())])).mapInPandas(run, "file_id string, size bigint, sha string")


def hostile(r) -> bytes:
    b = build([("word/document.xml", b"<a/>"), ("xx/a.txt", b"1"), ("yy/a.txt", b"2")])
    return [b, b.replace(b"yy/a.txt", b"xx/a.txt"), b.replace(b"yy/a.txt", b"../a.txt"), b[:-30]][r.doc_id % 4]


@query("SELECT 'd' || doc_id AS file_id, list_value(NULL, 'DUPLICATE_ENTRY', 'ZIP_SLIP', 'INVALID_ZIP')[doc_id % 4 + 1] AS code, doc_id % 4 > 0 AS reported FROM documents")
def hostile_zip(spark, sf_dir):
    s = inspect.scan(carried(spark, sf_dir, "docx", hostile))
    codes = s.facts.where("fact = 'zip_error'").select("file_id", F.col("key").alias("code"))
    told = s.findings.where("title = 'Invalid or unsafe ZIP package'").select("file_id", F.lit(True).alias("r"))
    return s.types.select("file_id").join(codes, "file_id", "left").join(told, "file_id", "left").select("file_id", "code", F.coalesce("r", F.lit(False)).alias("reported"))


DOCX_BEFORE = "(1 + (doc_id % 3 > 0)::INT + 2 * (doc_id % 2 = 1)::INT + (doc_id % 5 > 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 4 > 0)::INT + (doc_id % 6 = 0)::INT)"
DOCX_GONE = "(1 + (doc_id % 5 > 0)::INT + (doc_id % 7 = 0)::INT)"
CHECKED = ["file_id", "same_content", "original_findings", "sanitized_findings", "reduced_by"]


@query(f"SELECT 'd' || doc_id AS file_id, CASE WHEN doc_id % 11 > 0 THEN true END AS same_content, CASE WHEN doc_id % 11 > 0 THEN {DOCX_BEFORE} END AS original_findings, CASE WHEN doc_id % 11 > 0 THEN {DOCX_BEFORE} - {DOCX_GONE} END AS sanitized_findings, CASE WHEN doc_id % 11 > 0 THEN {DOCX_GONE} END AS reduced_by, doc_id % 11 = 0 AS refused FROM documents")
def clean_verify_docx(spark, sf_dir):
    return cleaning.clean(inspect.scan(carried(spark, sf_dir, "docx", docx_of))).select(*CHECKED, F.col("error").isNotNull().alias("refused"))


PNG_BEFORE = "(2 + 3 * (doc_id % 4 > 0)::INT + (doc_id % 3 = 0)::INT)"


@query(f"SELECT 'd' || doc_id AS file_id, CASE WHEN doc_id % 5 > 0 THEN true END AS same_content, CASE WHEN doc_id % 5 > 0 THEN {PNG_BEFORE} END AS original_findings, CASE WHEN doc_id % 5 > 0 THEN 0 END AS sanitized_findings, CASE WHEN doc_id % 5 > 0 THEN {PNG_BEFORE} END AS reduced_by, doc_id % 5 = 0 AS refused FROM documents")
def clean_verify_image(spark, sf_dir):
    return cleaning.clean(inspect.scan(carried(spark, sf_dir, "png", png_of))).select(*CHECKED, F.col("error").isNotNull().alias("refused"))


@query()
def report_json(spark, sf_dir):
    return inspect.json_reports(inspect.reports(inspect.scan(carried(spark, sf_dir, "docx", docx_of))))


@query()
def report_markdown(spark, sf_dir):
    return inspect.markdown_reports(inspect.reports(inspect.scan(carried(spark, sf_dir, "pdf", pdf_of))))


@query("SELECT 'd' || doc_id AS file_id, ZipErrorFree AS readable FROM (SELECT doc_id, doc_id % 3 = 0 AS ZipErrorFree FROM documents)")
def forged_sizes(spark, sf_dir):
    """Packages whose second part lies about its size are found out when it is read."""

    def wrap(r) -> bytes:
        b = build([("a.txt", b"12345678"), ("b.txt", b"abcdefgh")])
        at = b.rindex(b"PK\x01\x02")
        return b if r.doc_id % 3 == 0 else b[: at + 24] + b"\x07\0\0\0" + b[at + 28 :]

    def run(batches):
        for batch in batches:
            out = []
            for c in batch["content"]:
                try:
                    out.append(Archive(bytes(c)).read("b.txt") is not None)
                except ZipError:
                    out.append(False)
            yield pd.DataFrame({"file_id": batch["file_id"], "readable": out})

    return carried(spark, sf_dir, "zip", wrap).mapInPandas(run, "file_id string, readable boolean")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrivals_stream(spark, sf_dir):
    """Events counted in windows by a stream with a watermark."""
    from docveil.streaming import windowed_counts

    return windowed_counts(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
