"""Scanning files into findings, summaries and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil import __version__
from docveil.functions import text as tx
from docveil.operators import findings as fo
from docveil.operators import rules
from docveil.sources import facts as source

SCHEMA_URI = "urn:docveil:report:v1"


@dataclass
class Scan:
    files: DataFrame
    facts: DataFrame
    types: DataFrame
    findings: DataFrame
    summary: DataFrame

    def release(self) -> None:
        """Frees the stored facts, once results are written."""
        self.facts.unpersist()


def scan(files: DataFrame, facts: DataFrame | None = None) -> Scan:
    """files: see ``facts.from_table``. Facts are parsed once; pass stored ones to reuse them at scale."""
    files = source.from_table(files)
    facts = source.facts(files).persist() if facts is None else facts
    types = rules.type_columns(facts)
    every = rules.dispatch_findings(types).unionByName(rules.row_findings(facts)).unionByName(rules.file_findings(facts, types))
    found = fo.ordered(fo.deduplicated(every))
    return Scan(files, facts, types, found, fo.summary(found, types))


def reports(s: Scan, generated_at: Column | None = None) -> DataFrame:
    """One nested row for each file: file, type, findings in order, summary, metadata, fingerprint, preview, capabilities."""
    fields = ["finding_id", "category", "severity", "title", "description", "evidence", "path", "remediation", "cleanable", "clean_action", "tags"]
    listed = s.findings.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *fields))), lambda f: F.struct(*[f[c].alias(c) for c in fields])).alias("findings"))
    actions = fo.offered_actions(s.findings, s.types).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("action", "label", "default", "destructive"))).alias("actions"))
    extra = s.facts.groupBy("file_id").agg(
        F.max(F.when(F.col("fact") == "fingerprint", F.col("value"))).alias("fingerprint"), F.max(F.when(F.col("fact") == "preview", F.col("value"))).alias("preview"),
        F.max(F.when(F.col("fact") == "pdf", F.col("key"))).alias("pdf_version"), F.bool_or((F.col("fact") == "provenance") | ((F.col("fact") == "pdf") & F.array_contains(F.split("value", " "), "provenance"))).alias("provenance"),
        F.count_if(F.col("fact") == "entry").alias("parts"), F.count_if(F.col("fact") == "piece").alias("pieces"), F.max(F.when(F.col("fact") == "pdf", F.col("n"))).alias("streams"),
    )
    rows = s.types.join(s.summary, "file_id").join(listed, "file_id", "left").join(actions, "file_id", "left").join(extra, "file_id", "left")
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(dict(like.dtypes)[c]))
    return rows.select(
        "file_id", F.lit(SCHEMA_URI).alias("schema"), F.lit(__version__).alias("version"), (F.current_timestamp() if generated_at is None else generated_at).alias("generated_at"),
        F.struct("name", F.col("length").alias("size"), "mime", "claimed_mime", "sha256").alias("file"),
        F.struct("kind", F.when(F.col("kind") == "ooxml", F.col("type_name")).alias("office_type"), "label", "extension", "mismatch").alias("type"),
        none("findings", listed).alias("findings"),
        F.struct("score", "level", F.struct("critical", "high", "medium", "low", "info").alias("counts"), "categories", "total", "actionable", "cleanable").alias("summary"),
        F.struct("pdf_version", "parts", "pieces", F.col("streams").alias("inflated_streams")).alias("metadata"),
        F.col("fingerprint").alias("content_fingerprint"), F.col("preview").alias("text_preview"),
        F.struct(F.col("error").isNull().alias("inspect"), F.col("actions").isNotNull().alias("sanitize"), none("actions", actions).alias("actions"), F.coalesce("provenance", F.lit(False)).alias("c2pa_candidate"), (F.coalesce("provenance", F.lit(False)) & F.col("kind").isin("jpeg", "png", "webp", "pdf")).alias("c2pa_validation"), F.lit(False).alias("pdf_sanitization")).alias("capabilities"),
    )


def json_reports(reports_: DataFrame, pretty: bool = False) -> DataFrame:
    return reports_.select("file_id", F.to_json(F.struct(*[c for c in reports_.columns if c != "file_id"]), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def _line(text: str, value: Column) -> Column:
    return F.concat(F.lit(text), value)


def markdown_reports(reports_: DataFrame, evidence: bool = True) -> DataFrame:
    """file_id and a Markdown report."""

    def section(f: Column) -> Column:
        lines = [F.concat(F.lit("### "), F.upper(f["severity"]), F.lit(" · "), f["title"]), F.lit(""), f["description"]]
        shown = F.when(f["evidence"].isNotNull() & F.lit(evidence) & (f["evidence"] != ""), F.concat(F.lit("\n- Evidence: "), f["evidence"]))
        lines += [shown, F.when(f["path"].isNotNull(), F.concat(F.lit("- Location: `"), f["path"], F.lit("`"))), F.when(f["remediation"].isNotNull(), _line("- Suggested action: ", f["remediation"])), F.lit("")]
        return F.array_join(F.array(*lines), "\n")

    s, f = F.col("summary"), F.col("file")
    head = [
        _line("# docveil report: ", f["name"]), F.lit(""), F.concat(F.lit("- **Risk:** "), F.upper(s["level"]), F.lit(" ("), s["score"].cast("string"), F.lit("/100)")),
        _line("- **Type:** ", F.col("type.label")), _line("- **Size:** ", tx.format_bytes(f["size"])), F.concat(F.lit("- **SHA-256:** `"), f["sha256"], F.lit("`")),
        _line("- **Generated:** ", F.col("generated_at").cast("string")), F.lit(""), F.lit("## Findings"), F.lit(""),
    ]
    body = F.when(F.size("findings") == 0, F.lit("No findings.")).otherwise(F.array_join(F.transform("findings", section), "\n"))
    return reports_.select("file_id", F.array_join(F.array(*head, body, F.lit("---"), _line("Generated by docveil ", F.col("version"))), "\n").alias("markdown"))


def console_lines(reports_: DataFrame) -> DataFrame:
    s = F.col("summary")
    title = F.concat(F.rpad(F.upper(s["level"]), 9, " "), F.lpad(s["score"].cast("string"), 3, " "), F.lit("  "), F.col("file.name"), F.lit("  ("), F.col("type.label"), F.lit(", "), tx.format_bytes(F.col("file.size")), F.lit(")"))
    items = F.transform("findings", lambda f: F.concat(F.lit("  "), F.rpad(f["severity"], 9, " "), f["title"], F.when(f["evidence"].isNotNull(), F.concat(F.lit(": "), f["evidence"])).otherwise("")))
    return reports_.select("file_id", F.array_join(F.concat(F.array(title), items), "\n").alias("line"))


def metadata_keys(s: Scan) -> DataFrame:
    """file_id and the sorted kinds of metadata that an image has (exif, xmp, iptc, comment, text, time, provenance)."""
    kinds = s.facts.where((F.col("fact") == "piece") & ~F.col("value").isin("pixels", "other"))
    return kinds.groupBy("file_id").agg(F.array_sort(F.collect_set("value")).alias("keys"))
