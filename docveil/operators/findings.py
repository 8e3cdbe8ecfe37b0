"""Findings of all files: deduplicated, ordered, counted and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dims
from .rules import lookup

SAME = ("category", "severity", "title", "path", "evidence")


def rank_of(severity: Column) -> Column:
    return lookup(dims.RANK, severity, F.lit(9))


def weight_of(severity: Column) -> Column:
    return lookup(dims.WEIGHT, severity, F.lit(0))


def category_label(category: Column) -> Column:
    return lookup(dims.CATEGORY_LABEL, category, category)


def deduplicated(findings: DataFrame, order: tuple[str, ...] = ("stage", "seq", "item")) -> DataFrame:
    """The first of findings that say the same of a file; null and empty are the same."""
    same = [F.coalesce(F.col(c), F.lit("")) for c in SAME]
    w = Window.partitionBy("file_id", *same).orderBy(*order)
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered(findings: DataFrame, order: tuple[str, ...] = ("stage", "seq", "item")) -> DataFrame:
    """Adds place (from 1 in each file: severity, category, title, then order of discovery) and finding_id."""
    w = Window.partitionBy("file_id").orderBy(rank_of(F.col("severity")), F.collate(F.col("category"), "UNICODE"), F.collate(F.col("title"), "UNICODE"), *order)
    out = findings.withColumn("place", F.row_number().over(w))
    return out.withColumn("finding_id", F.concat(F.lit("finding-"), F.col("place").cast("string")))


def level(score: Column, critical: Column, high: Column) -> Column:
    return F.when((score >= 75) | (critical > 0), "critical").when((score >= 45) | (high >= 2), "high").when((score >= 20) | (high >= 1), "medium").when(score > 0, "low").otherwise("clear")


def summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each file: score, level, counts by severity, categories, total, actionable, cleanable."""
    s = F.col("severity")
    sums = [F.sum(weight_of(s)).alias("score"), *[F.count_if(s == k).alias(k) for k in dims.WEIGHT], F.count("*").alias("total"), F.count_if(s != "info").alias("actionable"), F.count_if("cleanable").alias("cleanable")]
    parts = findings.groupBy("file_id", "category").agg(*sums)
    whole = [F.sum(c).cast("int").alias(c) for c in (*dims.WEIGHT, "total", "actionable", "cleanable")]
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.col("total").cast("int"))))).alias("categories")
    counted = parts.groupBy("file_id").agg(F.least(F.lit(100), F.greatest(F.lit(0), F.sum("score"))).cast("int").alias("score"), *whole, listed)
    out = files.select("file_id").join(counted, "file_id", "left")
    numbers = ["score", *dims.WEIGHT, "total", "actionable", "cleanable"]
    out = out.fillna(0, numbers).withColumn("categories", F.coalesce("categories", F.create_map().cast("map<string,int>")))
    return out.withColumn("level", level(F.col("score"), F.col("critical"), F.col("high")))


def category_summary(findings: DataFrame) -> DataFrame:
    """category, label and count, most frequent first."""
    rows = findings.groupBy("category").agg(F.count("*").alias("count")).withColumn("label", category_label(F.col("category")))
    return rows.orderBy(F.desc("count"), F.collate(F.col("label"), "UNICODE"))


def gate(summaries: DataFrame, threshold: str) -> DataFrame:
    """One row: whether any file's level reaches the threshold."""
    if threshold not in dims.LEVEL_RANK:
        raise ValueError(f"unknown level {threshold!r}; one of {', '.join(dims.LEVEL_RANK)}")
    return summaries.agg(F.coalesce(F.bool_or(lookup(dims.LEVEL_RANK, F.col("level"), F.lit(0)) >= dims.LEVEL_RANK[threshold]), F.lit(False)).alias("failed"))


def with_severity(findings: DataFrame, chosen: str) -> DataFrame:
    """``all``; ``high`` means high and critical; any other level means itself."""
    if chosen == "all":
        return findings
    return findings.where(F.col("severity").isin(["critical", "high"] if chosen == "high" else [chosen]))


def facets(summaries: DataFrame) -> DataFrame:
    """file_id, facet, count: buttons worth showing; a level without findings is shown only if there are none at all."""
    pairs = F.array(F.struct(F.lit("all").alias("facet"), F.col("total").alias("count")), *[F.struct(F.lit(k).alias("facet"), F.col(k).alias("count")) for k in dims.RANK])
    rows = summaries.select("file_id", "total", F.explode(pairs).alias("f")).select("file_id", "total", "f.*")
    return rows.where((F.col("count") > 0) | (F.col("count") == F.col("total"))).drop("total")


def summary_strip(findings: DataFrame) -> DataFrame:
    """One row of five numbers over all findings."""
    s, c = F.col("severity"), F.col("category")
    return findings.agg(F.count_if(s != "info").alias("actionable"), F.count_if(s.isin("critical", "high")).alias("grave"), F.count_if(c.isin("identity", "location")).alias("personal"), F.count_if(c == "external").alias("external"), F.count_if("cleanable").alias("cleanable"))


def offered_actions(findings: DataFrame, types: DataFrame) -> DataFrame:
    """file_id, action, label, default, destructive: what could be cleaned in each file."""
    rows = findings.where("clean_action is not null").select("file_id", F.col("clean_action").alias("action")).distinct().join(types.select("file_id", "kind", "type_name"), "file_id")
    word_only = F.col("action").isin("office-comments", "office-accept-changes")
    rows = rows.where((F.col("kind").isin("jpeg", "png", "webp") & (F.col("action") == "image-metadata")) | ((F.col("kind") == "ooxml") & (~word_only | (F.col("type_name") == "docx"))))
    side = F.create_map(*[x for k, v in dims.ACTIONS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("label"), F.lit(v[1]).alias("default"), F.lit(v[2]).alias("destructive")))])
    return rows.select("file_id", "action", side[F.col("action")]["label"].alias("label"), side[F.col("action")]["default"].alias("default"), side[F.col("action")]["destructive"].alias("destructive"))
