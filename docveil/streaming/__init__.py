"""Incremental scans of a folder with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.plans.inspect import reports, scan
from docveil.sources.facts import stream_files


def scan_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Scans files as they arrive; each batch's reports are written once, under its number."""

    def one(batch: DataFrame, number: int) -> None:
        reports(scan(batch.drop("modificationTime"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_files(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, folder: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files and bytes that arrived in each window."""
    rows = stream_files(spark, folder).withWatermark("modificationTime", late)
    return rows.groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


def windowed_counts(spark: SparkSession, sf_dir: str, window: str = "1 day"):
    """Events of the table ``events`` by window and type, read as a stream with a watermark and run to its end."""
    import uuid

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/event[s].parquet")
    out, marks = (f"{folder(spark)}/arrivals-{uuid.uuid4().hex}/{x}" for x in ("counts", "marks"))

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    counts = counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    # each batch rewrites its own folder with the windows that changed; the last state of a window is in its last batch
    counts.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("day string, event_type string, n bigint, batch int").parquet(out)
    return seen.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one in local mode."""
    import tempfile

    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="docveil-")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
