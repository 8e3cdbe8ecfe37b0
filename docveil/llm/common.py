"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset in local mode, as in tests."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not (spark.conf.get("spark.master", "") or "").startswith("local") or "local-cluster" in spark.conf.get("spark.master", ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="docveil-"))
    return _OWN_FOLDER[0]


HEAVY = 2000


def dealt(rows: DataFrame, side: DataFrame, key: str, other: str, counted: DataFrame | None = None, salt: str = "salt") -> tuple[DataFrame, DataFrame]:
    """rows and side with a salt, to be joined on key and salt: keys of more than HEAVY rows are dealt by ``other``.

    There are at most rows / HEAVY such keys, which are broadcast; side has one row for each key. counted: where to count them, else in rows.
    """
    parts = f"{salt}_parts"
    heavy = F.broadcast((rows if counted is None else counted).groupBy(key).agg(F.ceil(F.count("*") / HEAVY).alias(parts)).where(F.col(parts) > 1))
    n = F.coalesce(parts, F.lit(1))
    a = rows.join(heavy, key, "left").withColumn(salt, F.pmod(F.xxhash64(other), n)).drop(parts)
    b = side.join(heavy, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop(parts)
    return a, b


def materialize(df: DataFrame, name: str, compression: str = "snappy", deltas: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives executors. deltas: whole numbers as differences, which suits sorted ones."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.writer.version", "v2" if deltas else "v1").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(stored: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and that nothing will read again."""
    jvm = stored.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver's JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id's text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def in_chunks(texts: list, most_chars: int = 4_000_000):
    """Slices (start, end) of a batch of texts, so that scratch arrays stay small; one text is never cut."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if chars and chars + n > most_chars:
            yield start, k
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and where each text begins (one more entry at the end)."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return codes, starts


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums_by_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for each i, empty slices 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back_memory(large: int = 1 << 20) -> None:
    """Makes this worker return arrays of more than ``large`` bytes to the system as soon as they are freed.

    glibc otherwise raises that limit up to 32 MB as arrays are freed, and a worker that is used again keeps them.
    """
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, large)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows
