"""What the operators of this subpackage share: tables, shared-folder checkpoints, hashes and run arithmetic."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters A-Z to a-z on UTF-8 bytes, which leaves every other byte alone.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Sessions whose tables are deleted when the process ends.
_TIDIED: set[str] = set()
#: Whether Spark deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local session without one a new temporary folder.

    A session on a cluster must name one: RuntimeError if it doesn't.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _tables_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pagemill-tables/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here and a lost executor costs one reread.

    This runs as soon as it is called. The shuffle files of the write are deleted when it is done. The rows stay for the
    caller's lazy plan: ``dropped`` deletes one table, ``drop_stored`` all of this session, as does the end of a Python
    process whose session is still up.
    """
    spark = df.sparkSession
    path = f"{_tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _TIDIED:
        _TIDIED.add(spark.sparkContext.applicationId)
        atexit.register(_tidy, spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``stored`` returned, once nothing reads it any more."""
    _deleted(table.sparkSession, table._stored_at)


def drop_stored(spark: SparkSession) -> None:
    """Deletes every table that ``stored`` wrote in this session; those of other sessions stay."""
    _deleted(spark, _tables_folder(spark))


def _tidy(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a session that was stopped can't reach its files any more
        drop_stored(spark)


def rekeyed(column: str) -> Column:
    """An integer key written another way: a join on it exchanges both sides, even one that a grouping by the key has
    partitioned, and adaptive execution can then split a key that very many rows share."""
    return F.bitwise_not(F.col(column))


def crc_of_id(doc_id: str | Column) -> Column:
    """crc32 of the id as decimal text, by which documents are held out."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def text_column(name: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. np.unique hashes where it can, which is several times slower for 64-bit hashes."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals as sorted maximal runs; touching ones are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > ends[:-1]]
    return starts[fresh], ends[np.r_[fresh[1:], True]]


def block_count(df: DataFrame, text: str = "text", block_bytes: int = 8 << 20, least: int = 8) -> int:
    """Blocks of about ``block_bytes`` of text each: one pass over lengths alone."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-total // block_bytes))
