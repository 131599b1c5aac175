"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: White space of the word contracts: blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may go without naming one, as in tests."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table, by whatever file system its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, which was cut and has a few short columns, to be sent to every task if it has at most ``most`` rows; it is counted for that."""
    return F.broadcast(df) if df.count() <= most else df


def bounded(spark: SparkSession) -> None:
    """Let no Arrow batch hold more than ``BATCH_BYTES``, on either side, unless the session says otherwise: long texts would fill 64 MB a task."""
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "67108864"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns and clashing names never matter; a null text is empty."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """``texts`` with ``rk``, a hash of the text: (doc_id, rk) names a row's content even where ids repeat or are null."""
    return texts(docs).withColumn("rk", F.xxhash64("text"))


def remainder(modulus: int):
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def least_hashes(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of (doc_id, ...) with the least hashes of their distinct ids.

    A sort with a limit would send n rows of every partition to one task; a bound on the hash that leaves
    about 4n rows comes first.
    """
    h, total = F.xxhash64("doc_id"), ids.count()
    if total > 8 * n:
        ids = ids.where(F.pmod(h, F.lit(1 << 32)) < int((1 << 32) * 4 * n / total))
    return ids.orderBy(F.pmod(h, F.lit(1 << 32)), h, "doc_id").limit(n)
