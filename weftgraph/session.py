"""Session defaults and materialisation that any cluster can recover."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark 4.1 gives wrong groups over a union of cached or bucketed columnar tables that are partitioned alike
    "spark.sql.unionOutputPartitioning": "false",
}

BROADCAST_ROWS, PART = 100_000, 16 << 20


def session(name: str = "weftgraph", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all machines share. Only a session on one machine may go without naming one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def measured_joins(spark: SparkSession):
    """While this holds, Spark sends a table to all tasks only if its shuffled size was measured as small, or if a hint says so.

    Estimates before the run take a column's width from its type, and can be wrong by any factor for texts and for what Python makes.
    """
    estimate, measure = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    former, own = spark.conf.get(estimate), spark.conf.get(measure, None)
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        yield
        return
    try:
        spark.conf.set(measure, own or former)
        spark.conf.set(estimate, "-1")
        yield
    finally:
        spark.conf.set(estimate, former)
        spark.conf.set(measure, own) if own else spark.conf.unset(measure)


def _bytes(size: str) -> int:
    """Spark's notation of sizes, as ``64MB``."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


@contextlib.contextmanager
def small_parts(spark: SparkSession):
    """While this holds, tasks get at most ``PART`` of shuffled and twice as much of read data, or less if the session says so.

    Sizes are of compressed data. Sorted edges and postings take ten times as much in memory, so that a task of the usual 64 or 128 MB spills.
    """
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": PART, "spark.sql.files.maxPartitionBytes": 2 * PART}
    former = {name: spark.conf.get(name) for name in names}
    try:
        for name, most in names.items():
            spark.conf.set(name, f"{min(_bytes(former[name]), most)}b")
        yield
    finally:
        for name, value in former.items():
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: iterative plans stay short and a lost executor costs one round.

    ``checkpoint`` would hand on the estimated size of the plan, which joins multiply: it has twice or three times as many digits
    after every round of a loop, or is so small that large tables are sent to all tasks. A written table has its own size.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_passing: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession):
    """What is cut while this holds is removed when it ends, and so are the shuffled files of what was computed for it: no table that is used later may come from it.

    Spark removes shuffled files once the driver's JVM has collected the plans that they belong to, which may not happen for as long as it has memory.
    """
    made: list[str] = []
    _passing.append(made)
    try:
        yield
    finally:
        _passing.remove(made)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        if made:
            gc.collect()
            jvm.System.gc()


def written(df: DataFrame, path: str) -> None:
    """``df`` as Parquet under ``path``, with joins by measured sizes and small parts."""
    with measured_joins(df.sparkSession), small_parts(df.sparkSession):
        df.write.parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """``df``, which was cut, to be sent to every task if it has at most ``BROADCAST_ROWS`` rows; it is counted for that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
