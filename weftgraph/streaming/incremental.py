"""Incremental maintenance: what a new snapshot changes, upserts, pruning, and a change stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_WEIGHT, EDGE_WEIGHTS

c = F.col


class EmptyGraph(ValueError):
    """A prune with an empty incoming graph would delete everything."""


def plan(old: DataFrame, new: DataFrame, compared: list[str], same_model: bool = True, always_write: bool = False) -> DataFrame:
    """(id, action): unchanged, rewrite (vector kept), embed, or remove.

    old and new: (id, node_text, ...); old also has_vector. A vector is kept if the text is equal, the row has one and
    the model is the same; such a row is rewritten if any of ``compared`` differs (null equals null).
    """
    a = old.select("id", F.lit(True).alias("was"), c("node_text").alias("t0"), "has_vector", *(c(x).alias(f"{x}_0") for x in compared))
    b = new.select("id", F.lit(True).alias("now"), c("node_text").alias("t1"), *(c(x).alias(f"{x}_1") for x in compared))
    same = F.lit(True)
    for x in compared:
        same = same & c(f"{x}_0").eqNullSafe(c(f"{x}_1"))
    keep = c("t0").eqNullSafe(c("t1")) & F.coalesce("has_vector", F.lit(False)) & F.lit(same_model)
    action = F.when(c("now").isNull(), "remove").when(c("was").isNull() | ~keep, "embed").when(same & F.lit(not always_write), "unchanged").otherwise("rewrite")
    return a.join(b, "id", "full_outer").select("id", action.alias("action"))


def upsert_nodes(stored: DataFrame, rows: DataFrame, width: int | None = None, key=("node_type", "id")) -> DataFrame:
    """The stored rows with ``rows`` in place of those of the same key; vectors are empty or ``width`` wide."""
    if width is not None and "vector" in rows.columns:
        bad = rows.where((F.size("vector") > 0) & (F.size("vector") != width)).limit(1).count()
        if bad:
            raise ValueError(f"a vector is not {width} wide")
    return stored.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def upsert_edges(stored: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The stored edges and the new ones, each once, with weights by type; an unknown end is an error."""
    ids = nodes.select("id")
    lost = rows.select(c("source").alias("id")).unionByName(rows.select(c("target").alias("id"))).join(ids, "id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"edges name unknown nodes: {', '.join(str(r.id) for r in lost)}")
    every = stored.select("source", "target", "edge_type").unionByName(rows.select("source", "target", "edge_type")).distinct()
    weight = F.lit(DEFAULT_WEIGHT)
    for name, w in EDGE_WEIGHTS.items():
        weight = F.when(c("edge_type") == name, F.lit(w)).otherwise(weight)
    return every.withColumn("weight", weight).withColumn("id", F.concat_ws("|", "source", "edge_type", "target"))


def prune(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored rows that the incoming graph still has."""
    if incoming.isEmpty():
        raise EmptyGraph("the incoming graph is empty; nothing is pruned")
    return stored.join(incoming.select("id").distinct(), "id", "left_semi")


def reuse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, state): reuse where path and hash are known, parse otherwise, gone where only the cache has the path."""
    a = files.select("path", c("hash").alias("h1"))
    b = cache.select("path", c("hash").alias("h0"))
    state = F.when(c("h1").isNull(), "gone").when(c("h0").eqNullSafe(c("h1")), "reuse").otherwise("parse")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def staleness(recorded: DataFrame, present: DataFrame, built_at: int) -> DataFrame:
    """One row: recorded, changed (modified after the build) and missing files. recorded: (path); present: (path, modified)."""
    j = recorded.select("path").join(present.select("path", "modified"), "path", "left")
    return j.agg(F.count("*").alias("recorded"), F.sum((c("modified") > built_at).cast("long")).alias("changed"), F.sum(c("modified").isNull().cast("long")).alias("missing"))


def follow(spark, folder: str, schema, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a stream of change files; each micro-batch, the last change of each id first, goes to ``apply``."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("id").agg(F.max_by(F.struct(*df.columns), "version").alias("r")).select("r.*")
        apply(latest, number)

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): tumbling event-time counts; the watermark bounds the state of a stream."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(c("w.start").alias("start"), "event_type", "n")
