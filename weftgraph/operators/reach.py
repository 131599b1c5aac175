"""Reachability: walks that start at a set of nodes and never list paths.

A hop dedupes before it joins on, so its rows are bounded by the nodes, however
many paths there are; path counts are propagated as numbers. Walks are cut at
every hop: a frontier whose counted size is small is sent to the edges, so that
these aren't shuffled, a larger one is joined with a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, sent

FRONTIER = 65_536


class FrontierTooLarge(ValueError):
    """A walk's frontier went over the limit that its caller set."""


def steps(edges: DataFrame, types: Iterable[str] | None = None, direction: str = "out") -> DataFrame:
    """(src, dst, edge_type) in walking direction; "both" has each edge twice."""
    e = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    out = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "edge_type")
    back = e.select(F.col("target").alias("src"), F.col("source").alias("dst"), "edge_type")
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction {direction!r}: out, in or both")
    return {"out": out, "in": back}.get(direction) or out.unionByName(back) if direction != "out" else out


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, types=None, direction: str = "out", frontier_limit: int | None = None) -> DataFrame:
    """(id, distance): every node within ``hops``, the seeds at 0."""
    step = steps(edges, types, direction).select("src", "dst")
    seen = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen.select("id")
    for hop in range(1, hops + 1):
        new = sent(frontier).join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(sent(seen.select("id")), "id", "left_anti")
        new = cut(new.withColumn("distance", F.lit(hop)))
        n = new.count()
        if frontier_limit and n > frontier_limit:
            raise FrontierTooLarge(f"{n} nodes at hop {hop}; the limit is {frontier_limit}")
        if not n:
            break
        seen, frontier = seen.unionByName(new), new.select("id")
    return seen


def distinct_reach(edges: DataFrame, anchors: DataFrame, hops: int, types=None, direction: str = "out") -> DataFrame:
    """(id): nodes at the other end of a path of 1 to ``hops`` edges, each once; no edge twice on a path.

    Starts from the anchored end, whichever way the pattern was written. An anchor is in the result only if a
    path leads back to it. The shortest walk to a node, or back to where it began, repeats no edge, so that a
    hop needs only the distinct nodes of the one before.
    """
    step = steps(edges, types, direction).select("src", "dst")
    at = cut(anchors.select("id").distinct())
    first = cut(sent(at).join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct())
    return bfs(edges, first, hops - 1, types, direction).select("id")


def path_counts(edges: DataFrame, anchors: DataFrame, hops: int, types=None, direction: str = "out") -> DataFrame:
    """(id, paths): how many paths of 1 to ``hops`` edges, no edge twice, lead from the anchors to each node."""
    step = steps(edges, types, direction).select("src", "dst", "edge_type")
    return _walk(step, anchors, hops).groupBy("id").agg(F.sum("paths").alias("paths"))


def _walk(step: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(id, paths) by hop, up to three, without paths that use an edge twice.

    Two edges in a row are the same only at a self-loop; the first and the third are the same only as
    x -> y -> x -> y over one edge. Both are counted apart and taken off.
    """
    if not 1 <= hops <= 3:
        raise ValueError("paths have 1 to 3 edges; use bfs for longer walks")
    start = cut(anchors.select("id").distinct().withColumn("paths", F.lit(1).cast("long")))

    def on(at: DataFrame) -> DataFrame:
        return sent(at).join(step, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))

    def minus(a: DataFrame, *bs: DataFrame) -> DataFrame:
        out = a
        for b in bs:
            out = out.unionByName(b.select("id", (-F.col("paths")).alias("paths")))
        return cut(out.groupBy("id").agg(F.sum("paths").alias("paths")).where("paths > 0"))

    one = cut(on(start))
    out = one
    if hops >= 2:
        loops = step.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("loops"))
        # e1 = e2: a self-loop at the anchor, walked twice
        twice = start.join(loops, "id").select("id", F.col("loops").alias("paths"))
        two = minus(on(one), twice)
        out = out.unionByName(two)
    if hops >= 3:
        # after two different edges, the third may be the second (a self-loop) or the first
        second_loop = one_to_loop(start, step, loops)
        first_again = back_and_forth(start, step, loops)
        out = out.unionByName(minus(on(two), second_loop, first_again))
    return out


def one_to_loop(start: DataFrame, step: DataFrame, loops: DataFrame) -> DataFrame:
    """Paths e1, e2, e2 with a self-loop e2 other than e1."""
    one = sent(start).join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("src") == F.col("dst")).cast("long").alias("own"), "paths")
    return one.join(loops, "id").groupBy("id").agg(F.sum(F.col("paths") * (F.col("loops") - F.col("own"))).alias("paths"))


def back_and_forth(start: DataFrame, step: DataFrame, loops: DataFrame) -> DataFrame:
    """Paths e1, e2, e1 with e2 other than e1: x -> y -> x -> y, or two self-loops of one node."""
    forth = sent(start).join(step, F.col("id") == F.col("src")).select(F.col("src").alias("x"), F.col("dst").alias("y"), "paths")
    near = step.join(sent(start.select(F.col("id").alias("dst"))), "dst", "left_semi")  # only edges back to an anchor
    back = near.groupBy(F.col("src").alias("y"), F.col("dst").alias("x")).agg(F.count("*").alias("ways"))
    return forth.join(back, ["x", "y"]).groupBy(F.col("y").alias("id")).agg(F.sum(F.col("paths") * (F.col("ways") - (F.col("x") == F.col("y")).cast("long"))).alias("paths"))
