"""Name resolution over type hierarchies: supertypes, implementations, methods."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

c = F.col
LEVELS, IMPLEMENTATIONS = 8, 8


def closure(edges: DataFrame, down: bool = False, levels: int | None = LEVELS, types=("Extends", "Implements"), only: DataFrame | None = None) -> DataFrame:
    """(id, other, level): supertypes (or subtypes) of each type up to so many levels, each at its least level; ``only``: of these ids, and then with ``levels`` None of all levels."""
    a, b = ("target", "source") if down else ("source", "target")
    step = edges.where(c("edge_type").isin(*types)).select(c(a).alias("at"), c(b).alias("to")).distinct()
    if only is None:
        return _doubled(step, levels)
    first = step.join(only.select(c("id").alias("at")).distinct(), "at", "left_semi")
    seen = cut(first.where("at != to").select(c("at").alias("id"), c("to").alias("other"), F.lit(1).alias("level")))
    last = seen
    for level in count(2) if levels is None else range(2, levels + 1):
        new = last.join(step, last.other == step["at"]).select("id", c("to").alias("other")).distinct().where("id != other")
        last = cut(new.join(seen.select("id", "other"), ["id", "other"], "left_anti").withColumn("level", F.lit(level)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def _doubled(step: DataFrame, levels: int) -> DataFrame:
    """The closure of all types in rounds that double the levels; few rounds, as each is a written table."""
    seen, reach = cut(step.where("at != to").select(c("at").alias("id"), c("to").alias("other"), F.lit(1).alias("level"))), 1
    while reach < levels:
        more = seen.select("id", c("other").alias("at"), c("level").alias("first"))
        far = more.join(seen.select(c("id").alias("at"), "other", "level"), "at").select("id", "other", (c("first") + c("level")).alias("level")).where((c("id") != c("other")) & (c("level") <= levels))
        new = cut(seen.unionByName(far).groupBy("id", "other").agg(F.min("level").alias("level")))
        if new.where(c("level") > reach).isEmpty():
            break
        seen, reach = new, 2 * reach
    return seen


def nearest(below: DataFrame, cap: int = IMPLEMENTATIONS) -> DataFrame:
    """At most ``cap`` rows of each id of a closure, the nearest first."""
    w = Window.partitionBy("id").orderBy("level", "other")
    return below.withColumn("r", F.row_number().over(w)).where(c("r") <= cap).drop("r")


def implementors(edges: DataFrame, cap: int = IMPLEMENTATIONS, only: DataFrame | None = None) -> DataFrame:
    """(id, other, level): at most ``cap`` subtypes of each type (of those in ``only``), the nearest first."""
    return nearest(closure(edges, down=True, only=only), cap)


def method_resolve(calls: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """``methods`` by the supertypes that the edges give."""
    return methods(calls, members, closure(edges, only=calls.select(c("type").alias("id"))))


def methods(calls: DataFrame, members: DataFrame, above: DataFrame, whole: bool = False) -> DataFrame:
    """(call, method): the method of that name in the type, else in its nearest supertype; equal argument counts go first, then the least id.

    calls: (call, type, name, argc). members: (type, name, argc, method). above: (id, other, level), the closure of the calls' types.
    whole: ``above`` is of all types and ``LEVELS`` levels, and calls that find nothing in it go on from its last level, to the top.
    """
    found = _hits(calls, members, above)
    far = above.where(c("level") == LEVELS).select(c("id").alias("type"), c("other").alias("to"))
    if not whole or far.isEmpty():
        return found
    found, far = cut(found), cut(far)

    def on(left: DataFrame, hit: DataFrame) -> DataFrame:
        rest = left.join(hit.select("call"), "call", "left_anti").join(far, "type")
        return rest.select("call", c("to").alias("type"), "name", "argc").distinct()

    left = seen = cut(on(calls.join(members.select("name").distinct(), "name", "left_semi"), found))
    while not left.isEmpty():
        # all types of a call are equally far from its own, so that the nearest of what lies above them is the nearest of all
        new = cut(_hits(left, members, above))
        found = found.unionByName(new)
        left = cut(on(left, new).join(seen.select("call", "type"), ["call", "type"], "left_anti"))
        seen = seen.unionByName(left)
    return found


def _hits(calls: DataFrame, members: DataFrame, above: DataFrame) -> DataFrame:
    own = calls.select("call", c("type").alias("t"), "name", c("argc").alias("wanted"), F.lit(0).alias("level"))
    up = above.select(c("id").alias("type"), c("other").alias("t"), "level")
    wide = calls.join(up, "type").select("call", "t", "name", c("argc").alias("wanted"), "level").unionByName(own)
    hit = wide.join(members.select(c("type").alias("t"), "name", "argc", "method"), ["t", "name"])
    order = F.struct("level", (c("argc") != c("wanted")).alias("other"), "method")
    return hit.groupBy("call").agg(F.min(order).alias("best")).select("call", c("best.method").alias("method"))


def cascade(*strategies: DataFrame) -> DataFrame:
    """(call, target, strategy): the first strategy that resolves a call wins. Each strategy: (call, target)."""
    every = None
    for k, s in enumerate(strategies):
        part = s.select("call", "target").withColumn("strategy", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("call").agg(F.min(F.struct("strategy", "target")).alias("b")).select("call", c("b.target").alias("target"), c("b.strategy").alias("strategy"))


def resolution_stats(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(strategy, n): how many calls each strategy resolved; -1 for none."""
    return calls.select("call").join(resolved.select("call", "strategy"), "call", "left").groupBy(F.coalesce("strategy", F.lit(-1)).alias("strategy")).agg(F.count("*").alias("n"))
