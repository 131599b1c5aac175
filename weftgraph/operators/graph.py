"""Graph operators over ``edges`` (source, target, edge_type) and ``nodes`` (id, node_type, ...)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_WEIGHT, EDGE_WEIGHTS, USAGE_EDGES
from ..session import BROADCAST_ROWS, cut, sent
from .reach import bfs, steps

c = F.col
CELLS, TOGETHER = 1 << 22, 2000  # distances that a task of betweenness holds; edges of components that share one


# -- joins and filters ---------------------------------------------------------------------


def filter_edges_by_type(edges: DataFrame, types: Iterable[str]) -> DataFrame:
    """Edges of the types, in any letter case."""
    return edges.where(F.lower("edge_type").isin(*[t.lower() for t in types]))


def endpoint_join(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist, with the ends' types."""
    a = nodes.select(c("id").alias("source"), c("node_type").alias("source_type"))
    b = nodes.select(c("id").alias("target"), c("node_type").alias("target_type"))
    return edges.join(a, "source").join(b, "target")


def lookup_outer(ids: DataFrame, nodes: DataFrame, missing: str = "(unknown node)") -> DataFrame:
    """(id, name) for each id, with a stand-in where there is no such node."""
    return ids.join(nodes.select("id", "name"), "id", "left").select("id", F.coalesce("name", F.lit(missing)).alias("name"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    s = ids.select("id").distinct()
    return edges.join(s, edges.source == s.id, "left_semi").join(s, c("target") == s.id, "left_semi")


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids``, each once."""
    s = ids.select("id").distinct()
    return edges.join(s, edges.source == s.id, "left_semi").unionByName(edges.join(s, edges.target == s.id, "left_semi")).distinct()


def candidate_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``induced`` without self-loops, each once."""
    return induced(edges, ids).where("source != target").distinct()


# -- walks ---------------------------------------------------------------------------------


def k_hop(edges: DataFrame, start: str, k: int) -> DataFrame:
    """(id, distance) of the nodes within k outward steps."""
    return bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id string"), k)


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2, types=None, direction: str = "out") -> tuple[DataFrame, DataFrame]:
    """(id, distance) of what a walk of 1 to 5 hops finds, and the edges it went over."""
    hops = max(1, min(hops, 5))
    found = bfs(edges, seeds, hops, types, direction)
    near = sent(cut(found.where(c("distance") < hops).select("id")))
    e = edges if types is None else edges.where(c("edge_type").isin(*types))
    parts = []
    if direction in ("out", "both"):
        parts.append(e.join(near, c("source") == c("id"), "left_semi"))
    if direction in ("in", "both"):
        parts.append(e.join(near, c("target") == c("id"), "left_semi"))
    gone = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found, gone.distinct()


def walk_layers(edges: DataFrame, seed: str, hops: int, direction: str = "out", types=None, stop_after: int = 4000) -> DataFrame:
    """(hop, edge_type, n): edges by type out of each layer; no further layer follows one larger than ``stop_after``."""
    found = cut(bfs(edges, edges.sparkSession.createDataFrame([(seed,)], "id string"), hops, types, direction))
    size = {r.distance: r["count"] for r in found.groupBy("distance").count().collect()}  # one row a hop
    last = next((d for d in sorted(size) if size[d] > stop_after), hops)  # the layer after which it stops
    step, near = steps(edges, types, direction), found.where(c("distance") < min(hops, max(last, 1)))
    return near.join(step, near.id == step.src).groupBy((c("distance") + 1).alias("hop"), "edge_type").agg(F.count("*").alias("n"))


def find_usages(edges: DataFrame, targets: DataFrame, hops: int = 1) -> DataFrame:
    """(id, distance, via_edge, via_target): each user within 1 to 3 inbound hops once, by its least edge."""
    hops = max(1, min(hops, 3))
    e = edges.where(c("edge_type").isin(*USAGE_EDGES))
    found = cut(bfs(e, targets, hops, None, "in"))
    seen = sent(found.select(c("id").alias("target"), c("distance").alias("at")))
    users = e.join(seen, "target").join(sent(found.select(c("id").alias("source"), "distance")), "source").where("distance = at + 1")
    return users.groupBy(c("source").alias("id"), "distance").agg(F.min(F.struct("edge_type", "target")).alias("via")).select("id", "distance", c("via.edge_type").alias("via_edge"), c("via.target").alias("via_target"))


def call_sites(usages: DataFrame, code: DataFrame, names: DataFrame, per_user: int = 3, users: int = 20, width: int = 160) -> DataFrame:
    """(id, via_target, line, text): lines of the users' code that name what they use, at most ``per_user`` each for the first ``users`` by distance and id.

    usages: what ``find_usages`` gives; code: (id, code, start_line); names: (id, name).
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", "id"))
    first = usages.orderBy("distance", "id").limit(users).withColumn("place", place)
    j = first.join(names.select(c("id").alias("via_target"), F.regexp_extract("name", r"([^.:#]*)$", 1).alias("word")), "via_target").join(code, "id")
    lines = j.select("id", "via_target", "word", "start_line", F.posexplode(F.split("code", "\n")).alias("n", "raw")).where(F.contains("raw", "word") & (c("word") != ""))
    rank = F.row_number().over(Window.partitionBy("id", "via_target").orderBy("n"))
    return lines.withColumn("r", rank).where(c("r") <= per_user).select("id", "via_target", (F.coalesce("start_line", F.lit(1)) + c("n")).cast("long").alias("line"), F.substring(F.trim("raw"), 1, width).alias("text"))


def shortest_path(edges: DataFrame, source: str, target: str, strict: bool = False, limit: int | None = None) -> list[str] | None:
    """Node ids of a shortest directed path, the least predecessor at every step; the other way round if there is none, unless ``strict``. No ``limit``: of any length."""
    spark = edges.sparkSession
    if source == target:
        return [source]
    step = steps(edges).select("src", "dst")
    seen = cut(spark.createDataFrame([(source, None)], "id string, parent string"))
    frontier, hops = seen, 0
    while limit is None or hops < limit:
        new = sent(frontier.select("id")).join(step, c("id") == c("src")).groupBy(c("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = cut(new.join(sent(seen.select("id")), "id", "left_anti"))
        hops += 1
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
        if not new.where(c("id") == target).isEmpty():
            path = [target]
            while path[-1] != source:  # one look-up a hop
                path.append(seen.where(c("id") == path[-1]).first().parent)
            return path[::-1]
    if strict:
        return None
    back = shortest_path(edges.select(c("target").alias("source"), c("source").alias("target"), "edge_type"), source, target, True, limit)
    return back


def all_shortest_paths(edges: DataFrame, source: str, target: str, types=None) -> DataFrame:
    """(hop, source, target): the edges, each pair once, that lie on a shortest directed path; empty if there is none or it has no edge.

    The paths themselves may be exponentially many; their edges are at most as many as the graph's.
    """
    spark, step = edges.sparkSession, steps(edges, types).select("src", "dst")
    seen = cut(spark.createDataFrame([(source, 0)], "id string, distance int"))
    frontier, hops = seen, 0
    while source != target:
        hops += 1
        new = sent(frontier.select("id")).join(step, c("id") == c("src")).select(c("dst").alias("id")).distinct().join(sent(seen.select("id")), "id", "left_anti").withColumn("distance", F.lit(hops))
        new = cut(new)
        if new.isEmpty():
            return spark.createDataFrame([], "hop int, source string, target string")
        seen, frontier = seen.unionByName(new), new
        if not new.where(c("id") == target).isEmpty():
            break
    at, out = spark.createDataFrame([(target,)], "dst string"), spark.createDataFrame([], "hop int, source string, target string")
    for hop in range(hops, 0, -1):
        layer = seen.where(c("distance") == hop - 1).select(c("id").alias("src"))
        back = cut(step.join(at, "dst", "left_semi").join(layer, "src", "left_semi").distinct())
        out = out.unionByName(back.select(F.lit(hop).alias("hop"), c("src").alias("source"), c("dst").alias("target")))
        at = back.select(c("src").alias("dst")).distinct()
    return out


# -- measures ------------------------------------------------------------------------------


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): all edges, both ways, over n - 1."""
    ends = edges.select(c("source").alias("id")).unionByName(edges.select(c("target").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    n = nodes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    out = nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.join(F.broadcast(n)).select("id", "degree", (c("degree") / c("others")).alias("centrality"))  # n is one row


def top_hubs(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return degree_centrality(nodes, edges).orderBy(F.desc("degree"), "id").limit(n).select("id", "degree")


def _dependencies(first: np.ndarray, to: np.ndarray, sources: np.ndarray, n: int) -> np.ndarray:
    """Sums over the sources of each node's share of the shortest paths from them; level by level for all sources at once.

    first, to: the successors of node v are to[first[v]:first[v + 1]].
    """
    k = len(sources)
    sigma, dist = np.zeros(k * n), np.full(k * n, -1, np.int32)
    at = np.arange(k) * n + sources  # (source, node) as one number
    sigma[at], dist[at] = 1.0, 0
    levels, depth = [], 0
    while len(at):
        node = at % n
        many = first[node + 1] - first[node]
        begin = np.repeat(first[node] - np.append(0, np.cumsum(many)[:-1]), many)
        frm = np.repeat(at, many)
        into = frm - frm % n + to[begin + np.arange(len(begin))]
        depth += 1
        dist[into[dist[into] < 0]] = depth
        on = dist[into] == depth
        frm, into = frm[on], into[on]
        at, where = np.unique(into, return_inverse=True)
        sigma[at] = np.bincount(where, sigma[frm], len(at))
        levels.append((frm, into))
    delta = np.zeros(k * n)
    for frm, into in reversed(levels):
        up, where = np.unique(frm, return_inverse=True)
        delta[up] += np.bincount(where, sigma[frm] / sigma[into] * (1 + delta[into]), len(up))
    delta[np.arange(k) * n + sources] = 0
    return delta.reshape(k, n).sum(0)


def _tree_dependencies(sources: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """``_dependencies`` of all sources, summed, over edges (sources, to) between the numbers below n, where of the nodes with a way out each has one of them
    at most to go on to, and none comes back to itself: trees towards their roots, and ends that hang on any of their nodes.

    A node lies within the paths from those below it to all above it, and to each end that it or a node above it holds, but
    for those that meet a holder of this end before it. Such a path from below adds along the way from a holder to the next one.
    """
    inner = np.zeros(n, bool)
    inner[sources] = True
    up = np.full(n, -1)
    on = inner[to]
    up[sources[on]] = to[on]
    held, below = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in zip(sources[~on].tolist(), to[~on].tolist()):
        held[a].append(b)
    for a, b in zip(sources[on].tolist(), to[on].tolist()):
        below[b].append(a)
    order, above, ends = [], [0] * n, [0] * n
    last: dict[int, list[int]] = {}  # of each end the holders on the way from the root, the nearest last
    met = []  # (holder, the next holder of the same end above it)
    todo = np.flatnonzero(inner & (up < 0)).tolist()
    up = up.tolist()
    while todo:
        v = todo.pop()
        if v < 0:  # all below it is done
            for e in held[~v]:
                last[e].pop()
            continue
        order.append(v)
        p, new = up[v], 0
        for e in held[v]:
            before = last.setdefault(e, [])
            if before:
                met.append((v, before[-1]))
            else:
                new += 1
            before.append(v)
        above[v], ends[v] = (above[p] + 1, ends[p] + new) if p >= 0 else (0, new)
        todo.append(~v)
        todo += below[v]
    many = [0] * n
    for v in reversed(order):
        if up[v] >= 0:
            many[up[v]] += many[v] + 1
    less = [0] * n
    for v, nearest in met:
        less[up[v]] += many[v] + 1
        if up[nearest] >= 0:
            less[up[nearest]] -= many[v] + 1
    for v in reversed(order):
        if up[v] >= 0:
            less[up[v]] += less[v]
    return np.array([m * (a + e) - x for m, a, e, x in zip(many, above, ends, less)], float)


def _settled_dependencies(group: pd.DataFrame) -> pd.DataFrame:
    """(id, part): what the sources of the group's block add to each node; the group has all edges (src, dst) that they can reach."""
    names, code = np.unique(np.concatenate([group["src"].to_numpy(str), group["dst"].to_numpy(str)]), return_inverse=True)
    a, b = code[: len(group)], code[len(group) :]
    order, n = np.argsort(a, kind="stable"), len(names)
    first, to = np.searchsorted(a[order], np.arange(n + 1)), b[order].astype(np.int64)
    sources = np.unique(a)
    if group["part"].iloc[0].startswith("tree "):
        total = _tree_dependencies(a, b.astype(np.int64), n)
    else:
        mine = np.array_split(sources, group["blocks"].iloc[0])[group["block"].iloc[0]]
        total, step = np.zeros(n), max(1, CELLS // n)
        for lo in range(0, len(mine), step):
            total += _dependencies(first, to, mine[lo : lo + step], n)
    some = np.flatnonzero(total)
    return pd.DataFrame({"id": names[some].astype(object), "part": total[some]})


def betweenness(nodes: DataFrame, edges: DataFrame, types=None, most_nodes: int | None = None, most_edges: int | None = None) -> DataFrame:
    """(id, betweenness): exact shortest-path betweenness, directed, over (n - 1)(n - 2).

    Nodes without a way out lie within no path and are ends only. Without them the graph falls into weak components, each of which has all
    that its nodes can reach, together with those ends. A component that is a tree is counted in one pass. Of another one the sources are dealt in blocks over
    the tasks, as many as its share of the work, as each gets a copy of the edges; a task holds these and ``CELLS`` distances. Small components
    share a task. The work is nodes times edges of a component. ``most_nodes`` and ``most_edges`` (pairs of neighbours) are limits that the caller may set.
    """
    n = nodes.count()
    if most_nodes is not None and n > most_nodes:
        raise ValueError(f"betweenness of {n} nodes; the limit is {most_nodes}")
    pairs = steps(edges, types).select("src", "dst").distinct()
    for end in ("src", "dst"):
        pairs = pairs.join(nodes.select(c("id").alias(end)), end, "left_semi")
    pairs = cut(pairs.select("src", "dst"))
    m = pairs.count()
    if most_edges is not None and m > most_edges:
        raise ValueError(f"betweenness over {m} pairs of neighbours; the limit is {most_edges}")
    pairs = pairs.where("src != dst")
    inner = cut(pairs.select("src").distinct())
    on = pairs.join(inner.select(c("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    weak = weak_components(cut(on))
    weak = inner.join(weak.withColumnRenamed("id", "src"), "src", "left").select("src", F.coalesce("weak", "src").alias("weak"))
    apart = cut(pairs.join(weak, "src").join(inner.select(c("src").alias("dst"), F.lit(1).alias("on")), "dst", "left").select("weak", "src", "dst", "on"))
    # as many ways on as nodes but one, and never two out of a node: a tree
    kinds = apart.groupBy("weak", "src").agg(F.count("*").alias("n"), F.count("on").alias("on")).groupBy("weak").agg(F.sum("n").alias("n"), (F.max("on") < 2).alias("tree"), F.sum((c("on") == 0).cast("int")).alias("roots"))
    kinds = kinds.select("weak", (c("n") > TOGETHER).alias("large"), (c("tree") & (c("roots") == 1)).alias("tree"))
    # components of few edges are taken together
    key = F.concat(F.when(c("tree"), "tree ").otherwise("net "), F.when(c("large"), F.concat(F.lit("one "), "weak")).otherwise(F.concat(F.lit("some "), F.pmod(F.xxhash64("weak"), F.lit(m // TOGETHER + 1)))))
    apart = cut(apart.join(kinds, "weak").select(key.alias("part"), "src", "dst"))
    size = cut(apart.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources")).withColumn("work", c("sources") * (c("n") + c("sources"))))
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism  # said outright: small as the blocks are, they take long, and would be put into one task
    work = size.where("part not like 'tree %'").agg(F.sum("work")).first()[0] or 1
    blocks = F.when(c("part").startswith("tree "), 1).otherwise(F.least(F.ceil(c("work") / CELLS), c("sources"), F.ceil(c("work") * F.lit(float(tasks)) / F.lit(float(work)))))
    size = size.select("part", blocks.cast("int").alias("blocks")).select("part", "blocks", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("block"))
    parts = apart.join(size, "part").repartition(max(tasks, m // 100_000), "part", "block").groupBy("part", "block").applyInPandas(_settled_dependencies, "id string, part double")
    sums = parts.groupBy("id").agg(F.sum("part").alias("part"))
    scale = float(max((n - 1) * (n - 2), 1))
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) / scale).alias("betweenness"))


def centrality_report(nodes: DataFrame, edges: DataFrame, score: str = "degree", top: int = 20, node_type: str | None = None, prefix: str | None = None) -> DataFrame:
    """(id, name, node_type, file, degree, centrality, betweenness), the ``top`` by one of the scores, of one type or below one folder. Betweenness only where it is the score."""
    scores = degree_centrality(nodes, edges)
    scores = scores.join(betweenness(nodes, edges), "id") if score == "betweenness" else scores.withColumn("betweenness", F.lit(None).cast("double"))
    out = scores.join(nodes.select("id", "name", "node_type", "file"), "id")
    if node_type:
        out = out.where(F.lower("node_type") == node_type.lower())
    if prefix:
        out = out.where(c("file").startswith(prefix))
    return out.select("id", "name", "node_type", "file", "degree", "centrality", "betweenness").orderBy(F.desc(score), "id").limit(top)


def _raked(left: DataFrame) -> DataFrame:
    """Without the edges out of nodes that nothing leads to and into nodes without a way out."""
    a, b = left.select(c("dst").alias("src")).distinct(), left.select(c("src").alias("dst")).distinct()
    return cut(left.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"))


def _chains(left: DataFrame) -> DataFrame | None:
    """(id, before, after, low, ring), if there are any, of the nodes with one edge in and one out: the nodes where their chain begins and ends, which have
    more edges or fewer; or, where ``ring`` is set, the least id of the ring that such nodes form alone. Pointers are doubled in every
    round, so that a chain of n nodes takes about log2(n) of them. No two pointers meet at a chain's node, and those that have
    come to an end are joined with their own row: no join has a hot key.
    """
    ends = left.select(c("src").alias("id"), c("dst").alias("after"), F.lit(None).cast("string").alias("before")).unionByName(left.select(c("dst").alias("id"), F.lit(None).cast("string").alias("after"), c("src").alias("before")))
    deg = ends.groupBy("id").agg(F.count("after").alias("o"), F.count("before").alias("i"), F.min("before").alias("before"), F.min("after").alias("after"))
    chain = cut(deg.where("o = 1 and i = 1").select("id", "before", "after"))
    n = chain.count()
    if not n:
        return None
    inner = chain.select(c("id").alias("k"))
    at = chain.join(inner.withColumn("more", F.lit(True)), c("after") == c("k"), "left").drop("k")
    at = at.join(inner.withColumn("less", F.lit(True)), c("before") == c("k"), "left").drop("k")
    at = cut(at.select("id", "before", "after", F.least("id", F.when(c("more"), c("after"))).alias("low"), F.coalesce("more", F.lit(False)).alias("more"), F.coalesce("less", F.lit(False)).alias("less")))
    covered, open_, before = 1, at.where("more or less").count(), -1
    # the open nodes of a chain get fewer in every round, those of a ring stay; a ring whose least ids all stood still for a round has its least id everywhere
    while covered < n and open_ and before != open_:
        to = at.select(c("id").alias("k"), c("after").alias("a"), c("more").alias("m"), c("low").alias("l"))
        back = at.select(c("id").alias("k"), c("before").alias("b"), c("less").alias("s"))
        on = at.join(to, F.when(c("more"), c("after")).otherwise(c("id")) == c("k")).drop("k")
        on = on.join(back, F.when(c("less"), c("before")).otherwise(c("id")) == c("k")).drop("k")
        at = cut(on.select("id", c("b").alias("before"), c("a").alias("after"), F.least("low", "l").alias("low"), c("m").alias("more"), c("s").alias("less"), (c("l") < c("low")).alias("moved")))
        now = at.where("more or less").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).first()
        covered, open_, before = covered * 2, now.n, -1 if now.moved else open_
    # a chain has come to its ends by now; only a ring has none
    return at.select("id", "before", "after", "low", c("more").alias("ring"))


def _contracted(left: DataFrame, small: int) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of (src, dst), without self-loops, when nodes that lie on no cycle are taken off and chains become single edges, in
    turns until nothing changes or at most ``small`` pairs are left; and what ``_chains`` gave in every turn. Trees and chains take logarithmically many turns.
    """
    n, chains = left.count(), []
    while n > small:
        left = _raked(left)
        found = _chains(left)
        if found is not None:
            chains.append(found)
            inner = found.select("id")
            rest = left.join(inner.select(c("id").alias("src")), "src", "left_anti").join(inner.select(c("id").alias("dst")), "dst", "left_anti").select("src", "dst")
            left = cut(rest.unionByName(found.where("not ring and before != after").select(c("before").alias("src"), c("after").alias("dst"))).distinct())
        m = left.count()
        if m == n:
            break
        n = m
    return left, chains


def _settled(batches):
    """(id, component) of all pairs (src, dst) that the task gets: searched forward, then backward in the order of the ends."""
    to, back = defaultdict(list), defaultdict(list)
    for batch in batches:
        for a, b in zip(batch["src"], batch["dst"]):
            to[a].append(b)
            back[b].append(a)
    seen, order = set(), []
    for start in list(to):
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(to[start]))]
        while path:
            node, further = path[-1]
            new = next((x for x in further if x not in seen), None)
            if new is None:
                order.append(node)
                path.pop()
            else:
                seen.add(new)
                path.append((new, iter(to.get(new, ()))))
    of = {}
    for start in reversed(order):
        todo = [] if start in of else [start]
        while todo:
            node = todo.pop()
            if node not in of:
                of[node] = start
                todo += [x for x in back.get(node, ()) if x not in of]
    yield pd.DataFrame({"id": list(of), "component": list(of.values())}, dtype=object)


def _settled_apart(batches):
    """``_settled`` of (weak, src, dst) in the order of ``weak``: as soon as a weak component is whole, so that a task holds few at a time."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        if held and held[-1]["weak"].iloc[-1] != batch["weak"].iloc[0]:
            yield from _settled(held)
            held = []
        whole = batch["weak"] != batch["weak"].iloc[-1]
        if whole.any():
            yield from _settled([*held, batch[whole]])
            held = []
        held.append(batch[~whole])
    yield from _settled(held)


def weak_components(pairs: DataFrame) -> DataFrame:
    """(id, weak): the nodes of (src, dst) with the least id of their weakly connected component.

    In turns the larger neighbours of a node, and then its smaller ones and itself, are hung on the least of them, until all hang
    on the least of all; the turns grow with the logarithm of the distances.
    """
    up = cut(pairs.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    now, before = state(up), None
    while now != before:
        near = up.unionByName(up.select(c("v").alias("u"), c("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = cut(near.where("v > u").join(least, "u").select(c("v").alias("u"), c("m").alias("v")).distinct())
        least = up.groupBy("u").agg(F.min("v").alias("v"))
        hung = up.join(least.select("u", c("v").alias("m")), "u").where("v != m").select(c("v").alias("u"), c("m").alias("v"))
        up = cut(hung.unionByName(least).distinct())
        now, before = state(up), now
    every = pairs.select(c("src").alias("id")).unionByName(pairs.select(c("dst").alias("id"))).distinct()
    return cut(every.join(up.select(c("u").alias("id"), c("v").alias("weak")), "id", "left").select("id", F.coalesce("weak", "id").alias("weak")))


def has_cycles(edges: DataFrame, types=None) -> bool:
    """Whether there is a cycle; a self-loop is one."""
    return not strong_components(edges, types).isEmpty()


def strong_components(edges: DataFrame, types=None, small: int = BROADCAST_ROWS) -> DataFrame:
    """(id, component): the strongly connected components with more than one node or a self-loop, named by their least id.

    Nodes off all cycles are taken off and chains contracted, however long, in logarithmically many rounds. In what is left each node
    gets the least id that reaches it and the least id that it reaches. Where both are the same, they name its component,
    which is settled; edges between nodes that differ in one of them lie on no cycle. The rest is contracted again. The rounds in which
    ids spread grow with the distances in the contracted graph only. As soon as at most ``small`` pairs are left, one task settles
    them. Edges with a null end are ignored.
    """
    pairs = cut(steps(edges, types).select("src", "dst").where("src is not null and dst is not null").distinct())
    left, turns, settled = cut(pairs.where("src != dst")), [], pairs.where("src = dst").select(c("src").alias("id"), c("src").alias("component"))

    def spread(over: DataFrame, a: str, b: str) -> DataFrame:
        """(id, low): the least id that reaches each node over the pairs a -> b."""
        low = cut(over.select(c("src").alias("id")).unionByName(over.select(c("dst").alias("id"))).distinct().withColumn("low", c("id")))
        moved = low
        while not moved.isEmpty():
            seen = sent(moved.select(c("id").alias(a), c("low").alias("seen")))  # only what changed goes on
            best = over.join(seen, a).groupBy(c(b).alias("id")).agg(F.min("seen").alias("seen"))
            new = cut(low.join(best, "id", "left").select("id", F.least("low", "seen").alias("low"), F.coalesce(c("seen") < c("low"), F.lit(False)).alias("changed")))
            low, moved = new.select("id", "low"), new.where("changed")
        return low

    while True:
        left, chains = _contracted(left, small)
        turns += chains
        if left.count() <= small:
            settled = settled.unionByName(left.repartition(1).mapInPandas(_settled, "id string, component string"))
            break
        weak = left.join(weak_components(left).withColumnRenamed("id", "src"), "src").select("weak", "src", "dst")
        weak = cut(weak.join(weak.groupBy("weak").agg(F.count("*").alias("n")), "weak"))
        apart = weak.where(c("n") <= small).select("weak", "src", "dst").repartition(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism), "weak").sortWithinPartitions("weak")
        settled = cut(settled.unionByName(apart.mapInPandas(_settled_apart, "id string, component string")))
        left = cut(weak.where(c("n") > small).select("src", "dst"))
        if left.isEmpty():
            break
        both = cut(spread(left, "src", "dst").withColumnRenamed("low", "f").join(spread(left, "dst", "src").withColumnRenamed("low", "b"), "id"))
        settled = settled.unionByName(both.where("f = b").select("id", c("f").alias("component")))
        rest = both.where("f != b")
        here, there = (rest.select(c("id").alias(x), c("f").alias(f"f_{x}"), c("b").alias(f"b_{x}")) for x in ("src", "dst"))
        left = cut(left.join(here, "src").join(there, "dst").where("f_src = f_dst and b_src = b_dst").select("src", "dst"))

    for found in reversed(turns):  # a chain lies on a cycle exactly if its ends lie in one component, or are one node
        one, other = (settled.where("id != component").select(c("id").alias(x), c("component").alias(f"of_{x}")) for x in ("before", "after"))
        ends = found.where("not ring").join(one, "before", "left").join(other, "after", "left")
        mine = ends.select("id", F.coalesce("of_before", "before").alias("component"), F.coalesce("of_after", "after").alias("x")).where("component = x").drop("x")
        settled = cut(settled.unionByName(mine).unionByName(found.where("ring").select("id", c("low").alias("component"))))
    # a name's own row may be missing
    settled = settled if turns else cut(settled)
    label = cut(settled.where("id != component").unionByName(settled.select(c("component").alias("id"), "component")).distinct())
    label = label.join(label.where("id != component").select("id", F.lit(1).alias("inner")), "id", "left").where("inner is null or id != component").drop("inner")
    names = sent(cut(label.groupBy("component").agg(F.min("id").alias("name"), F.count("*").alias("n"))))
    loops = pairs.where("src = dst").select(c("src").alias("id"), F.lit(1).alias("loop"))
    return label.join(names, "component").join(loops, "id", "left").where("n > 1 or loop = 1").select("id", c("name").alias("component"))


def cycles(edges: DataFrame, types=None, small: int = BROADCAST_ROWS) -> DataFrame:
    """(component, id, length): the nodes of each strongly connected component with a cycle, one a row, and how many they are."""
    found = strong_components(edges, types, small)
    return found.join(found.groupBy("component").agg(F.count("*").alias("length")), "component").select("component", "id", "length")


def cycles_report(nodes: DataFrame, edges: DataFrame, types=None, min_length: int = 1, max_length: int | None = None, prefix: str | None = None) -> DataFrame:
    """(component, length, id, file) of the cyclic components of so many nodes, the longest first; ``prefix``: those with a node below that folder."""
    found = cycles(edges, types).where(c("length") >= min_length).join(nodes.select("id", "file"), "id", "left")
    if max_length is not None:
        found = found.where(c("length") <= max_length)
    if prefix:
        found = found.join(found.where(c("file").startswith(prefix)).select("component").distinct(), "component", "left_semi")
    return found.select("component", "length", "id", "file").orderBy(F.desc("length"), "component", "id")


def _edge_weight():
    weight = F.lit(DEFAULT_WEIGHT)
    for name, w in EDGE_WEIGHTS.items():
        weight = F.when(c("edge_type") == name, F.lit(w)).otherwise(weight)
    return weight


def personalized_pagerank(edges: DataFrame, seeds: list[str], direction: str = "out", types=None, restart: float = 0.15, iterations: int = 30, max_results: int | None = None, epsilon: float = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """(id, score): power iteration from uniform seeds; edges weigh by type, mass without a way out returns to the seeds.

    It stops once the scores have changed by less than ``epsilon`` in sum. Seeds that are not among ``nodes`` (without it:
    not an end of an edge) are left out; without any seed the result is empty.
    """
    damping = 1 - min(max(restart, 0.01), 0.99)
    spark = edges.sparkSession
    known = nodes.select("id") if nodes is not None else edges.select(c("source").alias("id")).unionByName(edges.select(c("target").alias("id")))
    names = sorted(r.id for r in known.where(c("id").isin(*set(seeds))).distinct().collect())  # the caller's seeds
    if not names:
        return spark.createDataFrame([], "id string, score double")
    step = steps(edges, types, direction).withColumn("w", _edge_weight()).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    step = cut(step)
    total = step.groupBy("src").agg(F.sum("w").alias("t"))
    step = cut(step.join(total, "src").select("src", "dst", (c("w") / c("t") * damping).alias("w")))
    rank = spark.createDataFrame([(s, 1.0 / len(names)) for s in names], "id string, score double")
    for _ in range(iterations):
        moved = rank.join(step, rank.id == step.src).select(c("dst").alias("id"), (c("score") * c("w")).alias("new"))
        old = rank.select("id", F.lit(0.0).alias("new"), c("score").alias("old"))
        both = cut(moved.withColumn("old", F.lit(0.0)).unionByName(old).groupBy("id").agg(F.sum("new").alias("new"), F.sum("old").alias("old")))
        # all that did not move: the restarts, and what stood at nodes without a way out
        back = F.when(c("id").isin(*names), (1 - both.agg(F.sum("new")).first()[0]) / len(names)).otherwise(0.0)
        rank = both.select("id", (c("new") + back).alias("score"), "old").where("score > 0")
        change = rank.agg(F.sum(F.abs(c("score") - c("old")))).first()[0]
        rank = rank.select("id", "score")
        if change < epsilon:
            break
    out = rank.orderBy(F.desc("score"), "id")
    return out.limit(max_results) if max_results else out


# -- reports -------------------------------------------------------------------------------


def type_counts(nodes: DataFrame, top: int | None = None) -> DataFrame:
    out = nodes.groupBy("node_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_type")
    return out.limit(top) if top else out


def edge_shapes(nodes: DataFrame, edges: DataFrame, top: int = 4) -> DataFrame:
    """The most frequent (source type, target type) of each edge type; ends without a node are "?"."""
    a = nodes.select(c("id").alias("source"), c("node_type").alias("source_type"))
    b = nodes.select(c("id").alias("target"), c("node_type").alias("target_type"))
    shape = edges.join(a, "source", "left").join(b, "target", "left").groupBy("edge_type", F.coalesce("source_type", F.lit("?")).alias("source_type"), F.coalesce("target_type", F.lit("?")).alias("target_type")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc("n"), "source_type", "target_type"))
    return shape.withColumn("r", rank).where(c("r") <= top).drop("r")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): node and edge counts by type."""
    a = nodes.groupBy(c("node_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    b = edges.groupBy(c("edge_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return a.unionByName(b)


def project_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, n, rank): totals, largest types, fullest files, most used symbols and longest symbols."""

    def ranked(section: str, df: DataFrame, top: int) -> DataFrame:
        w = Window.orderBy(F.desc("n"), "name")
        return df.orderBy(F.desc("n"), "name").limit(top).select(F.lit(section).alias("section"), "name", c("n").cast("long").alias("n"), F.row_number().over(w).alias("rank"))

    code = nodes.where(~c("node_type").isin("File", "Folder"))
    totals = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("name"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("name"), "n"))
    parts = [
        ranked("totals", totals, 2),
        ranked("types", nodes.groupBy(c("node_type").alias("name")).agg(F.count("*").alias("n")), 10),
        ranked("files", code.where("file != ''").groupBy(c("file").alias("name")).agg(F.count("*").alias("n")), 10),
        ranked("hotspots", code.select(c("id").alias("name"), c("in_degree").alias("n")), 12),
        ranked("longest", code.where("loc is not null").select(c("id").alias("name"), c("loc").alias("n")), 10),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_tree(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, parent, distance): the tree of Contains edges below the nodes that nothing contains."""
    contains = edges.where("edge_type = 'Contains'")
    inside = contains.groupBy(c("target").alias("id")).agg(F.min("source").alias("parent"))
    roots = nodes.join(inside, "id", "left_anti").where(c("node_type").isin("Folder", "File")).select("id")
    level = bfs(contains, roots, depth or 1 << 30, None, "out")
    return level.join(inside, "id", "left").select("id", "parent", "distance")


def slim_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node for viewers: a code for its type, its file (Parquet's dictionary codes it) and its degree (a self-loop counts once)."""
    types = nodes.select("node_type").distinct().withColumn("type_code", F.row_number().over(Window.orderBy("node_type")) - 1)  # a dozen rows
    ends = edges.select(c("source").alias("id")).unionByName(edges.where("source != target").select(c("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id", "name", "node_type", "file", "start_line").join(F.broadcast(types), "node_type").join(ends, "id", "left").select("id", "name", "type_code", "file", "start_line", F.coalesce("degree", F.lit(0)).alias("degree"))
