"""Look-up tools over the graph: symbols, outlines, code and context within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import is_glob, matches, path_filter
from ..functions.text import literal_rank
from ..schema import IMPACT_EDGES
from ..session import cut
from .reach import bfs

c = F.col
REF_CAP, CODE_CHARS, CONTEXT_CHARS = 25, 20_000, 12_000
#: fixed values: roles of a context in order, and how many of each at most
ROLES = (("target", 1), ("caller", 12), ("test", 8), ("dependency", 15), ("doc", 5))


class Ambiguous(ValueError):
    """A reference that must name one node names several, or none."""


def match_ref(nodes: DataFrame, ref: str) -> DataFrame:
    """Nodes that a reference means: an id, a name in any letter case, a glob over names, or a path (with a slash)."""
    hit = (c("id") == ref) | (F.lower("name") == ref.lower())
    if is_glob(ref):
        hit = hit | matches(c("name"), ref)
    if "/" in ref:
        hit = hit | F.coalesce(path_filter(c("file"), ref), F.lit(False))
    return nodes.where(hit)


def expand_refs(nodes: DataFrame, refs: list[str], cap: int = REF_CAP) -> DataFrame:
    """Ids of all references, at most ``cap`` each by name and id, each once with the first reference that named it."""
    out = None
    for k, ref in enumerate(refs):
        part = match_ref(nodes, ref).orderBy("name", "id").limit(cap).select("id", F.lit(k).alias("ref"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.min("ref").alias("ref"))


def resolve_one(nodes: DataFrame, ref: str) -> str:
    """The one node of the best tier: id, then file path, then unique path end, then name."""
    tiers = (c("id") == ref, (c("node_type") == "File") & (c("file") == ref), (c("node_type") == "File") & c("file").endswith("/" + ref), F.lower("name") == ref.lower())
    for tier in tiers:
        got = [r.id for r in nodes.where(tier).select("id").orderBy("id").limit(5).collect()]
        if len(got) == 1:
            return got[0]
        if got:
            raise Ambiguous(f"{ref} could be {', '.join(got)}")
    raise Ambiguous(f"nothing is named {ref}")


def find_symbols(nodes: DataFrame, query: str, types: list[str] | None = None, path: str | None = None, boundary: bool | None = None, limit: int = 20) -> DataFrame:
    """(id, name, node_type, file, rank, total): a glob over names, or text in name and description, best first."""
    df = nodes.where(~c("node_type").isin("File", "Folder"))
    if types:
        hit = F.lit(False)
        for t in types:
            hit = hit | matches(c("node_type"), t)
        df = df.where(hit)
    if path:
        df = df.where(path_filter(c("file"), path))
    if boundary is not None:
        df = df.where(c("boundary") == int(boundary))
    if is_glob(query):
        df, order = df.where(matches(c("name"), query)).withColumn("rank", F.lit(0)), ("rank", "name", "file", "id")
    else:
        df = df.withColumn("rank", literal_rank("name", "description", query)).where("rank < 4").withColumn("width", F.length("name"))
        order = ("rank", "width", "name", "id")
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return df.orderBy(*order).limit(limit).join(total).select("id", "name", "node_type", "file", "rank", "total")


def file_outline(nodes: DataFrame, path: str, most_files: int = 20) -> DataFrame:
    """(file, start_line, id, node_type, name) of the symbols of a file, of the files that end so, or of those a glob fits."""
    code = nodes.where(~c("node_type").isin("File", "Folder") & c("file").isNotNull())
    if is_glob(path):
        files = code.where(matches(c("file"), path, path=True)).select("file").distinct().orderBy("file").limit(most_files)
    else:
        exact = code.where(c("file") == path).select("file").distinct()
        files = exact if not exact.isEmpty() else code.where(c("file").endswith("/" + path)).select("file").distinct()
        if files.count() > 1:
            raise Ambiguous(f"{path} could be {', '.join(r.file for r in files.orderBy('file').limit(5).collect())}")
    return code.join(files, "file", "left_semi").select("file", "start_line", "id", "node_type", "name").orderBy("file", "start_line", "id")


def get_code(nodes: DataFrame, code: DataFrame, refs: list[str], chars: int = CODE_CHARS) -> DataFrame:
    """(id, code, cut): the code of the references in their order until the characters are used up. code: (id, code)."""
    found = expand_refs(nodes, refs).join(code, "id").withColumn("used", F.sum(F.length("code")).over(Window.partitionBy(F.lit(0)).orderBy("ref", "id")))
    before = c("used") - F.length("code")
    left = F.greatest(F.lit(chars) - before, F.lit(0)).cast("int")  # at most REF_CAP rows a reference
    return found.where(before < chars).select("id", F.substr("code", F.lit(1), left).alias("code"), (F.length("code") > left).alias("cut"))


def code_window(files: DataFrame, path: str, start: int, end: int, hashes: DataFrame | None = None) -> DataFrame:
    """(path, line, text, stale): lines start to end of a file, clamped. files: (path, text); hashes: (path, hash) as indexed, to say whether the file has changed since."""
    f = files.where(c("path") == path)
    if hashes is not None:
        f = f.join(hashes.select("path", "hash"), "path", "left").withColumn("stale", F.coalesce(c("hash") != F.sha2(c("text").cast("binary"), 256), F.lit(False)))
    else:
        f = f.withColumn("stale", F.lit(False))
    return f.select("path", "stale", F.posexplode(F.split("text", "\n")).alias("n", "text")).where((c("n") + 1).between(start, end)).select("path", (c("n") + 1).cast("long").alias("line"), "text", "stale")


def check_tour(stops: DataFrame, candidates: DataFrame, most: int = 12) -> tuple[DataFrame, list[str]]:
    """Stops (place, id) that are candidates (id, rank), each once, at most ``most``, renumbered, and warnings; without any good stop the candidates in rank order.

    A planner may name nodes that aren't there, name one twice or plan too far.
    """
    known = candidates.select("id").distinct()
    rows = cut(stops.join(known.withColumn("known", F.lit(True)), "id", "left"))
    first = cut(rows.where("known").groupBy("id").agg(F.min("place").alias("place")))
    unknown, good, given = rows.where("known is null").count(), first.count(), rows.count()
    notes = [f"{unknown} stops name no candidate"] * (unknown > 0) + [f"{given - unknown - good} stops are repeated"] * (given - unknown > good) + [f"only the first {most} of {good} stops are kept"] * (good > most)
    if not good:
        notes.append("no stop is left; the candidates stand in their order")
        first = candidates.groupBy("id").agg(F.min("rank").alias("place"))
    w = Window.partitionBy(F.lit(0)).orderBy("place", "id")  # a tour is short
    return first.orderBy("place", "id").limit(most).select(F.row_number().over(w).cast("long").alias("place"), "id"), notes


def context(nodes: DataFrame, edges: DataFrame, target: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(role, id, chars, place) around a target: it, its users, tests, dependencies and documents, by role and degree within the budget.

    Each role stops at its number; an item that doesn't fit is left out, and later smaller ones may still fit.
    """
    e = edges.where(c("edge_type").isin(*IMPACT_EDGES))
    users = e.where(c("target") == target).select(c("source").alias("id")).distinct()
    uses = e.where(c("source") == target).select(c("target").alias("id")).distinct()
    tests = bfs(e, nodes.where(c("id") == target).select("id"), 3, None, "in").where("distance > 0").select("id").join(nodes.where("is_test = 1"), "id", "left_semi")
    docs = edges.where(c("target") == target).join(nodes.where("node_type = 'Concept'").select(c("id").alias("source")), "source", "left_semi").select(c("source").alias("id")).distinct()
    parts = {"target": nodes.where(c("id") == target).select("id"), "caller": users, "test": tests, "dependency": uses, "doc": docs}
    every = None
    for k, (role, _) in enumerate(ROLES):
        part = parts[role].withColumn("k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("id").agg(F.min("k").alias("k")).join(nodes.select("id", "in_degree", F.length(F.concat_ws(" ", "id", "name", "description")).alias("chars")), "id")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("in_degree"), "id"))
    few = first.withColumn("r", rank).orderBy("k", "r")
    cap = F.lit(0)
    for k, (_, n) in enumerate(ROLES):
        cap = F.when(c("k") == k, n).otherwise(cap)
    rows = few.where(c("r") <= cap).collect()  # at most the sum of the roles' numbers
    out, used = [], 0
    for x in sorted(rows, key=lambda x: (x.k, x.r)):
        most = budget // 2 if x.k == 0 else budget - used
        size = min(x.chars, budget // 2) if x.k == 0 else x.chars
        if size <= most:
            used += size
            out.append((ROLES[x.k][0], x.id, size, len(out) + 1))
    return nodes.sparkSession.createDataFrame(out, "role string, id string, chars long, place long")


def tour_links(stops: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, id, previous, link): consecutive stops with the least edge type between them, forward before backward. stops: (place, id)."""
    w = Window.partitionBy(F.lit(0)).orderBy("place")  # a tour is short
    s = stops.withColumn("previous", F.lag("id").over(w))
    forth = edges.groupBy(c("source").alias("previous"), c("target").alias("id")).agg(F.min("edge_type").alias("forward"))
    back = edges.groupBy(c("target").alias("previous"), c("source").alias("id")).agg(F.min("edge_type").alias("backward"))
    return s.join(forth, ["previous", "id"], "left").join(back, ["previous", "id"], "left").select("place", "id", "previous", F.coalesce("forward", F.concat(F.lit("<"), "backward")).alias("link"))
