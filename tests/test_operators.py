"""Operators against plain Python on small graphs and texts."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import globs, text
from weftgraph.operators import graph as g
from weftgraph.operators import retrieval as r
from weftgraph.operators import tools
from weftgraph.operators.reach import FrontierTooLarge, bfs, distinct_reach, path_counts
from weftgraph.streaming import incremental

from .fixture_graph import IDS, OVEN, make


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def edges_of(spark, pairs):
    return spark.createDataFrame([(str(a), str(b), "Calls") for a, b in pairs], "source string, target string, edge_type string")


def random_graph(seed, n=12, m=24, loops=True):
    x = random.Random(seed)
    return sorted({(x.randrange(n), x.randrange(n)) for _ in range(m)} - (set() if loops else {(i, i) for i in range(n)}))


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_and_paths(spark, seed):
    pairs = random_graph(seed)
    e = edges_of(spark, pairs).repartition(3)
    dist, frontier = {0: 0}, [0]
    for d in range(1, 4):
        frontier = sorted({b for a, b in pairs if a in frontier} - set(dist))
        dist |= {b: d for b in frontier}
    seeds = spark.createDataFrame([("0",)], "id string")
    assert rows(bfs(e, seeds, 3)) == sorted((str(k), v) for k, v in dist.items())
    count = defaultdict(int)

    def walk(at, used):
        for k, (a, b) in enumerate(pairs):
            if a == at and k not in used:
                count[b] += 1
                if len(used) < 2:
                    walk(b, used | {k})

    walk(0, frozenset())
    assert rows(path_counts(e, seeds, 3)) == sorted((str(k), v) for k, v in count.items())


def test_frontier_limit(spark):
    e = edges_of(spark, [(0, k) for k in range(1, 9)])
    with pytest.raises(FrontierTooLarge):
        bfs(e, spark.createDataFrame([("0",)], "id string"), 2, frontier_limit=5)


def test_shortest_path(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (9, 0)])
    assert g.shortest_path(e, "0", "4") == ["0", "3", "4"]
    assert g.shortest_path(e, "4", "0", strict=True) is None and g.shortest_path(e, "4", "0") == ["4", "3", "0"]
    assert g.shortest_path(e, "2", "2") == ["2"] and g.shortest_path(e, "0", "77") is None


def test_all_shortest_paths(spark):
    e = edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (0, 5), (5, 6), (6, 4), (4, 0), (1, 7), (0, 8), (8, 9), (9, 3)])
    assert rows(g.all_shortest_paths(e, "0", "4")) == [(1, "0", "1"), (1, "0", "2"), (1, "0", "5"), (2, "1", "3"), (2, "2", "3"), (2, "5", "6"), (3, "3", "4"), (3, "6", "4")]
    assert rows(g.all_shortest_paths(e, "4", "7")) == [(1, "4", "0"), (2, "0", "1"), (3, "1", "7")]
    assert rows(g.all_shortest_paths(e, "7", "0")) == [] == rows(g.all_shortest_paths(e, "0", "0"))


def test_long_walks_are_not_cut(spark):
    chain = edges_of(spark, [(k, k + 1) for k in range(20)])
    seeds = spark.createDataFrame([("0",)], "id string")
    assert {int(x.id): x.distance for x in bfs(chain, seeds, 18).collect()} == {k: k for k in range(19)}
    assert {int(x.id) for x in distinct_reach(chain, seeds, 18).collect()} == set(range(1, 19))
    loop = edges_of(spark, [(0, 1), (1, 2), (2, 0)])
    assert {x.id for x in distinct_reach(loop, seeds, 6).collect()} == {"0", "1", "2"}


def test_centrality_report(spark):
    nodes, edges = make(spark)
    got = g.centrality_report(nodes, edges, "betweenness", 2, "function", "bakery/").collect()
    assert [x.name for x in got] == ["charge", "bake"] and got[0].degree == 4
    assert [x.name for x in g.centrality_report(nodes, edges, top=1, prefix="bakery/oven").collect()] == ["bake"]
    with pytest.raises(ValueError, match="pairs of neighbours"):
        g.betweenness(nodes, edges, most_edges=3)


def test_betweenness(spark):
    pairs = random_graph(5, 9, 18, loops=False)
    nodes = spark.createDataFrame([(str(i),) for i in range(9)], "id string")
    total = defaultdict(float)
    for s in range(9):
        paths = defaultdict(list)
        layer, seen = {s: [[s]]}, {s}
        while layer:
            new = defaultdict(list)
            for a, ps in layer.items():
                for x, b in pairs:
                    if x == a and b not in seen:
                        new[b] += [p + [b] for p in ps]
            seen |= set(new)
            for b, ps in new.items():
                paths[b] = ps
            layer = new
        for b, ps in paths.items():
            for p in ps:
                for v in p[1:-1]:
                    total[v] += 1 / len(ps)
    got = {x.id: x.betweenness for x in g.betweenness(nodes, edges_of(spark, pairs)).collect()}
    assert all(abs(got[str(v)] - total[v] / 56) < 1e-9 for v in range(9))


def test_betweenness_of_many_nodes_and_blocks(spark, monkeypatch):
    """Over 50,000 nodes; and the same result from small blocks of several components as from one task."""
    few = g.betweenness(spark.range(50_001).select(F.col("id").cast("string").alias("id")), edges_of(spark, [(0, 1), (1, 2), (2, 3)]))
    assert {x.id: round(x.betweenness * 50_000 * 49_999, 6) for x in few.where("betweenness > 0").collect()} == {"1": 2.0, "2": 2.0}
    pairs = {(a + 30 * k, b + 30 * k) for k in range(3) for a, b in random_graph(k, 30, 50, loops=False)} | {(a, 200 + a % 7) for a in range(90)}
    nodes = spark.createDataFrame([(str(i),) for i in range(210)], "id string")
    whole = {x.id: x.betweenness for x in g.betweenness(nodes, edges_of(spark, pairs)).collect()}
    monkeypatch.setattr(g, "CELLS", 300)
    monkeypatch.setattr(g, "TOGETHER", 20)
    parts = {x.id: x.betweenness for x in g.betweenness(nodes, edges_of(spark, pairs)).collect()}
    assert len(parts) == 210 and all(abs(parts[i] - x) < 1e-12 for i, x in whole.items()) and max(whole.values()) > 0


def components(pairs):
    """(component, id, length) by plain reachability."""
    to = defaultdict(set)
    for a, b in pairs:
        to[a].add(b)
    reach = {}
    for s in {x for p in pairs for x in p}:
        todo, seen = [s], set()
        while todo:
            new = to[todo.pop()] - seen
            seen |= new
            todo += new
        reach[s] = seen
    out = []
    for s in reach:
        if s in reach[s]:
            mine = {x for x in reach[s] if s in reach[x]}
            out.append((min(map(str, mine)), str(s), len(mine)))
    return sorted(out)


@pytest.mark.parametrize("seed, parts, small", [(0, 4, 0), (2, 12, 100_000), (3, 12, 100_000)])
def test_cycles_of_random_graphs(spark, seed, parts, small):
    x, pairs = random.Random(seed), []
    for part in range(parts):  # rings with tails, random parts, chains from one part to the next, self-loops
        n, at = x.randrange(2, 9), part * 100
        if part % 3 == 0:
            pairs += [(at + i, at + (i + 1) % n) for i in range(n)] + [(at + n + i, at + n + i + 1) for i in range(5)] + [(at + x.randrange(n), at + n)]
        elif part % 3 == 1:
            pairs += [(at + a, at + b) for a, b in random_graph(seed * 50 + part, n, n + 3)]
        else:
            pairs += [(at + a, at + b) for a, b in random_graph(seed * 50 + part, 14, 15, loops=False)] + [(at, at)]
        if part and x.random() < 0.6:
            pairs += [(at - 100 + x.randrange(3), at + 50), (at + 50, at + 51), (at + 51, at + x.randrange(3))]
        if part > 4 and x.random() < 0.3:
            pairs += [(at, at + 60), (at + 60, at - 300)]
    assert rows(g.cycles(edges_of(spark, pairs), small=small)) == components(pairs)


def test_cycles_over_long_chains_and_nothing(spark, monkeypatch):
    """Rounds don't grow with the length of a chain, and neither does what is raked."""
    cuts = []
    monkeypatch.setattr(g, "cut", lambda df, cut=g.cut: cuts.append(1) or cut(df))
    n, m = 500, 60
    ring = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 0)]
    tail = [(n + i, n + i + 1) for i in range(m)] + [(5, n), (n + m, n + m - 2)]  # out of the ring, with a small ring at its end
    got = rows(g.cycles(edges_of(spark, ring + tail), small=0))
    assert [(a, b) for a, _, b in got].count(("0", n)) == n and len(got) == n + 3
    assert {x for a, x, b in got if b == 3} == {str(n + m - 2), str(n + m - 1), str(n + m)}
    assert len(cuts) < 40
    chain = [(i, i + 1) for i in range(3000)]
    assert not g.has_cycles(edges_of(spark, chain)) and g.has_cycles(edges_of(spark, chain + [(3000, 0)])) and g.has_cycles(edges_of(spark, [*chain, (3000, 2990)]))
    none = spark.createDataFrame([(None, "a", "Calls"), ("b", None, "Calls")], "source string, target string, edge_type string")
    assert rows(g.cycles(none)) == [] and rows(g.cycles(none.limit(0))) == [] and not g.has_cycles(none)


def test_cycles(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 5), (6, 7), (7, 6)])
    assert rows(g.cycles(e)) == [("0", "0", 3), ("0", "1", 3), ("0", "2", 3), ("5", "5", 1), ("6", "6", 2), ("6", "7", 2)]
    nodes = spark.createDataFrame([(str(k), f"a/{k}" if k < 6 else f"b/{k}") for k in range(8)], "id string, file string")
    assert [tuple(x)[:3] for x in g.cycles_report(nodes, e, min_length=2).collect()] == [("0", 3, "0"), ("0", 3, "1"), ("0", 3, "2"), ("6", 2, "6"), ("6", 2, "7")]
    assert [x.id for x in g.cycles_report(nodes, e, max_length=2, prefix="b/").collect()] == ["6", "7"]
    assert not g.has_cycles(edges_of(spark, [(0, 1), (1, 2), (0, 2)])) and g.has_cycles(edges_of(spark, [(0, 1), (1, 0)]))


def test_pagerank_stops_and_drops_unknown_seeds(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (2, 0), (0, 3)])
    a, b = ({x.id: x.score for x in g.personalized_pagerank(e, seeds, iterations=200).collect()} for seeds in (["0"], ["0", "nowhere"]))
    assert a == b and abs(sum(a.values()) - 1) < 1e-9
    exact = {x.id: x.score for x in g.personalized_pagerank(e, ["0"], iterations=300, epsilon=0).collect()}
    assert all(abs(a[k] - exact[k]) < 1e-5 for k in exact)
    assert g.personalized_pagerank(e, ["nowhere"]).count() == 0


def test_pagerank(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (0, 3)]
    rank = {0: 1.0}
    for _ in range(20):
        new = defaultdict(float)
        for a, s in rank.items():
            outs = [b for x, b in pairs if x == a]
            for b in outs:
                new[b] += 0.85 * s / len(outs)
        new[0] += 1 - sum(new.values())
        rank = new
    got = {x.id: x.score for x in g.personalized_pagerank(edges_of(spark, pairs), ["0"], iterations=20, epsilon=0).collect()}
    assert all(abs(got[str(k)] - v) < 1e-9 for k, v in rank.items()) and abs(sum(got.values()) - 1) < 1e-9


def test_tools_on_the_fixture(spark):
    nodes, edges = make(spark)
    assert [x.name for x in tools.find_symbols(nodes, "char*").collect()] == ["charge"]
    assert [x.name for x in tools.find_symbols(nodes, "charge").collect()] == ["charge", "test_charge"]
    assert [x.name for x in tools.file_outline(nodes, "oven.py").collect()] == ["Tray", "bake", "knead"]
    assert tools.resolve_one(nodes, "oven.py") == IDS[OVEN] and tools.resolve_one(nodes, "KNEAD") == IDS["knead"]
    with pytest.raises(tools.Ambiguous):
        tools.resolve_one(nodes, "nothing")
    got = [(x.role, x.id.rsplit(":")[-1]) for x in tools.context(nodes, edges, IDS["bake"]).collect()]
    assert got[0] == ("target", "bake") and {("caller", "Tray"), ("caller", "charge"), ("test", "test_charge"), ("dependency", "knead")} <= set(got)
    assert sum(x.chars for x in tools.context(nodes, edges, IDS["bake"], 80).collect()) <= 80
    usages = {x.id.rsplit(":")[-1]: x.distance for x in g.find_usages(edges, nodes.where("name = 'knead'").select("id"), 3).collect()}
    assert usages == {"bake": 1, "idle": 1, "charge": 2, "Tray": 2, "test_charge": 3, "Drawer": 3}


@pytest.mark.parametrize("name,words", [("buildSparseKeywordVector", ["build", "sparse", "keyword", "vector"]), ("Db::upsert_nodes", ["db", "upsert", "nodes"]), ("parseXMLDocument", ["parse", "xml", "document"]), ("sha256Sum", ["sha256", "sum"]), ("x", ["x"]), ("", [])])
def test_split_identifier(spark, name, words):
    assert spark.createDataFrame([(name,)], "n string").select(text.split_identifier("n")).first()[0] == words


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ab", "a/./b/../c?x#y", "src/x/y.py", "Hello, World! buildVector a")], "t string, p string, f string, s string")
    got = df.select(text.fnv1a_32("t"), text.normalize_path("p"), text.folder_of("f"), text.tokenize("s"), text.resolve_relative("f", F_lit("../z.md")), text.truncate_chars("s", 6), text.humanize_identifier(F_lit("fooBar")), text.humanize_identifier(F_lit("foo")), text.dependency_root(F_lit("@a/b/c")), text.annotation_argument(F_lit('value = "x", name = "y"'), "name")).first()
    assert tuple(got) == (1294271946, "a/c", "src/x", ["hello", "world", "buildvector", "build", "vector"], "src/z.md", "Hello…", "foo bar", None, "@a/b", "y")


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_is_test(spark):
    paths = {"tests/a.rs": 1, "src/a_test.go": 1, "src/a.spec.ts": 1, "src/contest/a.rs": 0, "src/latest.py": 0, "test_x.py": 1, None: 0}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {x[0]: x[1] for x in df.select("p", text.is_test("p")).collect()} == paths


GLOBS = [("*.py", "a.py", False, True), ("*.py", "a/b.py", True, False), ("**/*.py", "a/b/c.PY", True, True), ("**/*.py", "c.py", True, True), ("a?c", "abc", False, True), ("[!a]b", "cb", False, True), ("[!a]b", "ab", False, False), ("{x,y}z", "yz", False, True), ("{x,y", "x", False, True), ("[ab", "[ab", False, True), ("a\\*b", "a*b", False, True), ("a\\*b", "axb", False, False), ("a*", "a/b", False, True)]


def test_globs(spark):
    for glob, value, path, want in GLOBS:
        df = spark.createDataFrame([(value,)], "v string")
        assert df.where(globs.matches(df.v, glob, path)).count() == int(want), (glob, value)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab./*?[]{},!\\-", max_size=12), st.text(alphabet="ab./", max_size=8))
def test_globs_never_break(glob, value):
    import re

    re.compile(globs.to_regex(glob, path=True).replace("(?is)", ""))


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [1.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vector array<double>")
    assert [x[1] for x in sorted(r.vector_search(v, q, 3).collect(), key=lambda x: x.rank)] == [1, 6, 3]
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "query_id string, id long, rank int")
    assert [x.id for x in sorted(r.rrf(a, b).collect(), key=lambda x: x.rank)] == [2, 1]
    picks = r.mmr(v.where("id in (1, 3, 6)").select(F_lit("q").alias("query_id"), "id", "vector"), [1.0, 0.1], 2).collect()
    assert [x.id for x in sorted(picks, key=lambda x: x.pick)] == [1, 3]


def test_queries_go_through_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5 + 1)]) for k in range(40)], "id long, vector array<double>")
    q = spark.createDataFrame([(k, [1.0, k / 3]) for k in range(11)], "query_id long, vector array<double>")
    whole = rows(r.vector_search(v, q, 3))
    monkeypatch.setattr(r, "MAX_QUERIES", 4)
    assert rows(r.vector_search(v, q, 3)) == whole and len(whole) == 33
    assert rows(r.vector_search(v, q.limit(0), 3)) == []


def test_bm25_prefers_rare_and_saturates(spark):
    d = spark.createDataFrame([(1, "common rare"), (2, "common common common common"), (3, "common other"), (4, "common")], "id long, text string")
    q = spark.createDataFrame([("q", "common rare")], "query_id string, text string")
    got = {x.id: x.score for x in r.bm25(r.postings(d), q, 4).collect()}
    assert max(got, key=got.get) == 1 and got[2] > got[4] and got[2] < 2.2 * got[4]


def test_budget_and_diversity(spark):
    d = spark.createDataFrame([("q", i, i, 40, "f%d" % (i // 3)) for i in range(1, 8)], "query_id string, id int, rank int, chars int, file string")
    assert [x.id for x in sorted(r.char_budget(d, 100, 5).collect(), key=lambda x: x.rank)] == [1, 2]
    assert [x.id for x in r.char_budget(d, 10, 5).collect()] == [1]
    assert [x.id for x in sorted(r.diversify(d, "file", 2).collect(), key=lambda x: x.place)] == [1, 2, 3, 4, 6, 7, 5]


def test_incremental(spark):
    old = spark.createDataFrame([("a", "t", 1, True), ("b", "t", 1, True), ("c", "t", 1, True), ("d", "t", 1, False), ("e", "t", 1, True)], "id string, node_text string, loc int, has_vector boolean")
    new = spark.createDataFrame([("a", "t", 1), ("b", "t", 2), ("c", "u", 1), ("d", "t", 1), ("f", "t", 1)], "id string, node_text string, loc int")
    want = {"a": "unchanged", "b": "rewrite", "c": "embed", "d": "embed", "e": "remove", "f": "embed"}
    assert dict(rows(incremental.plan(old, new, ["loc"]))) == want
    assert {k: v for k, v in rows(incremental.plan(old, new, ["loc"], same_model=False))}["a"] == "embed"
    with pytest.raises(incremental.EmptyGraph):
        incremental.prune(old, new.limit(0))
    nodes = spark.createDataFrame([("x",), ("y",)], "id string")
    with pytest.raises(ValueError, match="unknown nodes: z"):
        incremental.upsert_edges(edges_of(spark, []), edges_of(spark, [("x", "z")]), nodes)
    stored = spark.createDataFrame([("Function", "a", [])], "node_type string, id string, vector array<double>")
    with pytest.raises(ValueError, match="wide"):
        incremental.upsert_nodes(stored, spark.createDataFrame([("Function", "b", [1.0])], stored.schema), 3)


def test_change_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, version int, v string").write.parquet(f"{tmp_path}/in")
    seen = []
    query = incremental.follow(spark, f"{tmp_path}/in", "id string, version int, v string", lambda df, n: seen.extend(df.collect()), f"{tmp_path}/state")
    query.awaitTermination(60)
    assert sorted((x.id, x.v) for x in seen) == [("a", "y"), ("b", "z")]
