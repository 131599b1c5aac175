import pytest

from weftgraph.plans import envelope as env
from weftgraph.plans import gql
from weftgraph.plans.presets import PRESETS, REQUIRED

from .fixture_graph import IDS, OVEN, TILL, make


@pytest.fixture(scope="module")
def g(spark):
    nodes, edges = make(spark)
    return nodes.persist(), edges.persist()


def ask(g, text, **params):
    return [tuple(r) for r in gql.run(text, *g, **params).collect()]


def short(rows):
    return [tuple(str(x).rsplit(":", 1)[-1] for x in r) for r in rows]


def test_filter_sort_limit(g):
    got = ask(g, "MATCH (f:Function) WHERE f.loc > 20 AND f.is_test = 0 RETURN elementKey(f) AS id, f.loc AS loc ORDER BY loc DESC LIMIT 2")
    assert short(got) == [("bake", "141"), ("charge", "71")]


def test_aggregates_and_having(g):
    got = ask(g, "MATCH (n) WHERE NOT (n.node_type IN ['File']) WITH n.file AS file, count(*) AS c, avg(n.loc) AS a WHERE c >= 2 RETURN file, c, a ORDER BY file")
    assert got == [(OVEN, 3, 128.0), (TILL, 3, (71 + 12 + 51) / 3)]


def test_patterns_in_both_directions(g):
    a = ask(g, "MATCH (a)-[:Calls]->(b) RETURN elementKey(a) AS a, elementKey(b) AS b")
    b = ask(g, "MATCH (b)<-[:Calls]-(a) RETURN elementKey(a) AS a, elementKey(b) AS b")
    assert sorted(a) == sorted(b) and len(a) == 4


def test_variable_length_counts_paths(g):
    text = "MATCH (d)-[:Calls|References*1..3]->(t) WHERE t.name = $name RETURN elementKey(d) AS id, count(*) AS paths"
    assert sorted(short(ask(g, text, name="bake"))) == [("Drawer", "2"), ("Tray", "1"), ("charge", "2"), ("test_charge", "2")]
    for words in ("count(DISTINCT elementKey(d)) AS n", "count(DISTINCT d.id) AS n, min(d.loc) AS least"):  # ends only: walked without paths
        distinct = f"MATCH (d)-[:Calls|References|Imports*1..3]->(t) WHERE t.file = $f AND d.file <> $f RETURN {words}"
        assert ask(g, distinct, f=OVEN)[0][0] == 6
    assert sorted(short(ask(g, "MATCH (d)-[:Calls*1..4]->(t) WHERE t.name = 'knead' RETURN DISTINCT elementKey(d) AS id"))) == [("bake",), ("charge",), ("idle",), ("test_charge",)]
    assert ask(g, "MATCH (a)-[:Calls*2..2]->(b) RETURN count(DISTINCT elementKey(b)) AS n") == [(2,)]


def test_exists_and_optional(g):
    text = "MATCH (n:Function) WHERE n.is_test = 0 AND NOT EXISTS { MATCH (t)-[:Calls*1..2]->(n) WHERE t.is_test = 1 RETURN t } RETURN n.name AS name ORDER BY name"
    assert ask(g, text) == [("idle",), ("knead",)]
    got = ask(g, "MATCH (f:Function) OPTIONAL MATCH (f)-[:Calls]->(x) RETURN f.name AS f, x.name AS x ORDER BY f")
    assert got == [("bake", "knead"), ("charge", "bake"), ("idle", "knead"), ("knead", None), ("test_charge", "charge")]


def test_case_strings_and_null(g):
    got = ask(g, "MATCH (f:Function) WHERE f.file STARTS WITH 'bakery/' AND f.name CONTAINS 'e' AND f.members IS NULL RETURN CASE WHEN f.loc >= 50 THEN 'long' ELSE 'short' END AS size, count(*) AS n ORDER BY size")
    assert got == [("long", 2), ("short", 2)]
    assert ask(g, "MATCH (n) RETURN DISTINCT labels(n) AS t ORDER BY t") == [("Class",), ("File",), ("Function",), ("Interface",)]


def test_comments_stand_outside_strings(g):
    assert ask(g, "MATCH (n) // every node\nWHERE n.boundary_detail <> 'http://x // y' // not this\nRETURN count(*) AS n // done") == [(2,)]


def test_unknown_property_is_null_not_an_error(g):
    assert ask(g, "MATCH (n) WHERE n.cyclomatic_complexity > 3 RETURN n.name") == []
    page = env.analyze(*g, text="MATCH (n) WHERE n.cyclomatic_complexity > 3 RETURN n.name")
    assert page.caveats == ["NOT INDEXED: no node has cyclomatic_complexity"]


@pytest.mark.parametrize("text", ["MATCH (n) DELETE n", "CREATE (n) RETURN n", "MATCH (n) SET n.x = 1 RETURN n"])
def test_writes_are_refused(g, text):
    with pytest.raises(gql.ReadOnlyError):
        ask(g, text)
    assert "MATCH ... RETURN" in env.explain_error(gql.ReadOnlyError("x"))


@pytest.mark.parametrize("text", ["", "RETURN 1", "MATCH (n) WHERE n.x NOT IN [1] RETURN n", "MATCH (n RETURN n", "MATCH (a)-[:X*1..99]->(b) RETURN a", "MATCH (n) RETURN n LIMIT", "MATCH (n) RETURN q", "MATCH (n) RETURN foo(n)"])
def test_bad_text_is_an_error(g, text):
    with pytest.raises(gql.GqlError):
        ask(g, text)


def test_every_preset_runs_and_known_answers(g):
    given = {"target": OVEN, "files": [OVEN], "symbol": IDS["knead"], "from_prefix": "bakery", "to_prefix": "bakery"}
    assert len(PRESETS) == 39
    for p in PRESETS.values():
        page = env.analyze(*g, name=p.name, **{k: given.get(k, v) for k, v in p.params.items() if k in given or v is not REQUIRED})
        assert page.columns and env.render(page)
    one = lambda name, **kw: env.analyze(*g, name=name, **kw).rows
    assert [r[0].rsplit(":")[-1] for r in one("long_functions", min_loc="50")] == ["bake", "charge"]
    assert one("impact_summary", target=OVEN) == [(6, 2)]  # charge, idle, test_charge, Drawer and two files
    assert one("boundary_impact", target=OVEN) == [(IDS["charge"], "http.endpoint", "PUT /sale", 5)]
    assert one("boundary_impact", target=TILL) == []  # its own endpoint is no impact
    assert one("boundary_census") == [("db.access", "jpa", 0, 1, 1), ("http.endpoint", "http", 1, 0, 1)]
    assert [r[1:] for r in one("classes_by_members")] == [(5, 210), (2, 51)]
    assert one("token_docs") == [(IDS["bake"], 103, 2)]
    assert one("dependency_fanin")[0] == (IDS["bake"], 2, 141)


def test_size_classes_have_their_borders_above(spark):
    from weftgraph.schema import NODES

    sizes = [0, 20, 21, 50, 51, 100, 101, 200, 201, None]
    n = spark.createDataFrame([tuple({"id": str(k), "node_type": "Function", "loc": v}.get(c) for c in NODES.names) for k, v in enumerate(sizes)], NODES)
    got = [tuple(r) for r in PRESETS["size_histogram"].run(n, None).collect()]
    assert got == [("a. 0-20", 3), ("b. 21-50", 2), ("c. 51-100", 2), ("d. 101-200", 2), ("e. 200+", 1)]


def test_test_ratio_is_by_functions(spark):
    from weftgraph.schema import NODES

    def row(k, folder, test):
        return tuple({"id": str(k), "node_type": "Function", "folder": folder, "is_test": test}.get(c) for c in NODES.names)

    n = spark.createDataFrame([row(k, "a", 1) for k in range(6)] + [row(k, "b", 0) for k in range(10, 18)] + [row(k, "c", 1) for k in range(20, 24)], NODES)
    assert [tuple(r) for r in PRESETS["test_ratio"].run(n, None).collect()] == [("b", 8, 0), ("a", 6, 6)]


#: what some presets say, as query text of the dialect: a second witness
WITNESSES = {
    "god_classes": "MATCH (x) WHERE x.node_type IN ['Interface', 'Class'] RETURN elementKey(x) AS id, x.loc AS loc, x.out_degree AS depends_on ORDER BY loc DESC, id",
    "boundary_impact": "MATCH (s)-[:Calls|References|Imports|Extends|Implements|Overrides*1..3]->(t) WHERE s.boundary_in = 1 AND t.file = $target AND s.file <> $target RETURN elementKey(s) AS surface, s.boundary_kinds AS kinds, s.boundary_detail AS exposed_as, count(*) AS paths ORDER BY paths DESC",
    "impact": "MATCH (d)-[:Calls|References|Imports|Extends|Implements|Overrides*1..3]->(t) WHERE d.file <> $target AND t.file = $target RETURN d.file AS file, count(DISTINCT elementKey(d)) AS dependents, sum(d.is_test) AS test_paths ORDER BY dependents DESC, file",
    "untested_symbols": "MATCH (f:Function) WHERE f.in_degree > 0 AND f.is_test = 0 AND NOT EXISTS { MATCH (t)-[:Calls|References*1..2]->(f) WHERE t.is_test = 1 RETURN t } RETURN elementKey(f) AS id, f.in_degree AS depended_on_by, f.loc AS loc ORDER BY depended_on_by DESC, id",
    "size_histogram": "MATCH (f:Function) RETURN CASE WHEN f.loc > 200 THEN 'e. 200+' WHEN f.loc > 100 THEN 'd. 101-200' WHEN f.loc > 50 THEN 'c. 51-100' WHEN f.loc > 20 THEN 'b. 21-50' ELSE 'a. 0-20' END AS bucket, count(*) AS functions ORDER BY bucket",
}


@pytest.mark.parametrize("name", WITNESSES)
def test_presets_agree_with_query_text(g, name):
    params = {"target": OVEN} if PRESETS[name].params else {}
    a, b = env.analyze(*g, name=name, **params), env.analyze(*g, text=WITNESSES[name], **params)
    assert a.columns == b.columns and a.rows == b.rows and a.rows


def test_parameters_are_checked():
    for bad in ({"min_loc": "x"}, {"nope": 1}):
        with pytest.raises(env.UsageError):
            env.bind(PRESETS["long_functions"], bad)
    with pytest.raises(env.UsageError):
        env.bind(PRESETS["impact"], {})
    with pytest.raises(env.UsageError):
        env.bind(PRESETS["diff_impact"], {"files": " , "})
    assert env.bind(PRESETS["diff_impact"], {"files": "a, b\nc"}) == {"files": ["a", "b", "c"]}
    with pytest.raises(env.UsageError, match="did you mean long_functions"):
        env.resolve("long_func")
    with pytest.raises(env.UsageError):
        env.resolve("impact", "MATCH (n) RETURN n")


@pytest.mark.parametrize("text,want", [(None, (1, 200)), ("20", (1, 20)), ("11-35", (11, 25)), ("34-end", (34, 200)), ("top 10", (1, 10)), ("rows 11 to 35", (11, 25)), ("1-999", (1, 200))])
def test_ranges(text, want):
    assert env.row_range(text) == want


@pytest.mark.parametrize("text", ["x", "0", "5-2", "-3"])
def test_bad_ranges(text):
    with pytest.raises(env.UsageError):
        env.row_range(text)


def test_truncation_is_exact(g):
    total = g[0].count()
    for n, more in ((total, False), (total - 1, True)):
        assert env.analyze(*g, text="MATCH (n) RETURN n.name ORDER BY n.name", rows=str(n)).truncated is more


def test_target_not_indexed(g):
    assert any(x.startswith("TARGET NOT INDEXED") for x in env.analyze(*g, name="impact", target="nowhere.rs").caveats)


def test_only_paths_from_the_anchors_are_listed(spark):
    """The written first edges are those of the anchor, not all of the graph."""
    nodes = spark.createDataFrame([(f"n{i}", "Function", f"n{i}") for i in range(40)], "id string, node_type string, name string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * k + 1) % 40}", "Calls") for i in range(40) for k in (1, 3)], "source string, target string, edge_type string")
    written = []
    former, gql.cut = gql.cut, lambda df: written.append(former(df)) or written[-1]
    try:
        got = gql.run("MATCH (d)-[:Calls*1..2]->(t) WHERE t.name = 'n7' RETURN elementKey(d) AS id, count(*) AS paths", nodes, edges)
    finally:
        gql.cut = former
    have = {(r.source, r.target) for r in edges.collect()}
    into = lambda x: [a for a, b in have if b == x]
    want = [a for a in into("n7")] + [z for a in into("n7") for z in into(a) if (z, a) != (a, "n7")]
    assert sorted((r.id, r.paths) for r in got.collect()) == sorted({(x, want.count(x)) for x in want})
    assert len(written) == 2 and max(df.count() for df in written) == edges.where("target = 'n7'").count()
