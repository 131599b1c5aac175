import pytest

from weftgraph.functions import lines
from weftgraph.sources import store

from .fixture_graph import IDS, OVEN, make


def test_store_round_trip(spark, tmp_path):
    nodes, edges = make(spark)
    s = store.GraphStore(spark, f"{tmp_path}/kg", 4, "m")
    s.write(nodes, edges)
    again = store.GraphStore(spark, f"{tmp_path}/kg", 4, "m")
    assert again.counts() == (10, 9)
    assert sorted(map(str, again.nodes().select(*nodes.columns).collect())) == sorted(map(str, nodes.collect()))
    ids = [IDS[OVEN], IDS["Tray"], "nowhere"]
    assert [r.id for r in again.fetch(ids).collect()] == ids[:2]
    again.write(nodes.limit(3), edges.limit(1))
    assert store.GraphStore(spark, f"{tmp_path}/kg").counts() == (3, 1)
    for bad in ((5, "m"), (4, "other")):
        with pytest.raises(store.StoreMismatch):
            store.GraphStore(spark, f"{tmp_path}/kg", *bad)
    two = [store.GraphStore(spark, f"{tmp_path}/{k}", 4) for k in "ab"]
    store.write_all(two, nodes, edges)
    assert [x.counts() for x in two] == [(10, 9)] * 2
    with pytest.raises(store.StoreMismatch):
        store.write_all([two[0], store.GraphStore(spark, f"{tmp_path}/c", 5)], nodes, edges)


def test_json_and_scrub(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "file": "/home/me/r/x.py"}],\n "edges": [{"source": "a", "target": "a", "edge_type": "Calls"}]}')
    nodes, edges = store.read_graph_json(spark, f"{tmp_path}/g.json")
    assert edges.count() == 1 and store.scrub(nodes, "/home/me/r/").first().file == "./x.py"


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("python", "# c\nx = 1  # tail\n\ns = '#'\n\"\"\"doc\n# inside\n\"\"\"\n  # d", "mcbcccCm"),
        ("rust", "/* a\n\n b */ let x = 1;\n/* y */\nlet s = \"/*\";\n// z", "mbcmcm"),
        ("java", "int x; /* open\nstill */\nint y;", "cmc"),
        ("typescript", "const a = `\n// not\n`;\n// yes", "cccm"),
    ],
)
def test_line_kinds(language, text, want):
    short = {lines.BLANK: "b", lines.COMMENT: "m", lines.CODE: "c"}
    assert "".join(short[k] for k in lines.classify(text, language)) == want.lower()


def test_counts_and_prose(spark):
    text = "# Licensed to all of you here\n# Explains the next step well\nx = 1\n# eslint-disable this rule now\n# ==== ---- ====\n# short"
    f = spark.createDataFrame([("a.py", "python", text), ("b.py", "python", text.split("\n")[0])], "path string, language string, text string")
    from pyspark.sql import functions as F

    got = f.withColumn("k", lines.line_kinds("text", "language")).select(lines.count_kind(F.col("k"), "Comment", F.lit(1), F.lit(3)), lines.count_kind(F.col("k"), "Code", F.lit(1), F.lit(9))).first()
    assert tuple(got) == (2, 1)
    assert sorted(map(tuple, lines.prose_comments(f).collect())) == [("a.py", 1, "Licensed to all of you here"), ("a.py", 2, "Explains the next step well")]


def test_prose_is_told_from_directives_and_code(spark):
    from pyspark.sql import functions as F

    said = {
        "explains what happens next": True, "TODO explain what happens next": True, "Copyright of all of you": True, "short one": False, "two longwords": False, "12 345 6789 1011": False,
        "eslint-disable next line please": False, "this has allow(dead_code) in it": False, "see the noqa marker here": False, "let x = foo(bar) + baz;": False, "if the value is set {": False,
        "a(b)[c]{d} <e> f::g !! h": False, "=== explains what happens next ===": True, "mypy pragma nolint spdx words": True, "-*- coding of some kind here": True,
    }
    got = spark.createDataFrame([(x,) for x in said], "t string").select("t", lines.is_prose(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in got} == said
