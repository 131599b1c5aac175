"""Closures take few written rounds; the first batch of a followed tree looks nothing up."""

from weftgraph.operators import resolve
from weftgraph.streaming import source_graph

from .test_source_graph import TREE, listing, same

#: a chain longer than the levels, a diamond with a short way round, a ring, a type above itself
EDGES = [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("a", "b"), ("a", "d"), ("b", "e"), ("d", "e"), ("e", "f"), ("a", "e"), ("r", "s"), ("s", "t"), ("t", "r"), ("o", "o")]


def reached(levels):
    """(id, other, level) by breadth-first search."""
    out = set()
    for start in {x for e in EDGES for x in e}:
        seen, last = {start}, {start}
        for level in range(1, levels + 1):
            last = {b for a, b in EDGES if a in last} - seen
            seen |= last
            out |= {(start, x, level) for x in last}
    return out


def test_a_closure_doubles_its_levels(spark, monkeypatch):
    rounds, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: rounds.append(1) or cut(df))
    edges = spark.createDataFrame([(a, b, "Extends") for a, b in EDGES], "source string, target string, edge_type string")
    assert {tuple(r) for r in resolve.closure(edges).select("id", "other", "level").collect()} == reached(8)
    assert len(rounds) <= 4
    assert {tuple(r) for r in resolve.closure(edges, levels=5).select("id", "other", "level").collect()} == reached(5)
    assert {(r.other, r.id, r.level) for r in resolve.closure(edges, down=True, levels=3).collect()} == reached(3)


def test_the_first_batch_looks_up_nothing(spark, tmp_path, monkeypatch):
    def no(*_, **__):
        raise AssertionError("there is nothing to look up")

    monkeypatch.setattr(source_graph, "_spread", no)
    store = source_graph.SourceGraph(spark, str(tmp_path / "g"))
    assert store.update("first", listing(spark, TREE))
    same(spark, store, TREE)
