"""Strong components of many small parts: rounds, and what is settled apart."""

import random

from weftgraph.operators import graph as g


def edges(spark, pairs):
    return spark.createDataFrame([(f"n{a:05d}", f"n{b:05d}", "T") for a, b in pairs], "source string, target string, edge_type string")


def found(df):
    return {(r.id, r.component) for r in df.collect()}


def test_rounds_grow_with_the_longest_ring_and_not_with_their_number(spark, monkeypatch):
    cuts, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: cuts.append(1) or cut(df))
    rings = [(8 * k + i, 8 * k + (i + 1) % 8) for k in range(300) for i in range(8)]
    chains = g._chains(edges(spark, rings).selectExpr("source as src", "target as dst"))
    assert {(r.id, r.low) for r in chains.where("ring").collect()} == {(f"n{a:05d}", f"n{a // 8 * 8:05d}") for a, _ in rings}
    assert len(cuts) <= 8  # as many rounds as 2,400 nodes have binary digits: 14 of them


def test_small_weak_components_are_settled_apart(spark):
    pairs, want = [], set()
    for k in range(12):  # two dense rings with an edge from one to the other, so that nothing can be contracted
        a, b = [20 * k + i for i in range(5)], [20 * k + 10 + i for i in range(4)]
        for ring in (a, b):
            pairs += [(x, y) for x in ring for y in ring if x != y]
            want |= {(f"n{x:05d}", f"n{ring[0]:05d}") for x in ring}
        pairs.append((a[1], b[2]))
    random.Random(3).shuffle(pairs)
    weak = g.weak_components(edges(spark, pairs).selectExpr("source as src", "target as dst"))
    assert {(r.id, r.weak) for r in weak.collect()} == {(x, f"n{int(x[1:]) // 20 * 20:05d}") for x, _ in want}
    assert found(g.strong_components(edges(spark, pairs), small=40)) == want
    big = [(1000 + i, 1000 + (i + s) % 40) for i in range(40) for s in (1, 3)]  # 80 pairs, too many to be settled whole
    want |= {(f"n{1000 + i:05d}", "n01000") for i in range(40)}
    assert found(g.strong_components(edges(spark, pairs + big), small=40)) == want
