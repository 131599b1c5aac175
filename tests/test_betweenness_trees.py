"""Betweenness of trees is counted in one pass; of other components no more copies are dealt than there are tasks."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.operators import graph as g


def forest(seed, n=60, ends=12):
    """Edges of trees towards their roots, below n, and of ends that hang on several of their nodes."""
    x = random.Random(seed)
    pairs = {(k, x.randrange(max(0, k - 3), k)) for k in range(1, n) if x.random() < 0.95}
    return sorted(pairs | {(x.randrange(n), n + x.randrange(ends)) for _ in range(40)})


def whole(pairs, n):
    """By ``_dependencies`` of all sources."""
    a, b = (np.array(x) for x in zip(*pairs))
    order = np.argsort(a, kind="stable")
    return g._dependencies(np.searchsorted(a[order], np.arange(n + 1)), b[order], np.unique(a), n)


def test_trees_are_counted_as_paths_are(spark):
    """the counts of a tree equal those of all its paths, to ends that several nodes hold as well."""
    for seed in range(200):
        pairs = forest(seed)
        a, b = (np.array(x) for x in zip(*pairs))
        assert g._tree_dependencies(a, b, 72).tolist() == whole(pairs, 72).tolist()


def test_a_long_chain_ends(spark):
    """a chain of 3,000 nodes, one end of which hangs on all of them, beside a ring and a net."""
    n = 3000
    pairs = [(k, k - 1) for k in range(1, n)] + [(k, n) for k in range(n)] + [(n + 1, n + 2), (n + 2, n + 3), (n + 3, n + 1), (n + 4, n + 5), (n + 4, n + 6), (n + 5, n + 7), (n + 6, n + 7), (n + 7, n + 4)]
    edges = spark.createDataFrame([(str(a), str(b), "Calls") for a, b in [*pairs, (7, 7)]], "source string, target string, edge_type string")
    nodes = spark.range(n + 8).select(F.col("id").cast("string").alias("id"))
    got = {int(x.id): x.betweenness * (n + 7) * (n + 6) for x in g.betweenness(nodes, edges).collect()}
    ring = whole([(a - n - 1, b - n - 1) for a, b in pairs if a > n], 7)
    assert all(abs(got[k] - (n - 1 - k) * k) < 1e-3 for k in range(n)) and all(abs(got[n + 1 + k] - x) < 1e-6 for k, x in enumerate(ring))


def test_no_more_copies_than_tasks(spark, monkeypatch):
    """a ring is dealt to as many blocks as there are tasks, not to one for each few sources."""
    monkeypatch.setattr(g, "CELLS", 4)
    blocks, settle = spark.sparkContext.accumulator(0), g._settled_dependencies

    def counted(group):
        blocks.add(1)
        return settle(group)

    monkeypatch.setattr(g, "_settled_dependencies", counted)
    edges = spark.createDataFrame([(str(k), str((k + 1) % 300), "Calls") for k in range(300)], "source string, target string, edge_type string")
    nodes = spark.range(300).select(F.col("id").cast("string").alias("id"))
    got = g.betweenness(nodes, edges).collect()
    assert {round(x.betweenness * 299 * 298) for x in got} == {sum(range(299))} and blocks.value <= 4 * spark.sparkContext.defaultParallelism + 1
