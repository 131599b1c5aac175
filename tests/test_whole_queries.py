"""Registered queries without a counterpart in SQL cover the whole table: against plain Python on the smallest tables."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from weftgraph.plans.projection import graph
from weftgraph.streaming import incremental

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def reachable(start, step):
    seen, todo = set(), [start]
    while todo:
        for x in step.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def test_cycles_of_all_calls(spark):
    step, back = {}, {}
    for r in graph(spark, SF)[1].where("edge_type = 'Calls'").collect():
        step.setdefault(r.source, set()).add(r.target)
        back.setdefault(r.target, set()).add(r.source)
    want, done = set(), set()
    for x in sorted(set(step) & set(back)):
        if x not in done and (both := reachable(x, step) & reachable(x, back)):
            done |= both
            want.add((min(both), len(both)))
    got = {(r.component, r.length) for r in entry.queries()["cycles"](spark, SF).collect()}
    assert got == want and max(n for _, n in want) > len([x for x in step if x.startswith("class:p1")])


def test_related_names_of_all_nodes(spark):
    nodes, edges = (x.collect() for x in graph(spark, SF))
    name, near = {r.id: r.name for r in nodes}, {}
    for r in edges:
        near.setdefault(r.source, set()).add(name.get(r.target))
        near.setdefault(r.target, set()).add(name.get(r.source))
    want = {x: "|".join(sorted(n - {None})[:128]) for x, n in near.items() if n - {None}}
    assert {r.id: r.related for r in entry.queries()["related_names_all"](spark, SF).collect()} == want


def test_mmr_of_every_query(spark):
    table = sorted((r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = [i for i, _ in table], np.stack([v for _, v in table])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in entry.queries()["mmr_rerank"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.id
    assert sorted(got) == [i for i in ids if i % 50 == 0] and len(got) > 1
    for q, picks in got.items():
        gain = unit @ unit[ids.index(q)]
        left = set(np.argsort(-gain, kind="stable")[:40].tolist())
        chosen = []
        for k in range(10):
            worth = {i: 0.5 * gain[i] - 0.5 * max([0.0, *(unit[i] @ unit[c] for c in chosen)]) for i in left}
            pick = ids.index(picks[k + 1])
            assert worth[pick] > max(worth.values()) - 1e-6, (q, k)  # the query's own vector makes ties
            chosen.append(pick)
            left.remove(pick)


def test_a_whole_edge_type_is_upserted(spark, monkeypatch):
    batches, upsert = [], incremental.upsert_edges
    monkeypatch.setattr(incremental, "upsert_edges", lambda stored, rows, nodes: batches.append(rows) or upsert(stored, rows, nodes))
    edges = graph(spark, SF)[1]
    assert entry.queries()["store_upsert_edges"](spark, SF).count() == edges.count()
    assert batches[0].count() == edges.where("edge_type = 'Calls'").count() > 1000
