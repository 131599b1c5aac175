"""Embedding, semantic search, selection and chat context against plain Python."""

import numpy as np

from weftgraph.operators import graph as g
from weftgraph.operators import retrieval as r
from weftgraph.operators import tools

from .fixture_graph import IDS, make


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_embed_checks_what_it_gets(spark):
    t = spark.createDataFrame([(k, f"text {k}") for k in range(10)] + [(10, None)], "id long, text string").coalesce(1)

    def odd(texts):
        if "text 4" in texts:
            raise OSError("the model is away")
        if "text 6" in texts:
            return [[1.0, 2.0]]
        return [[float(len(x)), 1.0] if x != "text 8" else [1.0] for x in texts]

    got = {x.id: x.vector for x in r.embed(t, odd, 2, 2).collect()}
    assert got[0] == [6.0, 1.0] and got[10] == [0.0, 1.0] and got[2] == [6.0, 1.0]
    assert [k for k, v in sorted(got.items()) if not v] == [4, 5, 6, 7, 8, 9]
    assert [x.id for x in r.pending_vectors(r.embed(t, odd, 2, 2)).orderBy("id").collect()] == [4, 5, 6, 7, 8, 9]


def test_semantic_search(spark):
    d = spark.createDataFrame([("a", "open the bakery door", "Function"), ("b", "close a window", "Function"), ("c", "bakery door", "Class"), ("d", "", "File")], "id string, text string, node_type string")
    v = r.embed(d)
    q = spark.createDataFrame([(1, "bakery door"), (2, "windows: close a window")], "query_id long, text string")
    got = {(x.query_id, x.rank): x.id for x in r.semantic_search(v, q, 2).collect()}
    assert got[1, 1] == "c" and got[1, 2] == "a" and got[2, 1] == "b"
    assert {x.id for x in r.semantic_search(v, q, 5, types=["Class"]).collect()} == {"c"}
    assert np.isclose(np.linalg.norm(r.hashed_words()(["x y z"])[0]), 1)


def test_document_vectors_mix_and_cap(spark):
    d = spark.createDataFrame([("a", "alpha alpha", "alpha beta"), ("b", "beta gamma", None), ("c", "beta", "delta delta delta")], "id string, name_text string, code string")
    got = {(x.id, x.token): x.w for x in r.document_vectors(d, cap=10).collect()}
    tf = {("a", "alpha"): 2.35, ("a", "beta"): 0.35, ("b", "beta"): 1.0, ("b", "gamma"): 1.0, ("c", "beta"): 1.0, ("c", "delta"): 1.05}
    assert set(got) == set(tf) and all(abs(got[k] - v * 2.2 / (v + 1.2)) < 1e-12 for k, v in tf.items())
    assert {(x.id, x.token) for x in r.document_vectors(d, cap=1).collect()} == {("a", "alpha"), ("b", "gamma"), ("c", "delta")}
    report = {x.id: (x.tokens, x.has_vector) for x in r.storage_report(spark.createDataFrame([("a", [1.0]), ("z", [])], "id string, vector array<double>"), r.document_vectors(d, cap=10)).collect()}
    assert report == {"a": (2, True), "z": (0, False)}


def test_search_kb_by_mmr(spark):
    nodes, edges = make(spark)
    place = {n: k for k, n in enumerate(sorted(IDS))}
    vec = lambda n: [1.0, 0.0] if n in ("bake", "knead") else [0.8, 0.6] if n == "charge" else [0.0, 1.0]
    v = nodes.join(spark.createDataFrame([(IDS[n], vec(n)) for n in place], "id string, vector array<double>"), "id")
    seeds = spark.createDataFrame([(IDS["bake"], 1, 1), (IDS["idle"], 2, 0)], "id string, rank int, dense int")
    got = [(x.id.rsplit(":")[-1], x.label) for x in sorted(r.search_kb_mmr(seeds, v, edges, [1.0, 0.0], 3, hops=1).collect(), key=lambda x: x.rank)]
    assert got[0] == ("bake", "semantic") and len(got) == 3
    # greedy choice by hand over what lies within one hop of the seeds
    pool = sorted({"bake", "idle", "charge", "Tray", "knead"}, key=IDS.__getitem__)
    x = np.array([vec(n) for n in pool])
    left, picked, worst = list(range(len(pool))), [], np.zeros(len(pool))
    for _ in range(3):
        best = max(left, key=lambda i: (0.5 * x[i] @ [1, 0] - 0.5 * worst[i], -i))
        picked.append(pool[best])
        left.remove(best)
        worst = np.maximum(worst, x @ x[best])
    assert [n for n, _ in got] == picked
    assert r.search_kb_mmr(seeds, v, edges, [1.0, 0.0], 3, budget=1).count() == 1


def test_context_blocks_and_messages(spark):
    hits = spark.createDataFrame([(1, k, f"n{k}", f"f{k}.py" if k < 3 else None, 7 if k == 1 else None, "x" * 10) for k in (1, 2, 3)], "query_id long, rank int, name string, file string, start_line long, text string")
    first, second, third = "[#1] n1 (f1.py:7)\\nxxxxxxxxxx", "[#2] n2 (f2.py)\\nxxxxxxxxxx", "[#3] n3\\nxxxxxxxxxx"
    first, second, third = (x.replace("\\n", "\n") for x in (first, second, third))
    assert rows(r.rag_context(hits)) == [(1, "\n\n".join([first, second, third]), 3)]
    assert rows(r.rag_context(hits, len(first) + len(second) + 4)) == [(1, first + "\n\n" + second, 2)]
    assert rows(r.rag_context(hits, 1)) == [(1, first, 1)]
    history = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", "t%d " % k * 3) for k in range(1, 6)], "query_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, text string")
    got = {x.query_id: [tuple(m) for m in x.messages] for x in r.chat_messages(r.rag_context(hits, 1), history, asked, "Be brief.", 20).collect()}
    assert got[1] == [("system", "Be brief."), ("system", "Context:\n" + first), ("assistant", "t4 t4 t4 "), ("user", "t5 t5 t5 "), ("user", "why?")]
    assert got[2] == [("system", "Be brief."), ("user", "how?")]


def test_call_sites_and_windows(spark):
    nodes, edges = make(spark)
    used = g.find_usages(edges, nodes.where("name = 'knead'").select("id"), 1)
    code = spark.createDataFrame([(IDS["bake"], "def bake():\n    knead(1)\n    rest()\n    again = knead(2); knead(3)", 10), (IDS["idle"], "pass", 1)], "id string, code string, start_line long")
    assert rows(g.call_sites(used, code, nodes)) == [(IDS["bake"], IDS["knead"], 11, "knead(1)"), (IDS["bake"], IDS["knead"], 13, "again = knead(2); knead(3)")]
    assert g.call_sites(used, code, nodes, per_user=1).count() == 1
    files = spark.createDataFrame([("a.py", "1\n2\n3")], "path string, text string")
    assert rows(tools.code_window(files, "a.py", 2, 9)) == [("a.py", 2, "2", False), ("a.py", 3, "3", False)]
    old = spark.createDataFrame([("a.py", "0" * 64)], "path string, hash string")
    assert rows(tools.code_window(files, "a.py", 1, 1, old)) == [("a.py", 1, "1", True)]


def test_tours_are_checked(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    stops = lambda *ids: spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "place long, id string")
    got, notes = tools.check_tour(stops("b", "x", "a", "b"), known)
    assert rows(got) == [(1, "b"), (2, "a")] and notes == ["1 stops name no candidate", "1 stops are repeated"]
    got, notes = tools.check_tour(stops("y"), known, 2)
    assert rows(got) == [(1, "a"), (2, "b")] and notes[-1].startswith("no stop is left")
