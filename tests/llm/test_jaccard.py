import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftgraph.llm import jaccard as jc

from .helpers import docs, empty, prose, rows


def grams(t):
    w = (t or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(pairs):
    sets = {d: grams(t) for d, t in pairs}
    link = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                link[a].add(b)
                link[b].add(a)
    root = {}
    for a in ids:
        if a not in root:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = a
                    todo += link[x]
    return {a: (root[a], len(link[a])) for a in ids}


def corpus(n_near=25, edits=(0, 0.005, 0.01, 0.02, 0.05)):
    r = random.Random(3)
    out = [(i, prose(i, r.randint(3, 200))) for i in range(60)]
    nxt = 100
    for g in range(6):
        base = prose(500 + g, 150).split()
        for _ in range(n_near if g == 0 else 6):
            e = r.choice(edits)
            out.append((nxt, " ".join("e%d" % r.randint(0, 10**6) if r.random() < e else w for w in base)))
            nxt += 1
    out += [(900 + k, out[70][1]) for k in range(5)] + [(950, out[70][1].replace(" ", "\n")), (960, None), (961, ""), (962, None), (963, "a b"), (964, "a b"), (965, "a  b"), (966, "a b c d e"), (967, "z" * 50000), (968, prose(1, 20000)), (969, prose(1, 20000) + " x")]
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jc, "BLOCK", block)
    pairs = corpus()
    want = brute(pairs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(jc.links(docs(spark, pairs).repartition(4)))}
    assert got == want
    assert sum(n for _, n in want.values()) > 300


def test_nulls_repeats_and_empty(spark):
    pairs = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted(((r["doc_id"], r["exact_id"], r["class_id"], r["n_links"]) for r in rows(jc.links(docs(spark, pairs)))), key=str)
    assert got == sorted([(None, None, None, 0)] * 2 + [(1, 1, 1, 1)] * 2 + [(2, 1, 1, 1), (3, 3, 3, 0)], key=str)
    assert rows(jc.links(empty(spark))) == [] and rows(jc.clean(empty(spark))) == []


def test_clean_keeps_one_of_each_class(spark):
    pairs = corpus() + [(None, "n"), (5, corpus()[5][1])]
    want = brute([p for p in pairs if p[0] is not None])
    source = docs(spark, pairs)
    got = rows(jc.clean(source))
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(d for d, (c, _) in want.items() if c == d)
    assert sum(r["doc_id"] is None for r in got) == 1 and jc.clean(source).columns == source.columns


def test_pruning_bound():
    assert abs(jc.betainc_upper(0.5, 3, 3) - 0.5) < 1e-12
    assert abs(jc.betainc_upper(0.8, 1, 1) - 0.2) < 1e-12
    least = jc.least_matches()
    assert least == sorted(least) and all(m < 0.8 * (k + 1) * jc.STEP for k, m in enumerate(least))


def test_components(spark):
    r = random.Random(1)
    for n, m in ((30, 20), (40, 60), (60, 59)):
        edges = [(k, k + 1) for k in range(m)] if m == 59 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        label = list(range(n))
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {x["id"]: x["root"] for x in rows(jc.components(spark.createDataFrame(edges, "id long, other long")))}
        assert got == {k: label[k] for a, b in edges if a != b for k in (a, b)}


def test_minhash_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    s = jc.minhashes(jc.wh.mix(np.concatenate([a, b]) + np.uint64(1)), np.array([0, 1000, 2000]), jc._multipliers(500, 3))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_clean_tells_rows_apart_by_id_and_text(spark):
    a, b, c, d = (prose(700 + k, 40) for k in range(4))
    pairs = [(5, a), (5, b), (5, b), (1, a), (None, c), (None, c), (None, d), (None, b), (7, d + " " + c), (8, None), (8, c + " one")]
    got = sorted(((r["doc_id"], r["text"]) for r in rows(jc.clean(docs(spark, pairs).repartition(3)))), key=str)
    assert got == sorted([(1, a), (5, b), (None, d), (7, d + " " + c), (8, None), (8, c + " one")], key=str)


def test_clean_with_any_column_names_and_unlike_copies(spark):
    """Columns of the names used inside stay as they are; of equal id and text the row with the least other columns stays."""
    text = "one two three four five six seven"
    said = [(1, text, "b", "k1"), (1, text, "a", "k2"), (2, text, "c", "k3"), (None, "other words here", "d", "k4"), (None, "other words here", None, "k5")]
    made = spark.createDataFrame(said, "doc_id long, text string, __weft_key string, WEFT_key string").withColumn("weft_row", F.lit("r")).withColumn("weft_id", F.lit(3))
    got = jc.clean(made)
    assert got.columns == made.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, text, "a", "k2", "r", 3), (None, "other words here", "d", "k4", "r", 3)], key=str)
    only = spark.createDataFrame([(5, text, "x"), (6, "other words here", "y")], "doc_id long, text string, weft_stays string")
    assert sorted(map(tuple, jc.clean(only).collect())) == [(5, text, "x"), (6, "other words here", "y")]
