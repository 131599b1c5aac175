import random
import zlib

import numpy as np
import pyarrow as pa

from weftgraph.llm import quality_nb as nb
from weftgraph.llm import wordhash as wh

from .helpers import docs, empty, prose, rows


def corpus(n=400):
    r, out, marks = random.Random(4), [], {}
    for i in range(n):
        t = prose(i, r.randint(20, 120), 60)
        kind = i % 8
        if kind == 0:
            t = " ".join(w + r.choice(("***", "%%%", "&&&")) for w in t.split())
        elif kind == 1:
            t = " ".join([t.split()[0]] * 60)
        out.append((i, t))
        marks[i] = int(kind > 1)
    return out, marks


def labels(spark, marks):
    return spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    pairs, marks = corpus()
    got = rows(nb.score(docs(spark, pairs + [(1000, None), (1001, ""), (None, "x y")]), labels(spark, marks)))
    assert len(got) == len(pairs) + 3
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 60 and sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_read(spark):
    pairs, marks = corpus(80)
    flipped = {i: (1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in marks.items()}
    a, b = ({r["doc_id"]: r["score"] for r in rows(nb.score(docs(spark, pairs), labels(spark, m)))} for m in (marks, flipped))
    assert a == b


def test_features_match_plain_python():
    texts = ["Ab ab AB x", "", "same same same", "é !! é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (_, (ids, at)), = nb._each(batch)
    words = [wh.Words(wh.LOWER[np.frombuffer(t.encode(), np.uint8)], np.array([0, len(t.encode())])) for t in texts]
    for k, w in enumerate(words):
        one = set((w.hashes(11) >> np.uint64(64 - nb.BITS)).tolist())
        mine = ids[at[k] : at[k + 1]].tolist()
        assert one <= set(mine) and mine == sorted(set(mine))
    assert len(ids[at[1] : at[2]]) == 0
    assert len(set(ids[at[2] : at[3]].tolist())) <= 1 + 1 + 1 + 2


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    r = np.random.default_rng(1)
    x = [np.sort(r.choice(12, 4, replace=False)).astype(np.int64) for _ in range(60)]
    y = np.array([int(v[0] < 3) ^ int(r.random() < 0.1) for v in x])
    ratio = nb.log_ratios(x, y)
    old, nb.EPOCHS, mix, nb.MIX = nb.EPOCHS, 400, nb.MIX, 0.0
    try:
        w, b = nb.fit_weights(x, y, ratio)
    finally:
        nb.EPOCHS, nb.MIX = old, mix
    cost = nb.C * len(y) / 2 / np.where(y == 1, (y == 1).sum(), (y == 0).sum())

    def primal(w, b):
        m = np.where(y == 1, 1, -1) * nb._margin(x, ratio, w, b)
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - m) ** 2).sum()

    best = primal(w, b)
    for _ in range(300):
        d = np.zeros_like(w)
        d[:12] = r.normal(size=12) * 0.02
        d[x[0]] += r.normal(size=4) * 0.02
        assert primal(w + d, b + r.normal() * 0.02) >= best - 1e-6


def test_one_class_none_and_empty(spark):
    some = docs(spark, [(1, "a b"), (2, None), (2, None)])
    got = rows(nb.score(some, labels(spark, {})))
    assert [round(r["score"], 6) for r in got] == [0.5] * 3
    assert all(r["score"] > 0.5 for r in rows(nb.score(some, labels(spark, {1: 1}))))
    assert rows(nb.score(empty(spark), labels(spark, {1: 1}))) == []


_MASK = 2**64 - 1


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * by & _MASK
    return x ^ (x >> 31)


def plain_features(text):
    """The features of a text, word by word in plain Python; only the hash of a single word is the library's."""
    raw = [w for w in (text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    own = [int(wh.Words(np.frombuffer(w.lower(), np.uint8), np.array([0, len(w)])).hashes(11)[0]) for w in raw]
    k = [int(x) for x in nb._K]
    out, shapes = set(own), []
    for i, w in enumerate(raw):
        tail = sum(w[-1 - j] << (8 * j) for j in range(min(3, len(w))))
        out.add(mixed((tail + k[1]) & _MASK))
        capital = lambda c: int(65 <= c <= 90)
        last = w[-1]
        mark = last if last < 128 and not 97 <= (last | 32) <= 122 else 0
        shapes.append(capital(w[0]) + 2 * capital(w[1] if len(w) > 1 else w[0]) + 4 * int(i > 0 and own[i] == own[i - 1]) + 8 * mark)
    for a, b, s, t in zip(own, own[1:], shapes, shapes[1:]):
        out.add(mixed((a * k[0] + b) & _MASK))
        out.add(mixed(((s << 11) + t + k[2]) & _MASK))
    return sorted({x >> (64 - nb.BITS) for x in out})


def test_scores_match_brute_force(spark, monkeypatch):
    """Every score again, feature by feature, from the model that the operator fitted."""
    pairs, marks = corpus(120)
    pairs += [(1000, None), (1001, ""), (1002, prose(3, 400_000)), (1003, "z" * 300_000 + " End."), (1004, "A b. C d!"), (1004, "A b. C d!")]  # texts of some megabytes, repeated rows
    source = docs(spark, pairs).repartition(3)
    model, ratio = nb.train(source, labels(spark, marks))
    got = {r["doc_id"]: r for r in rows(nb.score(source, labels(spark, marks)))}
    for d, text in pairs:
        x = plain_features(text)
        norm = max(sum(float(ratio[v]) ** 2 for v in x), 1e-12) ** 0.5
        margin = sum(float(model.weights[v]) for v in x) / norm + model.bias
        want = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
        assert abs(got[d]["score"] - want) < 1e-5, d


def test_a_tie_at_the_threshold_counts_as_good(monkeypatch):
    monkeypatch.setattr(nb.Model, "scores", lambda self, m: np.array([0.7, np.nextafter(0.7, 0), 0.7 + 1e-12])[: len(m)])

    class Shared:
        value = (nb.Model(np.zeros(1 << nb.BITS, np.float32), 0.0, 1.0, 0.0), np.zeros(1 << nb.BITS, np.float32))

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([False] * 3), pa.array(["a", "b", "c"])], names=["doc_id", "held_out", "text"])
    (out,) = nb._scored(Shared)([batch])
    assert out.column("predicted").to_pylist() == [1, 0, 1]
