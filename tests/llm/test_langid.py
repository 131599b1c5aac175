"""Language identification: sets and kernels against plain Python, the fit against the normal equations, held-out accuracy, edges."""

import random

import numpy as np
import pyarrow as pa

from weftgraph.llm import langid
from weftgraph.llm import wordhash as wh

from .helpers import SCHEMA, docs, empty, rows

WORDS = {"aa": "the and with from that house river small".split(), "bb": "der und mit von dass haus fluss klein grün".split(), "cc": "le et avec de que maison fleuve petit été".split()}


def corpus(spark, n=120, extra=()):
    r = random.Random(4)
    out = [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 40))), lang) for i, lang in ((i, r.choice(list(WORDS))) for i in range(n))]
    return out + list(extra), spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", "z", "d", "k", "s") for i, t, lang in out + list(extra)], SCHEMA)


def plain_set(text):
    s = [0, *(int(langid.CLASS[b]) for b in text.encode()), 0]
    n = langid.SYMBOLS
    codes = lambda k: {sum(v * n ** (k - 1 - j) for j, v in enumerate(s[i : i + k])) + langid.BASES[k - 1] for i in range(len(s) - k + 1)}
    return codes(1) | codes(2) | codes(3)


def test_sets_are_those_of_plain_python():
    texts = ["", "a", "Ab", "été là!", "日本語 text", "  x\n\ty  ", "a" * 700]
    buf, offs = wh.buffers(pa.array(texts))
    got = [set() for _ in texts]
    for row, code in langid.sequences(buf, offs):
        for r, c in zip(row.tolist(), code.tolist()):
            got[r].add(c)
    assert got == [plain_set(t) for t in texts]
    index = langid.Index(np.array(sorted(plain_set("été là!"))))
    assert [int(v) for v in index.flags(buf, offs).sum(axis=1)] == [len(plain_set(t) & plain_set("été là!")) for t in texts]


def test_outputs_are_kernel_values_times_landmark_weights(spark):
    """The product that is formed once equals the kernel with every landmark, computed on sets."""
    made, table = corpus(spark)
    chosen = langid.training_texts(table, 60).collect()
    sets = [plain_set(r.text) for r in chosen]
    union = sorted(set().union(*sets))
    flags = np.array([[c in s for c in union] for s in sets])
    bits, y = np.packbits(flags, axis=1), np.array([list(WORDS).index(r.lang) for r in chosen])
    marks = langid._unit(flags[:30])
    k = langid.kernel(bits, marks, len(union))
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets[:30]] for a in sets]
    assert np.allclose(k, want, atol=1e-5)
    weights, bias, slope = langid.solve(k, k[:30], y, 3)
    model = langid.Model(np.array(union), list(WORDS), (marks.T @ weights).astype(np.float32), bias, slope)
    assert np.allclose(model.outputs(flags), k @ weights + bias, atol=1e-3)


def test_ridge_solves_its_normal_equations():
    r = np.random.default_rng(1)
    x, t, w = np.hstack([r.normal(size=(50, 5)), np.ones((50, 1))]), r.normal(size=(50, 2)), r.random(50)
    got = langid.ridge(x, t, w, 0.7)
    gradient = x.T @ ((x @ got - t) * w[:, None]) + np.diag([0.7] * 5 + [0]) @ got
    assert np.abs(gradient).max() < 1e-6


def test_held_out_texts_get_their_language(spark):
    made, table = corpus(spark, 200)
    found = {r["doc_id"]: r for r in rows(langid.identify(table, 90, 45))}
    held = [(i, lang) for i, _, lang in made if found[i]["held_out"]]
    assert held and all(found[i]["lang_pred"] == lang for i, lang in held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_only_the_fold_and_the_texts_are_learnt_from(spark):
    """Labels of held-out rows, sources and ids change nothing."""
    from zlib import crc32

    made, table = corpus(spark)
    other = [(i, t, lang if crc32(str(i).encode()) % 3 != 1 else "zz") for i, t, lang in made]
    changed = spark.createDataFrame([(i, t, lang, "other", 9, "", "", "", "", "", "") for i, t, lang in other], SCHEMA)
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in rows(df))
    assert key(langid.identify(table)) == key(langid.identify(changed))


def test_awkward_rows(spark):
    long = " ".join(WORDS["bb"] * 20000)
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, "日本", None), (1004, long, None), (None, "the house", "aa"), (7, "le fleuve", None), (7, "le fleuve", None)]
    made, table = corpus(spark, extra=extra)
    found = rows(langid.identify(table))
    assert len(found) == len(made)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003][0]["lang_pred"] in WORDS and by[1004][0]["lang_pred"] == "bb" and by[None][0]["lang_pred"] == "aa"
    assert sum(r["lang_pred"] == "cc" for r in by[7]) >= 2


def test_nothing_or_one_language_to_learn(spark):
    assert rows(langid.identify(empty(spark))) == []
    unlabelled = spark.createDataFrame([(i, "the house", None, "s", 1, "", "", "", "", "", "") for i in range(9)], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in rows(langid.identify(unlabelled))} == {("und", 0.0)}
    assert {(r["lang_pred"], r["score"]) for r in rows(langid.identify(docs(spark, [(i, f"house {i}") for i in range(9)])))} == {("en", 1.0)}


def test_copies_count_once_in_the_sample(spark):
    """A third of all rows is one text; the sample still holds every distinct text."""
    made, table = corpus(spark, 60, [(2000 + i, "the and with", "aa") for i in range(40)])
    texts = [r.text for r in langid.training_texts(table, 4096).collect()]
    assert len(texts) == len(set(texts)) and "the and with" in texts
