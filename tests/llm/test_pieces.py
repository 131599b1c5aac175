import random
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import pieces as pc

from .helpers import docs, empty, prose, rows


@pytest.fixture(scope="module")
def model():
    return pc.pieces(pc.model_path())


def scanned(p, text, chunk):
    """The scan on one text, without Spark."""
    t = pc.normal_form(text)
    if not t:
        return []
    cuts = [(lo, min(lo + chunk, len(t))) for lo in range(0, len(t), chunk)]
    base = lambda lo: max(0, lo - p.longest)
    part = lambda lo, hi: t[base(lo) : hi + p.longest]
    matrices = [p.transfer(part(lo, hi), base(lo), lo, hi, len(t)) for lo, hi in cuts]
    ends = {s: w for s, w in pc.product(matrices)[pc.START].items() if s[1] == len(t)}
    states = pc.path(matrices, pc.START, max(ends, key=ends.__getitem__))
    out = []
    for (lo, hi), a, b in zip(cuts, states, states[1:]):
        out += [i for s, e in p.backtrace(part(lo, hi), base(lo), a, b, hi) for i in p.id_list(t[s:e])]
    return out


TEXTS = [
    "Hello world", "a", " ", "   leading and   inner  runs      ", "x" * 300, "thereinthethereoftheionstationinternationalization" * 8, "日本語の文章とEnglish混在 🙂🙃", "tabs\tand\nlines\r\n\x00 end", "▁literal ▁ mark", "=" * 70 + "-" * 33, prose(3, 400), "".join(random.Random(1).choice("abcdeth ") for _ in range(2000)),
    " " * 100, "Ééàü naïve façade Straße", "1234567890" * 20,
]


@pytest.mark.parametrize("chunk", [1, 3, 7, 16, 50, 1000])
def test_scan_equals_library(model, chunk):
    for t in TEXTS:
        assert scanned(model, t, chunk) == model.library.encode(t) == np.frombuffer(model.encode_whole([t])[0][0], "<i4").tolist(), (chunk, t[:40])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehinorst .,\nTéß▁日🙂0"), max_size=80), st.integers(1, 20))
def test_any_text(text, chunk):
    p = pc.pieces(pc.model_path())
    assert scanned(p, text, chunk) == p.library.encode(text) == np.frombuffer(p.encode_whole([text])[0][0], "<i4").tolist()


def test_combining_is_associative(model):
    t = pc.normal_form("internationalization of thethethe " * 6)
    cuts = [(lo, min(lo + 9, len(t))) for lo in range(0, len(t), 9)]
    m = [model.transfer(t, 0, lo, hi, len(t)) for lo, hi in cuts]
    left = pc.combine(pc.combine(m[0], m[1]), m[2])
    right = pc.combine(m[0], pc.combine(m[1], m[2]))
    assert left == right and any(left.values())
    whole = pc.product(m)
    for fan in (2, 3, 5):  # a tree of any shape gives the same
        level = m
        while len(level) > 1:
            level = [pc.product(level[k : k + fan]) for k in range(0, len(level), fan)]
        assert level[0] == whole
    ends = {s: w for s, w in whole[pc.START].items() if s[1] == len(t)}
    assert list(ends.values()) == [0]


def test_table(spark, model):
    pairs = list(enumerate(TEXTS)) + [(None, None), (100, ""), (101, prose(9, 3000)), (101, prose(9, 3000)), (None, prose(8, 900)), (102, "y" * 20000)]
    small = docs(spark, pairs).repartition(3)
    want = sorted((-1 if d is None else d, tuple(model.library.encode(t or ""))) for d, t in pairs)
    got = rows(pc.encode(small, giant=500, chunk=128, fan=3))  # a tree of several levels
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["exact"] for r in got) and max(r["chunks"] for r in got) > 100
    whole = rows(pc.encode(small))
    assert sorted(map(str, ((r["doc_id"], r["ids"]) for r in whole))) == sorted(map(str, ((r["doc_id"], r["ids"]) for r in got)))
    text = {r["doc_id"]: r["text"] for r in rows(pc.decode(pc.encode(small, giant=500, chunk=128)))}
    assert all(text[d] == t.replace("▁", " ") for d, t in enumerate(TEXTS))
    d = {r["doc_id"]: r for r in rows(pc.digest(small, giant=500, chunk=128))}
    ids = model.library.encode(TEXTS[10])
    assert d[10]["n_pieces"] == len(ids) and d[10]["ids_sha256"] == sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    assert rows(pc.digest(empty(spark))) == []


def test_giant_documents_at_the_real_threshold(spark, model):
    long = " ".join(f"{w}{k % 7}" for k, w in enumerate(prose(5, 400_000).split()))  # some megabytes
    pairs = [(1, long), (2, long[: pc.GIANT]), (3, long[: pc.GIANT + 1]), (4, "z" * (pc.GIANT + 50)), (5, long)]
    got = {r["doc_id"]: r for r in rows(pc.digest(docs(spark, pairs)))}
    for d, t in pairs:
        ids = model.library.encode(t)
        assert (got[d]["n_pieces"], got[d]["ids_sha256"]) == (len(ids), sha256(np.array(ids, "<i4").tobytes()).hexdigest()) and got[d]["exact"]
    assert got[2]["chunks"] == 1 and got[3]["chunks"] == 9 and got[1]["chunks"] > 200


def test_memory_is_bounded_and_forgets_nothing_in_use(model, monkeypatch):
    p = pc.Pieces(pc.model_path())
    monkeypatch.setattr(pc, "REMEMBERED", 50)
    for seed in range(6):
        texts = [prose(seed, 60, 300) + " \x00 ▁x  é日", prose(0, 40, 300), ""]
        raw, exact = p.encode_whole(texts)
        assert [np.frombuffer(x, "<i4").tolist() for x in raw] == [p.library.encode(t) for t in texts]
        assert exact == [p.library.decode(p.library.encode(t)) == t.replace("▁", " ") for t in texts]
        assert len(p.older) <= 200
