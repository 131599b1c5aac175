import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import gru_lm as lm

from .helpers import docs, empty, prose, rows


def tokens(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return w + [None]


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def corpus():
    out = [(i, prose(i % 5, 60 + i, 40).title() + " Ä ä") for i in range(60)]
    return out + [(100, None), (101, ""), (None, "Null id here"), (102, prose(1, 9000)), (103, "rare%d " % 5 * 40), (104, prose(2, 30)), (104, prose(2, 30)), (105, "x" * 60000)]


@pytest.mark.parametrize("table", [0, 30, 1 << 18])
def test_base_columns_match_brute_force(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "CHUNK", 4000)
    pairs = corpus()
    c = Counter(t for d, x in pairs if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(t := tokens(x)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for d, x in pairs)
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (50, table))
    got = rows(lm.score(docs(spark, pairs).repartition(3), words=50, updates=20))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert np.ptp([r["score"] for r in got if r["doc_id"] == 104]) < 1e-4  # single precision, batch by batch


def small(n=12, hidden=5, class_size=4):
    m = lm.Gru(np.arange(1, n + 1)[::-1].astype(float), hidden, class_size, 3)
    r = np.random.default_rng(0)
    for k, v in m.p.items():
        m.p[k] = v.astype(np.float64) + r.normal(size=v.shape) * 0.3
    return m


def test_gradient_is_right():
    m, r = small(), np.random.default_rng(2)
    prev, token, h = r.integers(0, 12, (6, 3)), r.integers(0, 12, (6, 3)), r.normal(size=(3, 5))
    prev[2, 1] = lm.END
    _, g, dx, _ = m.gradient(prev, token, h)
    gx = np.zeros_like(m.p["x"])
    np.add.at(gx, prev.ravel(), dx.reshape(-1, dx.shape[2]))
    g["x"] = gx
    for name, v in m.p.items():
        for at in [tuple(r.integers(0, s) for s in v.shape) for _ in range(12)]:
            old, e = v[at], 1e-6
            v[at] = old + e
            up = m.gradient(prev, token, h)[0]
            v[at] = old - e
            down = m.gradient(prev, token, h)[0]
            v[at] = old
            assert abs((up - down) / (2 * e) - g[name][at]) < 1e-6, name


def test_probabilities_sum_to_one():
    m = small()
    h = np.random.default_rng(1).normal(size=(1, 5))
    assert abs(sum(math.exp(m.log_probabilities(h, np.array([t]))[0]) for t in range(12)) - 1) < 1e-9


def test_score_is_the_step_by_step_sum_and_state_crosses_windows(monkeypatch):
    m = small()
    r = np.random.default_rng(5)
    documents = [np.append(r.integers(2, 12, n), lm.END) for n in (0, 1, 31, 32, 33, 100, 7)]
    flat, starts = np.concatenate(documents), np.append(0, np.cumsum([len(d) for d in documents]))
    want = []
    for d in documents:
        h, total, prev = np.zeros((1, 5)), 0.0, lm.END
        for t in d:
            h = m.steps(np.array([[prev]]), h)[0]
            total += m.log_probabilities(h, np.array([t]))[0]
            prev = t
        want.append(total)
    for span, group in ((32, 2048), (3, 2), (1000, 3)):
        monkeypatch.setattr(lm, "SPAN", span)
        monkeypatch.setattr(lm, "GROUP", group)
        assert np.allclose(m.score(flat, starts), want, atol=1e-3)


def test_training_beats_unigrams_on_a_pattern():
    r = np.random.default_rng(1)
    documents = [np.append((np.arange(40) + r.integers(0, 8)) % 8 + 2, lm.END) for _ in range(60)]
    m = lm.Gru(np.bincount(np.concatenate(documents), minlength=10).astype(float), 16, 4)
    losses = m.fit(documents, 300)
    assert np.mean(losses[-20:]) < 0.5 * losses[0]


def test_no_training_documents_and_empty_table(spark):
    ids = [d for d in range(100) if held(d)][:3]
    got = rows(lm.score(docs(spark, [(d, "a b") for d in ids])))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)] * 3
    assert rows(lm.score(empty(spark))) == []


def test_every_training_token_is_read_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_TOKENS", 5000)
    monkeypatch.setattr(lm, "PIECE", 700)
    pairs = [(d, x) for d, x in corpus() if not held(d)] + [(200, prose(7, 30000))]  # over 65,536 characters
    training = lm.texts(docs(spark, pairs).repartition(3))
    vocab = lm.vocabulary(lm.count_words(training), 50)
    assert lm.tasks(vocab.total, spark.sparkContext.defaultParallelism) > 1
    for updates in (1, 100):  # in the rounds alone, and read again in further ones
        model, read = lm.train(training, vocab, updates)
        assert read == vocab.total == sum(len(tokens(x)) for _, x in pairs)
        assert all(np.isfinite(v).all() for v in model.p.values())


def test_long_documents_are_learnt_from(spark):
    train, test = ([d for d in range(50) if held(d) == h][0] for h in (False, True))
    pattern = " ".join(f"word{k % 8}" for k in range(40000))
    for updates in (20, 500):
        got = {r["doc_id"]: r for r in rows(lm.score(docs(spark, [(train, pattern), (test, pattern[:6000])]), updates=updates))}
        assert got[test]["score"] > 0.5 * got[test]["base_score"]  # both are negative


def test_score_of_a_text_is_the_sum_over_its_tokens(spark, monkeypatch):
    """The whole score again, token by token, from the model that the operator fitted."""
    monkeypatch.setattr(lm, "TABLE", 20)
    pairs = corpus()
    source = docs(spark, pairs)
    training = lm.texts(source).where(lm.remainder(lm.MODULUS) != lm.HELD_OUT)
    vocab = lm.vocabulary(lm.count_words(training), 50, 20)
    model, _ = lm.train(training, vocab, 20)
    monkeypatch.setattr(lm, "train", lambda *_: (model, 0))
    got = {r["doc_id"]: r["score"] for r in rows(lm.score(source, words=50)) if r["doc_id"] is not None}
    c = Counter(t for d, x in pairs if not held(d) for t in tokens(x))
    frequent = sorted((w for w in c if w is not None), key=lambda w: (-c[w], lm._hashes(*lm.wh.buffers(lm.pa.array([w])))[0][0]))[:50]
    at = {w: k + 2 for k, w in enumerate(frequent)}
    n_other = sum(v for w, v in c.items() if w is not None and w not in at)
    v_other = sum(w is not None and w not in at for w in c)
    for d, text in pairs:
        if d is None:
            continue
        h, prev, total = np.zeros((1, model.hidden), np.float32), lm.END, 0.0
        for w in tokens(text):
            token = lm.END if w is None else at.get(w, lm.OTHER)
            h = model.steps(np.array([[prev]]), h)[0]
            total += model.log_probabilities(h, np.array([token]))[0] / math.log(10)
            if token == lm.OTHER:
                total += math.log10((c[w] + 1) / (n_other + v_other + 1))
            prev = token
        assert abs(got[d] - total) < 1e-3 * max(1, abs(total)), d


def test_tasks_follow_the_tokens_and_the_cores():
    """One rule for all sizes: no task without enough tokens, no core idle, more tasks as the tokens grow."""
    assert [lm.tasks(n, 8) for n in (1, 300_000, 3_400_000, 60_000_000)] == [1, 2, 8, 14]
    assert lm.tasks(10**12, 8) == 10**12 // lm.TASK_TOKENS


def test_one_task_or_several_learn_alike(spark, monkeypatch):
    """Held-out probability does not depend on how many tasks share the reading."""
    r = np.random.default_rng(2)
    train, test = [[d for d in range(400) if held(d) == h][:60] for h in (False, True)]
    words = lambda: " ".join(f"w{(k + r.integers(0, 2)) % 12}" for k in range(400))
    source = docs(spark, [(d, words()) for d in train + test[:10]])
    scores = []
    for least in (10**9, 3000):
        monkeypatch.setattr(lm, "LEAST_TOKENS", least)
        monkeypatch.setattr(lm, "PIECE", 500)
        got = [x for x in rows(lm.score(source, words=50)) if x["held_out"]]
        scores.append(sum(x["score"] for x in got) / sum(x["base_score"] for x in got))
    assert max(scores) < 0.6 and abs(scores[0] - scores[1]) < 0.1


def test_a_long_document_is_not_scored_window_by_window(monkeypatch):
    """What is left of the longest documents is put together before the softmax, whatever its place; the sums are those of the windows alone."""
    r = np.random.default_rng(4)
    model = lm.Gru(np.arange(200, 0, -1).astype(float), hidden=8, class_size=16)
    length = np.array([3, 40 * lm.SPAN + 5, 1, 70])
    starts = np.concatenate([[0], np.cumsum(length)])
    tokens = r.integers(0, 200, starts[-1])
    tokens[starts[1:] - 1] = lm.END
    sizes, plain = [], lm.Gru.log_probabilities
    monkeypatch.setattr(lm.Gru, "log_probabilities", lambda self, h, token: sizes.append(len(token)) or plain(self, h, token))
    found = model.score(tokens, starts)
    assert len(sizes) == 1 and sizes[0] == len(tokens)
    alone = [model.score(tokens[a:b], np.array([0, b - a]))[0] for a, b in zip(starts, starts[1:])]
    assert np.allclose(found, alone, rtol=1e-5)


def test_lanes_of_a_score_stay_full(monkeypatch):
    """Documents of unlike length are read one after another in lanes of like length: next to no step for a few lanes alone, none past an end."""
    r = np.random.default_rng(6)
    model = lm.Gru(np.arange(200, 0, -1).astype(float), hidden=8, class_size=16)
    length = np.append(r.integers(1, 300, 3000), 2500)
    starts = np.concatenate([[0], np.cumsum(length)])
    tokens = r.integers(2, 200, starts[-1])
    tokens[starts[1:] - 1] = lm.END
    taken, plain = [], lm.Gru.steps
    monkeypatch.setattr(lm.Gru, "steps", lambda self, prev, h: taken.append(prev.shape) or plain(self, prev, h))
    found = model.score(tokens, starts)
    assert sum(t * n for t, n in taken) < 1.02 * len(tokens)
    assert sum(t for t, _ in taken) < 1.1 * max(2500, len(tokens) / lm.SIDE)
    alone = [model.score(tokens[a:b], np.array([0, b - a]))[0] for a, b in zip(starts[:40], starts[1:41])]
    assert np.allclose(found[:40], alone, rtol=1e-5)


def test_words_are_found_by_their_low_bits(monkeypatch):
    """As a search would find them, also where several words of the model share a slot."""
    monkeypatch.setattr(lm, "SLOTS", 64, raising=False)
    r = np.random.default_rng(7)
    words = np.unique(r.integers(-(2**63), 2**63 - 1, 100))
    r.shuffle(words)
    vocab = lm.Vocabulary(words, np.arange(len(words), 0, -1), 1, 9999, 200, 60)
    assert len(vocab.slot) == 64 and (vocab.slot < 0).any()
    asked = np.append(words, r.integers(-(2**63), 2**63 - 1, 500))
    place = {h: k + 2 for k, h in enumerate(words[:60].tolist())}
    assert vocab.tokens(asked).tolist() == [place.get(h, lm.OTHER) for h in asked.tolist()]
    assert lm.Vocabulary(words[:0], words[:0], 1, 1, 1).tokens(asked).tolist() == [lm.OTHER] * len(asked)


def test_sums_of_rows_by_key():
    r = np.random.default_rng(8)
    for n in (1, 5, 3000):
        key, values = r.zipf(1.3, n) % 500, r.normal(size=(n, 6))
        keys, sums = lm._sums(np.stack([values[:, :2], values[:, 2:4], values[:, 4:]]), key)
        want = np.zeros((500, 6))
        np.add.at(want, key, values)
        assert sorted(keys.tolist()) == np.unique(key).tolist() and np.allclose(sums, want[keys])
