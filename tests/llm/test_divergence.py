"""Source divergence against plain Python integers over every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from weftgraph.llm import divergence as dv

from .helpers import SCHEMA, empty

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=3, most=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [t.translate(low) for t in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, whole = {s: share(counts[lang, s]) for s in sources}, share(total)
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-far(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:most])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", "y", "z", "d", "k", "s") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def corpus(seed=1, n=150, sources=6):
    r = random.Random(seed)
    words = ["w" + "".join(r.choice("abcdé") for _ in range(r.randint(1, 3))) for _ in range(60)] + ["The", "tHE", "été", "ÉTÉ", "日本"]
    rows = [(" ".join(r.choice(words[: r.randint(2, 65)]) + r.choice(["", ",", "\n", "\x00", "7"]) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None]), r.choice([f"s{k}" for k in range(sources)] + [None])) for _ in range(n)]
    return rows + [("", "xx", "a"), ("one", "xx", "b"), (None, "yy", "a"), ("12 !", "en", "no words")] + [("copy of one text", "en", "s1")] * 40


def compared(spark, rows, **options):
    found = dv.audit(table(spark, rows), **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, **options)


def test_every_pair_and_term(spark):
    compared(spark, corpus())


def test_few_ranks_and_no_kept_terms(spark):
    compared(spark, corpus(2), least=4, most=3)
    compared(spark, corpus(3, 20), least=1000)
    assert dv.audit(empty(spark)).collect() == []


def test_small_blocks(spark, monkeypatch):
    """Tasks that may hold few rows sum and hand on many times; long texts are taken in pieces."""
    for name in ("ROWS", "PAIRS", "PIECE"):
        monkeypatch.setattr(dv, name, 7)
    t = table(spark, corpus(4, 80))
    counted = Counter()
    for b in dv._counted(t.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text").toArrow().to_batches()):
        for r in b.to_pylist():
            counted[r["lang"], r["source"], r["term"], "c"] += r["c"]
            counted[r["lang"], r["source"], r["term"], "d"] += r["d"]
    whole = {(r.lang, r.source, r.term, k): r[k] for r in dv.term_counts(t).collect() for k in "cd"}
    assert dict(counted) == whole
    kept = t.sparkSession.createDataFrame([("en", f"s{s}", term, (s * 7 + k) % 5 + 1, 40, 50, 300, 9) for k, term in enumerate("abc") for s in range(12)], "lang string, source string, term string, c long, total long, n long, nl long, v long").toArrow()
    added = Counter()
    for b in dv._compared(2)(kept.to_batches()):
        for r in b.to_pylist():
            if r["part"] == "pair":
                added[r["source"], r["item"]] += int(r["value"])
    monkeypatch.undo()
    assert added == {(r["source"], r["item"]): int(r["value"]) for b in dv._compared(2)(kept.to_batches()) for r in b.to_pylist() if r["part"] == "pair"}


def test_too_many_groups_to_be_sent(spark, monkeypatch):
    """The way without a broadcast deals the shards once more."""
    monkeypatch.setattr(dv, "sent", lambda df: df)
    compared(spark, corpus(5))


def test_pieces_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(dv, "PIECE", 4)
    text = b"abcdefghij kl mnopqrs t"
    borders, row = dv._pieces(np.array([0, len(text), len(text)]), np.frombuffer(text, np.uint8))
    parts = [text[a:b].decode() for a, b in zip(borders[:-1], borders[1:])]
    assert "".join(parts) == text.decode() and row.tolist() == [0] * (len(parts) - 1) + [1]
    assert [t for p in parts for t in TERM.findall(p)] == TERM.findall(text.decode())
