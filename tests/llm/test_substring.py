import random
import re
from collections import Counter
from hashlib import sha256

from weftgraph.llm import substring

from .helpers import docs, empty, prose, rows

W = 35


def brute(pairs):
    return sorted((d if d is not None else -1, *rest) for d, *rest in brute_any(pairs))


def brute_any(pairs):
    seen = Counter()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in pairs]
    for w in split:
        seen.update(tuple(w[i : i + W]) for i in range(len(w) - W + 1))
    out = []
    for (d, _), w in zip(pairs, split):
        gone = set()
        for i in range(len(w) - W + 1):
            if seen[tuple(w[i : i + W])] > 1:
                gone.update(range(i, i + W))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return out


def brute_of(pairs, first):
    """``brute`` over all, the rows from ``first`` on."""
    tagged = [((d, k), t) for k, (d, t) in enumerate(pairs)]
    kept = {x[0] for x in tagged[first:]}
    return sorted((d[0] if d[0] is not None else -1, *rest) for d, *rest in brute_any(tagged) if d in kept)


def got(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(df))


def corpus():
    r = random.Random(5)
    base = [prose(i, 300) for i in range(6)]
    passage, short = prose(77, 60), prose(78, 34)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0][:900] + " changed " + base[0][900:]), (22, prose(9, 50) + " " + passage + " " + prose(10, 50)), (23, passage), (24, prose(11, 20) + "\n" + passage)]
    out += [(25, short), (26, short + " x"), (27, "a b c " * 60), (28, " ".join(["tick"] * 80)), (29, None), (30, ""), (31, " \t\n"), (32, prose(12, 34)), (None, base[1]), (33, prose(13, 35)), (33, prose(13, 35))]
    out += [(40 + k, " ".join(w if r.random() > 0.01 else "edit%d" % k for w in base[2].split())) for k in range(12)]
    out += [(60, " ".join("p%d" % (i % 20) for i in range(90))), (61, " ".join("q%d" % (i % 30) for i in range(66))), (62, "é" * 3000 + " " + passage + " nbsp joined"), (63, " ".join("z%d" % (i % 35) for i in range(69))), (64, " ".join("z%d" % (i % 35) for i in range(70)))]
    return out


def test_matches_brute_force(spark):
    pairs = corpus()
    assert got(substring.dedup(docs(spark, pairs).repartition(5))) == brute(pairs)


def test_one_batch_or_many(spark, monkeypatch):
    pairs = corpus()[:20]
    for n, hot in ((1, 1000), (3, 2)):
        monkeypatch.setattr(substring, "HOT", hot)
        monkeypatch.setattr(substring, "HOT_ROWS", hot)
        assert got(substring.dedup(docs(spark, pairs), batches=n)) == brute(pairs)


def test_incremental_batches_against_history(spark, tmp_path):
    """Each batch is judged against all before it and itself; the index is opened again from its folder every time."""
    pairs = corpus()
    history, levels = [], []
    for k in range(0, len(pairs), 5):
        batch = pairs[k : k + 5]
        index = substring.FingerprintIndex(spark, str(tmp_path / "index"), fan=2)
        before = set(index.segments)
        found = got(substring.dedup(docs(spark, batch), index=index, batch=str(k)))
        history += batch
        want = [x for x in brute_of(history, len(history) - len(batch))]
        assert found == want
        assert len(index.segments) == len(before) + 1
        levels.append(index.counted())
    assert all(n < 2 for x in levels for n in x.values()) and max(max(x) for x in levels) >= 2  # compacted, level by level
    for name, *_ in index.runs:
        spark.sql(f"drop table {name}")  # as in another session
    again = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    assert again.runs == index.runs and sum(r.n for r in again._run(*again.runs[0][::2]).collect()) > 0
    assert got(substring.dedup(docs(spark, [(900, pairs[0][1]), (901, "new " + prose(999, 60))]), index=again, batch="last")) == brute_of(history + [(900, pairs[0][1]), (901, "new " + prose(999, 60))], len(history))
    again.drop()


def test_a_job_that_dies_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    passage = prose(1, 80)
    index = substring.FingerprintIndex(spark, str(tmp_path / "i"))
    substring.dedup(docs(spark, [(1, passage)]), index=index, batch="1").collect()

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(substring, "verified", dies)
    bad = substring.FingerprintIndex(spark, str(tmp_path / "i"))
    try:
        substring.dedup(docs(spark, [(2, passage + " x")]), index=bad, batch="2")
    except RuntimeError:
        pass
    monkeypatch.undo()
    again = substring.FingerprintIndex(spark, str(tmp_path / "i"))
    assert (again.runs, again.segments) == (index.runs, index.segments)
    assert [r[2] for r in got(substring.dedup(docs(spark, [(3, passage)]), index=again, batch="3"))] == [80]


def test_a_batch_given_twice_gets_the_same_rows_twice(spark, tmp_path):
    """A job that is run again after its commit is judged against what came before it, not against itself."""
    pairs = corpus()
    parts = [pairs[k : k + 8] for k in range(0, len(pairs), 8)]
    path, first = str(tmp_path / "i"), []
    for k, part in enumerate(parts):
        first.append(got(substring.dedup(docs(spark, part), index=substring.FingerprintIndex(spark, path, fan=2), batch=f"b{k}")))
        assert first[k] == brute_of([x for p in parts[: k + 1] for x in p], sum(map(len, parts[:k])))
    files = len(substring.FingerprintIndex(spark, path).segments)
    for k in (len(parts) - 1, 0, 1):  # the last batch, and earlier ones
        assert got(substring.dedup(docs(spark, parts[k]), index=substring.FingerprintIndex(spark, path, fan=2), batch=f"b{k}")) == first[k]
    index = substring.FingerprintIndex(spark, path)
    assert len(index.segments) == files and index.batches == [f"b{k}" for k in range(len(parts))]
    one = docs(spark, [(1, prose(7001, 80))])
    for _ in range(2):
        assert [r[2] for r in got(substring.dedup(one, index=substring.FingerprintIndex(spark, path), batch="one"))] == [0]
    # other content under a known name takes its place
    assert [r[2] for r in got(substring.dedup(docs(spark, [(1, prose(7002, 80))]), index=substring.FingerprintIndex(spark, path), batch="one"))] == [0]
    assert [r[2] for r in got(substring.dedup(docs(spark, [(2, prose(7001, 80)), (3, prose(7002, 80))]), index=substring.FingerprintIndex(spark, path), batch="two"))] == [0, 80]
    try:
        substring.dedup(one, index=index)
    except ValueError:
        return
    raise AssertionError("a batch without a name")


def test_only_asked_entries_of_the_history_are_moved(spark, tmp_path):
    """A small batch moves the historical entries under its fingerprints and reads the text parts they are in, not the history."""
    path = str(tmp_path / "i")
    history = [(i, prose(i, 300)) for i in range(60)]
    substring.dedup(docs(spark, history), index=substring.FingerprintIndex(spark, path), batch="a").count()
    index = substring.FingerprintIndex(spark, path)
    moved = substring._marked(index.entries(index.segments), index.entries(index.segments).where("row_id = 7"), ("f",)).where("near")
    assert 0 < moved.count() < 0.1 * index.entries(index.segments).count()
    again = index.entries(index.segments).where("row_id = 7")
    texts = index.texts(again, index.segments)
    assert [r.row_id for r in texts.collect()] == [7]
    assert "PartitionFilters: [part" in texts._jdf.queryExecution().executedPlan().toString()
    assert [r[2] for r in got(substring.dedup(docs(spark, [(99, history[7][1])]), index=index, batch="b"))] == [300]


def test_a_very_long_text(spark):
    long = prose(3, 120_000)
    pairs = [(1, long), (2, long[: len(long) // 3]), (3, "one " * 100_000), (4, "x" * 3_000_000 + " " + long[-2000:])]
    assert got(substring.dedup(docs(spark, pairs))) == brute(pairs)


def test_empty_table(spark):
    assert rows(substring.dedup(empty(spark))) == []
