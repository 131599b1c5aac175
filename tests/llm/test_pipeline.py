"""Each stage against a brute-force version on a small table, then the whole."""

import random

import pytest

import corpus_pipeline
from weftgraph.llm import decontam, linerules, pieces, pii

from .helpers import docs, prose, rows
from .test_jaccard import brute as near
from .test_linerules import brute as base

ITEM = "Was st the thonen of in erntor er en therha onbleble athethndan and it and thhahaer inwhly erthble he"


def text(seed, n=20):
    return "\n".join(prose(seed * 100 + k, 12).capitalize() + "." for k in range(n))


def corpus():
    r = random.Random(1)
    out = [(i, text(i)) for i in range(12)]
    out += [(20, text(0)), (21, text(1).replace(".", " .", 1)), (22, " ".join(w for w in text(2).split(" ") if r.random() > 0.005)), (23, text(30) + "\n" + ITEM + "."), (24, "too short"), (25, None), (26, "a b c " * 50), (27, text(31) + "\nMail dbhcoh.37@mail4.example.com or call +1 (386) 555-3733 today please."), (28, text(32) + "\nAll rights reserved."), (29, "")]
    return out


@pytest.fixture
def folder(spark, tmp_path):
    docs(spark, corpus()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_and_run(spark, folder, tmp_path):
    spark.conf.set(pii.KEY_CONF, "k")
    names = ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names and corpus_pipeline.ORACLE_SQL is None
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = table.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{tmp_path}/out{k}")
        table = spark.read.parquet(f"{tmp_path}/out{k}")
        steps.append({r["doc_id"]: r for r in rows(table)})
        assert k == 4 or table.columns == columns
    given = dict(corpus())
    assert set(steps[0]) == {d for d, t in given.items() if not base(t)[-1]}
    assert "rights" not in steps[0][28]["text"] and steps[0][3]["text"] == given[3]
    want = near([(d, r["text"]) for d, r in steps[0].items()])
    assert set(steps[1]) == {d for d, (c, _) in want.items() if c == d} and {20, 21, 22}.isdisjoint(steps[1])
    assert set(steps[1]) - set(steps[2]) == {23}
    assert {d: r["text"] for d, r in steps[3].items()} == {d: pii.replace(r["text"], pii.find(r["text"], b"k")) for d, r in steps[2].items()}
    assert "dbhcoh.37" not in steps[3][27]["text"] and "555-3733" not in steps[3][27]["text"]
    library = pieces.pieces(pieces.model_path()).library
    assert {d: r["ids"] for d, r in steps[4].items()} == {d: library.encode(r["text"]) for d, r in steps[3].items()}
    got = rows(corpus_pipeline.run(spark, folder))
    assert sorted(map(str, got)) == sorted(map(str, steps[4].values()))
