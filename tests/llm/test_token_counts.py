import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import token_counts as tc

from .helpers import docs, empty, prose, rows

CASES = [None, "", " ", "Hello world's   end\n\n  x", "don't I'LL we've'd ' s", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext", prose(1, 3000), "x" * 20000, "日本語テキスト\u3000と　空白", "ñandú ªº ²³¼ ①Ⅷ", "\x00\x1c\x1d\x85\xa0\u2028 z", "e\u0301 ́a", "🙂🙃 ok", "\t\t\tif x:\n\t\treturn 1234567890", " " * 3000 + "a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tc.vocabulary_path())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_matches_library(spark, library):
    got = {r["doc_id"]: r for r in rows(tc.count_tokens(docs(spark, list(enumerate(CASES)) + [(None, "a b")])))}
    for i, text in enumerate(CASES):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((text or "").encode()), library(text)), i
        assert got[i]["over_limit"] == (library(text) > 1024)
    assert got[None]["n_tokens"] == 2


def test_every_character_class(library):
    c = tc.counter(tc.vocabulary_path())
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000] + [chr(i) for i in range(0xF900, 0x10000, 3)] + [chr(i) for i in range(0x10000, 0x20000, 97)]
    off = [x for x in chars if c.count([f"ab{x}c 1{x}2 .{x}. {x}{x}"]) != [library(f"ab{x}c 1{x}2 .{x}. {x}{x}")]]
    assert off == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    c = tc.counter(tc.vocabulary_path())
    assert c.count([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_proof_covers_most_of_the_vocabulary():
    c = tc.counter(tc.vocabulary_path())
    assert len(c.whole) > 45_000 and " the" in c.whole and c.whole[" the"] == 1


def test_forgetting_changes_nothing(monkeypatch):
    c = tc.Counter(tc.vocabulary_path())
    monkeypatch.setattr(tc, "REMEMBERED", 10)
    texts = [prose(k, 50) for k in range(20)]
    assert [c.count([t])[0] for t in texts] == tc.counter(tc.vocabulary_path()).count(texts)


def test_empty_table(spark):
    assert rows(tc.count_tokens(empty(spark))) == []


def test_long_texts_are_counted_bit_by_bit(spark, library, monkeypatch):
    c = tc.Counter(tc.vocabulary_path(), tc.prove(tc.vocabulary_path()))
    monkeypatch.setattr(tc, "AT_ONCE", 7)
    assert [c.count_long(t or "") for t in CASES] == [library(t) for t in CASES]
    monkeypatch.setattr(tc, "AT_ONCE", 1 << 16)
    long = prose(5, 350_000)  # some megabytes
    texts = [long, "short", "y" * 2_000_000, long + "<|endoftext|> 日本 " + long[:1000]]
    got = {r["doc_id"]: r["n_tokens"] for r in rows(tc.count_tokens(docs(spark, list(enumerate(texts)))))}
    assert got == {k: library(t) for k, t in enumerate(texts)}


def test_other_ways_to_cut_are_refused(tmp_path):
    import json

    with open(tc.vocabulary_path(), encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "t.json").write_text(json.dumps(said))
    with pytest.raises(ValueError, match="byte-level"):
        tc.Counter(str(tmp_path / "t.json"))
