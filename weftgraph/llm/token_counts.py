"""Token counts by the whole-token shortcut.

A byte-level BPE first cuts a text into pre-tokens and then merges inside each.
For every vocabulary string it is proved once, on the driver and before any text
is read, whether it is one pre-token and encodes alone as exactly one token; the
proved strings, at most the vocabulary, are sent to the tasks, where such
pre-tokens count one by a dictionary look-up. Only the other pre-tokens are
merged, each distinct one once while it is remembered. A long text is cut into
pre-tokens bit by bit, so that its list of them never exists.

Special strings inside a text are one token each, as the tokenizer's default
has it, and cut the text. Defined results: null and empty texts have 0 tokens;
null ids and repeated rows are kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
REMEMBERED = 150_000  # distinct pre-tokens with more than one token, in each of two generations of a worker's memory
LONG, AT_ONCE = 1 << 20, 1 << 16  # characters from which on a text is cut bit by bit; pre-tokens in a bit

#: fixed value: the pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same where a text has only these characters, for the faster engine
_LETTER, _USUAL = "A-Za-zÀ-ÖØ-öø-ÿ", r"[^\n\r\t\x20-\x7eÀ-ÖØ-öø-ÿ]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts the tokens of texts as the tokenizer in the file at ``path`` gives them."""

    def __init__(self, path: str, whole: list[str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f).get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path} doesn't cut texts by the pattern of byte-level BPE")
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.any = regex.compile(PATTERN)
        self.usual = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
        self.unusual = re.compile(_USUAL).search
        self.whole = dict.fromkeys(self.proved() if whole is None else whole, 1)
        self.counts = dict(self.whole)
        self.older: dict[str, int] = {}  # the generation before; what is asked for again moves to the new one

    def proved(self) -> list[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        decode = self.tokenizer.decoder.decode
        strings = [(t, decode([t])) for t in self.tokenizer.get_vocab(with_added_tokens=False)]
        strings = [(t, s) for t, s in strings if s and "�" not in s and self.any.findall(s) == [s] and not (self.special and self.special.search(s))]
        encoded = self.tokenizer.encode_batch([s for _, s in strings], add_special_tokens=False)
        return [s for (t, s), e in zip(strings, encoded) if e.tokens == [t]]

    def parts(self, text: str) -> tuple[list[str], int]:
        """A text between its special strings, and how many these are."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return parts, len(parts) - 1
        return [text], 0

    def pattern(self, part: str):
        return self.any if self.unusual(part) else self.usual

    def learn(self, asked: set[str]) -> None:
        """Have the counts of all that is asked for."""
        if len(self.counts) + len(asked.difference(self.counts)) > len(self.whole) + REMEMBERED and len(self.counts) > len(self.whole):
            self.counts, self.older = dict(self.whole), self.counts
        new = asked.difference(self.counts)
        again = new.intersection(self.older)
        self.counts.update(zip(again, map(self.older.__getitem__, again)))
        rest = list(new.difference(again))
        for i in range(0, len(rest), 5000):
            some = rest[i : i + 5000]
            self.counts.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))

    def count_long(self, text: str) -> int:
        parts, total = self.parts(text)
        for part in parts:
            found = (m[0] for m in self.pattern(part).finditer(part))
            while some := list(islice(found, AT_ONCE)):
                self.learn(set(some))
                total += sum(map(self.counts.__getitem__, some))
        return total

    def count(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of short texts."""
        cut = []
        for t in texts:
            parts, n = self.parts(t)
            cut.append(([x for part in parts for x in self.pattern(part).findall(part)], n))
        self.learn(set().union(*(p for p, _ in cut)))
        of = self.counts.__getitem__
        return [sum(map(of, p)) + n for p, n in cut]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


@lru_cache(2)
def prove(path: str) -> tuple[str, ...]:
    """The whole-token strings of the vocabulary."""
    return tuple(Counter(path).whole)


_made: dict[str, Counter] = {}


def _rows(path: str, limit: int, shared):
    def run(batches):
        if path not in _made:  # one for each worker
            _made[path] = Counter(path, shared.value)
        made = _made[path]
        for batch in batches:
            column, counts, sizes = batch.column("text"), [], []
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at < batch.num_rows and size < LONG:
                    part.append(column[at].as_py())
                    size += len(part[-1])
                    at += 1
                long = part.pop() if len(part[-1]) >= LONG else None
                counts += made.count(part)
                sizes += [len(t.encode()) for t in part]
                if long is not None:
                    counts.append(made.count_long(long))
                    sizes.append(len(long.encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. ``path`` is the tokenizer file, on every executor."""
    path = path or vocabulary_path()
    shared = docs.sparkSession.sparkContext.broadcast(prove(path))  # at most the vocabulary
    return texts(docs).mapInArrow(_rows(path, limit, shared), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
