"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model is a BPE, not a unigram model, so the best segmentation is the one
that the merges give. It can still be found as a path: with merges ranked by
the joined piece, a sequence of pieces is the encoding of its text exactly if
each two neighbours are the encoding of theirs, and there is one such sequence.
So a step through the lattice of pieces weighs 0 where the neighbours are
compatible and minus infinity (no entry) where they aren't; a path of weight 0
is the encoding.

A giant document (over ``GIANT`` characters) is split into chunks of ``CHUNK``.
The state at a border is the piece that starts before it and ends at or after
it. A chunk alone yields the transfer matrix between the few possible states at
its two borders (max-plus, sparse: state in, state out, weight). Matrices are
combined associatively in a tree: each task joins at most ``FAN`` neighbours
into one matrix, level by level up to the whole document; on the way down each
node of the tree, given the states at its two ends, names those at the borders
of its children. Each chunk is then backtraced independently between its two
states.

All other documents are one chunk. No piece holds a blank after another
character, so a blank (or run of blanks) with the characters up to the next one
is encoded by itself; the library encodes each distinct one once while it is
remembered, many in one call, and what it gives is decoded again to see that
nothing was lost.

Decoding inverts encoding but for U+2581, which the model reads as a blank.
Defined results: null and empty texts have no pieces; null ids and repeated
rows are kept; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed

MODEL = "piece_bpe_32k.model"
GIANT, CHUNK, FAN = 65_536, 8_192, 16
BLANK = "▁"
REMEMBERED, AT_ONCE = 80_000, 256  # distinct words in each of two generations of a worker's memory; words in one call


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_WORD = re.compile(f"{BLANK}+[^{BLANK}]*").findall
State = tuple[int, int]  # start and end of a piece, in characters of the document
Matrix = dict[State, dict[State, int]]
START: State = (-1, 0)


class Pieces:
    """The vocabulary and its merges."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in normal}
        self.rank = {p: -m.get_score(i) for p, i in self.ids.items()}
        self.unknown = m.unk_id()
        byte = [m.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.bytes = byte if all(m.is_byte(k) for k in byte) else None
        self.longest = max(map(len, self.ids))
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[:2], set()).add(len(p))
        self.lengths = {k: sorted(v - {1}) for k, v in lengths.items()}
        self.fits = lru_cache(1 << 17)(self._fits)
        self.alone = lru_cache(1 << 16)(lambda p: len(p) == 1 or self.merge(p) == [p])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is asked for again moves to the new one
        self.lost: set[str] = set()  # words that decoding doesn't give back
        self.begins = np.array([m.id_to_piece(i).startswith(BLANK) for i in range(n)])

    def merge(self, text: str) -> list[str]:
        """The encoding of a short string, by its merges."""
        s = list(text)
        while True:
            best = min(((r, i) for i in range(len(s) - 1) if (r := self.rank.get(s[i] + s[i + 1])) is not None), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    def _fits(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def at(self, text: str, i: int) -> list[str]:
        """The pieces that may start at text[i]; a character outside the vocabulary stands alone."""
        out = [text[i]]
        for n in self.lengths.get(text[i : i + 2], ()):
            if (p := text[i : i + n]) in self.ids and len(p) == n:
                out.append(p)
        return out

    def forward(self, text: str, base: int, state: State, stop: int, like: dict[int, State] | None = None) -> dict[int, State]:
        """last[e]: the one piece that ends at e on a valid path from ``state``; paths go on from ends before ``stop``.

        text[0] is character ``base`` of the document. ``like``: another such table; once both agree for
        long enough the rest is its.
        """
        last, agreed = {state[1]: state}, 0
        for e in range(state[1], stop):
            before = last.get(e)
            if before is None:
                agreed = agreed + 1 if like is not None and e not in like else 0
                continue
            if like is not None:
                agreed = agreed + 1 if like.get(e) == before else 0
                if agreed > self.longest and e - self.longest > state[1]:
                    last.update((k, v) for k, v in like.items() if k > e)
                    return last
            prior = text[before[0] - base : e - base] if before != START else None
            for p in self.at(text, e - base):
                if self.fits(prior, p) if prior is not None else self.alone(p):
                    last[e + len(p)] = (e, e + len(p))
        return last

    def states(self, text: str, base: int, border: int, end: int) -> list[State]:
        """Every piece that could lie at a border: starts before it, ends at or after it."""
        out = []
        for s in range(max(base, border - self.longest), border):
            out += [(s, s + len(p)) for p in self.at(text, s - base) if border <= s + len(p) <= end]
        return out

    def transfer(self, text: str, base: int, lo: int, hi: int, end: int) -> Matrix:
        """The transfer matrix of characters lo to hi; text reaches ``longest`` beyond both borders, as far as there is any."""
        out: Matrix = {}
        like = None
        for state in [START] if lo == 0 else self.states(text, base, lo, end):
            if state[1] > hi:  # one piece covers the whole chunk
                out[state] = {state: 0}
                continue
            last = self.forward(text, base, state, hi, like)
            like = like or last
            row = {}
            for e, s in last.items():
                if e >= hi and s[0] < hi:
                    row[s] = 0
            out[state] = row
        return out

    def backtrace(self, text: str, base: int, before: State, after: State, hi: int) -> list[State]:
        """The pieces between two border states, ``after`` itself included."""
        out, last = [], self.forward(text, base, before, hi)
        s = after
        while s != before:
            out.append(s)
            s = last[s[0]]
        return out[::-1]

    def id_list(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def split(self, text: str) -> list[str]:
        """The words of a text, each without the blank before it."""
        if "  " in text or BLANK in text or text[:1] == " ":
            return [u[1:] for u in _WORD(BLANK + text.replace(" ", BLANK))]
        return text.split(" ") if text else []

    def _learn(self, part: list[str]) -> None:
        """Remember the ids of words; a word alone is encoded like a text, with the blank that stands before it."""
        plain = [w for w in part if w and BLANK not in w]
        for i in range(0, len(plain), AT_ONCE):
            group = plain[i : i + AT_ONCE]
            text = " ".join(group)
            ids = self.library.encode(text)
            flat = np.array(ids, "<i4")
            first = np.flatnonzero(self.begins[flat]).tolist()
            if len(first) == len(group) and self.library.decode(ids) == text:
                raw, first = flat.tobytes(), [4 * k for k in first] + [4 * len(flat)]
                self.words.update(zip(group, map(raw.__getitem__, map(slice, first, first[1:]))))
            else:
                self._learn_singly(group)
        self._learn_singly([w for w in part if not w or BLANK in w])

    def _learn_singly(self, part: list[str]) -> None:
        ids = [self.library.encode(w) if w else [self.ids[BLANK]] for w in part]
        self.words.update((w, np.array(x, "<i4").tobytes()) for w, x in zip(part, ids))
        self.lost.update(w for w, d in zip(part, self.library.decode(ids)) if d != w.replace(BLANK, " "))

    def encode_whole(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as little-endian 32-bit values, and whether they decode to it."""
        cut = [self.split(t) for t in texts]
        asked = set().union(*cut)
        if len(self.words) + len(asked.difference(self.words)) > REMEMBERED and self.words:
            self.words, self.older = {}, self.words
            self.lost = {w for w in self.lost if w in self.older}
        new = asked.difference(self.words)
        again = new.intersection(self.older)
        self.words.update(zip(again, map(self.older.__getitem__, again)))
        self._learn(list(new.difference(again)))
        of, lost = self.words.__getitem__, self.lost.intersection(asked)
        return [b"".join(map(of, w)) for w in cut], [not lost or lost.isdisjoint(w) for w in cut]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; associative."""
    out: Matrix = {}
    for i, row in a.items():
        new: dict[State, int] = {}
        for j, w in row.items():
            for k, v in b.get(j, {}).items():
                new[k] = max(new.get(k, w + v), w + v)
        out[i] = new
    return out


def product(matrices: list[Matrix]) -> Matrix:
    out = matrices[0]
    for m in matrices[1:]:
        out = combine(out, m)
    return out


def path(matrices: list[Matrix], before: State, after: State) -> list[State]:
    """The state at each border, first and last included, on the best path between two states."""
    ahead = [{before: 0}]
    for m in matrices:
        ahead.append(combine({before: ahead[-1]}, m)[before])
    out = [after]
    for m, here in zip(reversed(matrices), reversed(ahead[:-1])):
        out.append(max((s for s in here if out[-1] in m.get(s, {})), key=lambda s: here[s] + m[s][out[-1]]))
    return out[::-1]


@lru_cache(2)
def pieces(path_: str) -> Pieces:
    return Pieces(path_)


def normal_form(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


# -- documents that the library takes whole ------------------------------------------------


def _small(path_: str, giant: int, digest: bool):
    def run(batches):
        p = pieces(path_)
        for batch in batches:
            column, ids, exact = batch.column("text"), [], []
            mask, part, size = np.zeros(batch.num_rows, bool), [], 0
            for at in range(batch.num_rows):
                t = column[at].as_py()
                if len(t) <= giant:
                    mask[at] = True
                    part.append(t)
                    size += len(t)
                if part and (size > 1 << 20 or at == batch.num_rows - 1):
                    raw, good = p.encode_whole(part)
                    ids += [(len(x) // 4, sha256(x).hexdigest()) for x in raw] if digest else [_list(raw)]
                    exact += good
                    part, size = [], 0
            kept = batch.filter(pa.array(mask))
            if digest:
                values = [pa.array([n for n, _ in ids], pa.int64()), pa.array([h for _, h in ids], pa.string())]
            else:
                values = [pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), *values, pa.array(exact, pa.bool_()), pa.array(np.ones(len(exact), np.int64))], names=["doc_id", *(["n_pieces", "ids_sha256"] if digest else ["ids"]), "exact", "chunks"])

    return run


def _list(raw: list[bytes]) -> pa.Array:
    offs = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(raw), "<i4")))


# -- giant documents -----------------------------------------------------------------------

_CHUNK = "doc_id long, rk long, k int, base long, lo long, hi long, size long, text string"


def _split(path_: str, giant: int, chunk: int):
    def run(batches):
        reach = pieces(path_).longest
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column("text")[i].as_py()
                if len(t) <= giant:
                    continue
                t = normal_form(t)
                for k, lo in enumerate(range(0, len(t), chunk)):
                    hi = min(lo + chunk, len(t))
                    base = max(0, lo - reach)
                    row = [batch.column("doc_id")[i].as_py(), batch.column("rk")[i].as_py(), k, base, lo, hi, len(t), t[base : hi + reach]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(row, (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()))], names=["doc_id", "rk", "k", "base", "lo", "hi", "size", "text"])

    return run


def _transfer(path_: str):
    def run(batches):
        p = pieces(path_)
        for batch in batches:
            out = [_write(p.transfer(r["text"], r["base"], r["lo"], r["hi"], r["size"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "rk", "k", "size"]).columns, pa.array(out, pa.string())], names=["doc_id", "rk", "k", "size", "matrix"])

    return run


def _read(matrix: str) -> Matrix:
    out: Matrix = {}
    for a, b, c, d, w in json.loads(matrix):
        out.setdefault((a, b), {})[(c, d)] = w
    return out


def _write(matrix: Matrix) -> str:
    return json.dumps([[*i, *o, w] for i, row in matrix.items() for o, w in row.items()])


def _children(row: dict) -> list[Matrix]:
    return [_read(m["matrix"]) for m in sorted(row["parts"], key=lambda m: m["k"])]


def _combined(batches):
    """One matrix for the neighbours that lie in a row."""
    for batch in batches:
        out = [_write(product(_children(r))) for r in batch.select(["parts"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "rk", "up", "size"]).columns, pa.array(out, pa.string())], names=["doc_id", "rk", "k", "size", "matrix"])


def _borders(batches):
    """The states at both ends of each child, from those of its parent; the root begins at the start and ends with the document."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            children = _children(r)
            if r["before"] is None:
                ends = {s: w for s, w in product([{START: {START: 0}}, *children])[START].items() if s[1] == r["size"]}
                before, after = START, max(ends, key=ends.__getitem__)
            else:
                before, after = tuple(r["before"]), tuple(r["after"])
            states = path(children, before, after)
            rows += [(r["doc_id"], r["rk"], m["k"], list(a), list(b)) for m, a, b in zip(sorted(r["parts"], key=lambda m: m["k"]), states, states[1:])]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["d", "r", "j", "before", "after"])


def _backtraced(path_: str):
    def run(batches):
        p = pieces(path_)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                t, base = r["text"], r["base"]
                found = p.backtrace(t, base, tuple(r["before"]), tuple(r["after"]), r["hi"])
                ids = [i for s, e in found for i in p.id_list(t[s - base : e - base])]
                # what the pieces say, read back, is the text between the two states
                a, b = r["before"][1], r["after"][1]
                exact = p.library.decode([p.ids[BLANK], *ids]) == t[a - base : b - base].replace(BLANK, " ")
                rows.append((r["doc_id"], r["rk"], r["k"], ids, exact))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_()))], names=["doc_id", "rk", "k", "ids", "exact"])

    return run


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _giant_results(rows: DataFrame, path_: str, giant: int, chunk: int, fan: int) -> DataFrame:
    large = rows.where(F.length("text") > giant).dropDuplicates(["doc_id", "rk"])
    # by number, so that small rows with much work in them aren't gathered into few tasks
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut(large.mapInArrow(_split(path_, giant, chunk), _CHUNK).repartition(spread, "doc_id", "rk", "k"))
    matrices = chunks.mapInArrow(_transfer(path_), "doc_id long, rk long, k int, size long, matrix string")
    levels, left = [], (chunks.agg(F.max("k")).first()[0] or 0) + 1  # as many chunks as the longest document has
    while True:
        level = matrices.groupBy("doc_id", "rk", F.floor(F.col("k") / fan).cast("int").alias("up")).agg(F.max("size").alias("size"), F.collect_list(F.struct("k", "matrix")).alias("parts"))
        levels.append(cut(level))  # at most ``fan`` matrices a row
        left = -(-left // fan)
        if left == 1:
            break
        matrices = levels[-1].mapInArrow(_combined, "doc_id long, rk long, k int, size long, matrix string")
    none = F.lit(None).cast("array<long>")
    borders, schema = None, "d long, r long, j int, before array<long>, after array<long>"
    for level in reversed(levels):
        if borders is None:
            known = level.withColumn("before", none).withColumn("after", none)
        else:
            known = level.join(borders, _same("doc_id", "d") & _same("rk", "r") & _same("up", "j")).drop("d", "r", "j")
        borders = known.mapInArrow(_borders, schema)
    work = chunks.join(borders, _same("doc_id", "d") & _same("rk", "r") & _same("k", "j")).drop("d", "r", "j").repartition(spread, "doc_id", "rk", "k")
    done = work.mapInArrow(_backtraced(path_), "doc_id long, rk long, k int, ids array<int>, exact boolean")
    return done.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"), F.min("exact").alias("exact"), F.count("*").alias("chunks")).select(
        F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.flatten("p.ids").alias("ids"), "exact", "chunks"
    )


def _large(rows: DataFrame, path_: str, giant: int, chunk: int, fan: int) -> DataFrame:
    return rows.where(F.length("text") > giant).select("doc_id", "rk").join(_giant_results(rows, path_, giant, chunk, fan), _same("doc_id", "d") & _same("rk", "r")).select("doc_id", "ids", "exact", "chunks")


def encode(docs: DataFrame, path_: str | None = None, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, ids (of the pieces), exact (decoding gives the text back), chunks."""
    path_ = path_ or model_path()
    rows = keyed(docs)
    return rows.mapInArrow(_small(path_, giant, False), "doc_id long, ids array<int>, exact boolean, chunks long").unionByName(_large(rows, path_, giant, chunk, fan))


def _decoded(path_: str):
    def run(batches):
        library = pieces(path_).library
        for batch in batches:
            out = [library.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path_: str | None = None) -> DataFrame:
    """doc_id and the text of ``ids`` (null: empty)."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decoded(path_ or model_path()), "doc_id long, text string")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        offs = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4) if len(ids) else np.zeros(1, np.int32)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<i4")
        hashes = [sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs).astype(np.int64)), pa.array(hashes, pa.string()), batch.column("exact"), batch.column("chunks")], names=["doc_id", "n_pieces", "ids_sha256", "exact", "chunks"])


def digest(docs: DataFrame, path_: str | None = None, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``encode`` with n_pieces and ids_sha256 (of the ids as little-endian 32-bit values) in place of the ids."""
    path_, schema = path_ or model_path(), "doc_id long, n_pieces long, ids_sha256 string, exact boolean, chunks long"
    rows = keyed(docs)
    return rows.mapInArrow(_small(path_, giant, True), schema).unionByName(_large(rows, path_, giant, chunk, fan).mapInArrow(_digest, schema))
