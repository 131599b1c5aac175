"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of ASCII punctuation. Numbers (words with a
digit, and number words), names (capitalised words inside a sentence; a run of
them is one name) and units (a unit word right after a number) become typed
placeholders, so a question keeps its template when its parameters change.
Items and documents are compared under two readings: capitalised words that
begin a sentence are plain words, or names unless they are among
``COMMON_WORDS``; a match under the first reading comes before the second's.
Windows of ``WINDOW`` template words are hash-joined with those of the
benchmark items. A document is contaminated by an item if it holds at least
``SIMILARITY`` of the item's distinct windows and its slots are consistent: all
slots that were matched hold the item's own values (verbatim), or of those
whose value recurs in the item at least ``CONSISTENT`` follow one renaming: they
hold the value that the document mostly has for the item's value
(reparameterised). That two values of the item became one is no objection, as
new parameters may agree by chance.

The join: a filter of fixed size, made of the items' windows, leaves the few
windows of the documents that an item may have. A document with enough windows
of an item lacks at most n - ceil(0.8 n) of its n windows, so it has one of any
n - ceil(0.8 n) + 1; the ones that are rarest among the documents are joined,
which keeps windows that many texts share from making pairs. The pairs that
this leaves are verified exactly, document by document.

Items shorter than a window are one window of their own length; items of under
``LEAST`` words match a document only as its whole text.

Defined results: null texts match nothing, whether document or item, nor do
texts without words; an item given twice is one; null ids and repeated documents
are kept; an empty table on either side gives an empty result; further columns
are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut, keyed, sent

WINDOW, LEAST, SIMILARITY, CONSISTENT = 5, 3, 0.8, 0.8
ITEMS = 64  # items that a row of the verification holds
FILTER = 1 << 26  # bits

#: fixed values: words that stand for numbers and units
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg gram grams kilogram kilograms ton tons tonnes pound pounds lb lbs oz ounce ounces"
    " ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur kmh mph hz khz mhz ghz w kw mw v kv j kj cal kcal degrees celsius fahrenheit"
).split()
#: fixed values: words that begin a sentence without being a name
COMMON_WORDS = (
    "a an the this that these those there here it its he she they we you i his her their our your my one some any all each every both many much more most another other no not none"
    " what which who whom whose when where why how if then so but and or nor yet for as at by in on of to from with without after before during since until while because although though whereas given suppose assume let"
    " is are was were be been am do does did has have had can could may might must shall should will would find calculate compute determine solve show prove write give explain consider use using now today first next finally also however therefore thus hence"
    " der die das ein eine einen und oder aber wenn wie was wer wo es er sie ist sind im in auf mit von zu nach bei le la les un une des et ou mais si que qui il elle ils est sont dans sur avec pour de du el los las una unos y o pero como cuando donde es son en con por para al del"
).split()

NONE, NUMBER, NAME, UNIT = range(4)
_PLACE = np.array([0] + [wh.scalar(91, k) for k in (NUMBER, NAME, UNIT)], np.uint64)


def _mask(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_PUNCTUATION = _mask(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_STOP, _DIGIT, _UPPER, _SMALL = _mask(b".!?:\n"), _mask(b"0123456789"), _mask(range(65, 91)), _mask([*range(97, 123), *range(128, 256)])


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(wh.Words(raw, np.array([0, len(raw)])).hashes(12))


_NUMBER_HASHES, _UNIT_HASHES, _COMMON_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNIT_WORDS), _hashes_of(COMMON_WORDS)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


class Template:
    """The template words of some rows: hash, kind and text span of each, and row offsets. ``starts``: names may begin a sentence."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, starts: bool = False):
        keep = ~_PUNCTUATION[buf]
        place = np.flatnonzero(keep)
        count = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(keep, out=count[1:])
        words = wh.Words(buf[keep], count[offs], lower=True)
        h, s, e, row = words.hashes(12), words.starts, words.ends, words.row_of_word()
        n = len(h)
        kind = np.zeros(n, np.int8)
        if n:
            digits = np.zeros(len(words.buf) + 1, np.int64)
            np.cumsum(_DIGIT[words.buf], out=digits[1:])
            number = (digits[e] > digits[s]) | _in(h, _NUMBER_HASHES)
            stops = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(_STOP[buf], out=stops[1:])
            first = place[s]
            raw, second = buf[keep], np.where(e - s > 1, s + 1, s)
            inside = np.zeros(n, bool)
            inside[1:] = (row[1:] == row[:-1]) & (stops[first[1:]] == stops[first[:-1]])
            upper = _UPPER[raw[s]] | ((raw[s] == 0xC3) & (raw[second] >= 0x80) & (raw[second] <= 0x9E))
            after = np.where(raw[s] == 0xC3, np.minimum(second + 1, len(raw) - 1), second)
            name = upper & _SMALL[raw[after]] & (e - s > 1) & ~number
            name &= inside | ~_in(h, _COMMON_HASHES) if starts else inside
            unit = np.zeros(n, bool)
            unit[1:] = number[:-1] & (row[1:] == row[:-1]) & ~number[1:] & _in(h, _UNIT_HASHES)[1:]
            kind[name], kind[number], kind[unit] = NAME, NUMBER, UNIT
            more = np.zeros(n, bool)  # a further word of the same name
            more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & inside[1:]
            h = np.where(kind > 0, _PLACE[kind], h)
            h, s, e, kind, row = h[~more], s[~more], e[~more], kind[~more], row[~more]
        self.buf, self.hashes, self.starts, self.ends, self.kind, self.row_of = words.buf, h, s, e, kind, row
        self.row = np.searchsorted(row, np.arange(len(offs)))
        self.length = np.diff(self.row)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each window that lies in one row."""
        w = wh.windows(self.hashes, size, 20 + size)
        at = np.flatnonzero(self.row_of[: len(w)] == self.row_of[size - 1 :]) if len(w) else np.zeros(0, np.int64)
        return w[at], at

    def value(self, word: int) -> bytes:
        return self.buf[self.starts[word] : self.ends[word]].tobytes()


class Index:
    """The windows of some items, as sorted arrays."""

    def __init__(self, items: list[str | None], starts: bool = False):
        buf, offs = wh.buffers(pa.array(items, pa.string()))
        self.starts, self.template = starts, (t := Template(buf, offs, starts))
        self.size = np.minimum(t.length, WINDOW)
        parts = []
        for size in sorted(set(self.size.tolist()) - {0}):
            w, at = t.windows(size)
            mine = self.size[t.row_of[at]] == size
            parts.append((w[mine], at[mine]))
        w, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((at, w))
        self.w, self.at = w[order], at[order]
        self.keys, self.first = np.unique(self.w, return_index=True)
        self.first = np.append(self.first, len(self.w))
        # distinct (window, item) pairs
        item = t.row_of[self.at]
        new = np.ones(len(item), bool)
        new[1:] = (self.w[1:] != self.w[:-1]) | (item[1:] != item[:-1])
        self.pair_item = item[new]
        self.pair_first = np.append(np.searchsorted(np.flatnonzero(new), self.first[:-1]), new.sum())
        self.n_windows = np.bincount(self.pair_item, minlength=len(items))
        self.sizes = sorted(set(self.size.tolist()) - {0})

    def found(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``w`` that are in the index, and its keys there."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, w), len(self.keys) - 1)
        hit = self.keys[key] == w
        return np.flatnonzero(hit), key[hit]


def consistent(pairs: Counter) -> tuple[int, int]:
    """How many slots follow one renaming, and how many there are, among those whose value recurs in the item.

    pairs: ((kind, value of the item), (kind, value of the document)) -> slots.
    """
    ours: Counter = Counter()
    most: Counter = Counter()
    for (a, _), n in pairs.items():
        ours[a] += n
        most[a] = max(most[a], n)
    return sum(most[a] for a in ours if ours[a] > 1), sum(n for n in ours.values() if n > 1)


def slots(index: Index, item: int, doc: Template, keys: np.ndarray, at: np.ndarray) -> tuple[str | None, int]:
    """Kind of the match (None if the slots are inconsistent) and how many slots it rests on.

    keys, at: the document's windows that are in the index, and their first words.
    """
    t, size = index.template, int(index.size[item])
    lo, hi = int(t.row[item]), int(t.row[item + 1])
    pairs = []
    for k, q in zip(keys.tolist(), at.tolist()):
        here = index.at[index.first[k] : index.first[k + 1]]
        pairs += [(int(p) - lo, q) for p in here[(here >= lo) & (here < hi)]]
    shift = Counter(q - p for p, q in pairs)
    best = max(shift, key=lambda d: (shift[d], -d))
    near: dict[int, int] = {}
    for p, q in pairs:
        if p not in near or abs(q - p - best) < abs(near[p] - p - best):
            near[p] = q
    matched: dict[int, int] = {}
    for p, q in sorted(near.items()):
        for k in range(size):
            matched.setdefault(p + k, q + k)
    values: Counter = Counter()
    n = same = 0
    for p, q in matched.items():
        if kind := int(t.kind[lo + p]):
            a, b = t.value(lo + p), doc.value(q)
            values[(kind, a), (kind, b)] += 1
            n += 1
            same += a == b
    if same == n:
        return "verbatim", n
    kept, tested = consistent(values)
    return ("reparameterised" if kept >= CONSISTENT * tested else None), n


def find(index: Index, doc: Template):
    """(row, item, matched windows, kind, slots) for each contaminated row of ``doc``."""
    where, which = [], []
    for size in index.sizes:
        w, first = doc.windows(size)
        at, key = index.found(w)
        where.append(first[at])
        which.append(key)
    if not where or not sum(map(len, where)):
        return
    at, key = np.concatenate(where), np.concatenate(which)
    row = doc.row_of[at].astype(np.int64)
    one = np.unique(row * len(index.keys) + key)
    r, k = one // len(index.keys), one % len(index.keys)
    many = index.pair_first[k + 1] - index.pair_first[k]
    start = np.append(0, np.cumsum(many)[:-1])
    items = index.pair_item[np.repeat(index.pair_first[k] - start, many) + np.arange(many.sum())]
    pair, n = np.unique(np.repeat(r, many) * len(index.size) + items, return_counts=True)
    r, i = pair // len(index.size), pair % len(index.size)
    for row_, item, c in zip(r.tolist(), i.tolist(), n.tolist()):
        whole = index.size[item] >= LEAST or doc.length[row_] == index.size[item]
        if c >= SIMILARITY * index.n_windows[item] and whole:
            mine = row == row_
            kind, m = slots(index, item, doc, *_own(index, item, key[mine], at[mine]))
            if kind:
                yield row_, item, c, kind, m


def find_either(readings: list[Index], buf: np.ndarray, offs: np.ndarray) -> list[tuple]:
    """(row, item, windows, matched windows, kind, slots) by the first reading under which the item contaminates the row."""
    out: dict[tuple[int, int], tuple] = {}
    for index in readings:
        for row, item, c, kind, m in find(index, Template(buf, offs, index.starts)):
            out.setdefault((row, item), (row, item, int(index.n_windows[item]), c, kind, m))
    return [out[k] for k in sorted(out)]


def _readings(items: list[str | None]) -> list[Index]:
    return [Index(items), Index(items, True)]


def _own(index: Index, item: int, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of a row's windows that the item has, by position."""
    lo, hi = index.template.row[item], index.template.row[item + 1]
    mine = np.isin(index.keys[keys], index.w[(index.at >= lo) & (index.at < hi)])
    order = np.argsort(at[mine], kind="stable")
    return keys[mine][order], at[mine][order]


def _distinct(owner: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window of each owner once."""
    order = np.lexsort((w, owner))
    owner, w = owner[order], w[order]
    new = np.ones(len(w), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (w[1:] != w[:-1])
    return owner[new], w[new]


def _item_windows(batches):
    for batch in batches:
        buf, offs = wh.buffers(batch.column("text"))
        for starts in (False, True):
            t = Template(buf, offs, starts)
            size = np.minimum(t.length, WINDOW)
            for k in sorted(set(size.tolist()) - {0}):
                w, at = t.windows(k)
                row = t.row_of[at]
                row, w = _distinct(row[size[row] == k], w[size[row] == k])
                n = np.bincount(row, minlength=batch.num_rows)[row]
                yield pa.RecordBatch.from_arrays([batch.column("ik").take(pa.array(row)), pa.array(np.full(len(row), starts, np.int32)), pa.array(np.full(len(row), k, np.int32)), pa.array(wh.signed(w)), pa.array(n.astype(np.int32))], names=["ik", "reading", "size", "w", "n"])


def _document_windows(shared):
    """The windows of each document that the filter lets through, under both readings."""

    def run(batches):
        sizes, bits = shared.value
        for batch in batches:
            buf, offs = wh.buffers(batch.column("text"))
            for i, j in wh.slices(offs):
                for starts in (False, True):
                    t = Template(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], starts)
                    rows, found = [], []
                    for k in sizes:
                        w, at = t.windows(k)
                        slot = w & np.uint64(FILTER - 1)
                        hit = np.flatnonzero((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                        row = t.row_of[at[hit]]
                        if k < LEAST:  # as the whole text only
                            hit, row = hit[t.length[row] == k], row[t.length[row] == k]
                        rows.append(row)
                        found.append(w[hit])
                    row, w = _distinct(np.concatenate(rows), np.concatenate(found))
                    if len(row):
                        take = pa.array(row + i)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("rk").take(take), pa.array(np.full(len(row), starts, np.int32)), pa.array(wh.signed(w))], names=["doc_id", "rk", "reading", "w"])

    return run


def _verified(batches):
    for batch in batches:
        ids, items, texts = batch.column("doc_id"), batch.column("items"), batch.column("text")
        at, out = [], []
        for k in range(batch.num_rows):
            asked = items[k].as_py()
            buf, offs = wh.buffers(texts.slice(k, 1))
            for _, i, *found in find_either(_readings([x["text"] for x in asked]), buf, offs):
                at.append(k)
                out.append((asked[i]["item_id"], *found))
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), batch.column("rk").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "rk", "item_id", "n_windows", "n_matched", "kind", "n_slots"])


_SCHEMA = "doc_id long, rk long, item_id long, n_windows long, n_matched long, kind string, n_slots long"


def _same_row(d: str, k: str):
    return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("rk") == F.col(k))


def candidates(rows: DataFrame, items: DataFrame) -> DataFrame | None:
    """(d, k, ik): documents (id, hash of the text) and items that share one of the item's rarest windows; None if no item has words."""
    spark = rows.sparkSession
    windows = cut(items.mapInArrow(_item_windows, "ik long, reading int, size int, w long, n int"))
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most ``WINDOW`` rows
    if not sizes:
        return None
    slot = F.col("w").bitwiseAND(F.lit(FILTER - 1))
    bit = F.expr("shiftleft(1L, cast(w & 63 as int))")
    made = windows.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most FILTER / 64 rows
    bits = np.zeros(FILTER >> 6, np.int64)
    bits[made.column("at").to_numpy()] = made.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast((sizes, bits.view(np.uint64)))  # FILTER / 8 bytes
    held = cut(rows.mapInArrow(_document_windows(shared), "doc_id long, rk long, reading int, w long"))
    often = held.groupBy("reading", "w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("ik", "reading").orderBy(F.coalesce("df", F.lit(0)), "w"))  # an item's windows
    lacking = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-6)
    probes = cut(windows.join(often, ["reading", "w"], "left").withColumn("r", rank).where(F.col("r") <= lacking + 1).select("reading", "w", "ik"))
    return cut(held.join(sent(probes), ["reading", "w"]).select(F.col("doc_id").alias("d"), F.col("rk").alias("k"), "ik").distinct())


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = keyed(docs)
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().withColumn("ik", F.xxhash64("item_id", "text")))
    pairs = candidates(rows, items)
    if pairs is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    near = rows.join(sent(cut(pairs.select("d", "k").distinct())), _same_row("d", "k"), "left_semi")
    # items that share a rare window with the document; many are dealt over several rows, each with the text
    parts = pairs.groupBy("d", "k").agg(F.ceil(F.count("ik") / ITEMS).alias("parts"))
    same = pairs["d"].eqNullSafe(F.col("d2")) & (pairs["k"] == F.col("k2"))
    pairs = pairs.join(parts.select(F.col("d").alias("d2"), F.col("k").alias("k2"), "parts"), same).withColumn("part", F.pmod("ik", "parts"))
    asked = pairs.join(items, "ik").groupBy("d", "k", "part").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("items"))
    return near.join(asked, _same_row("d", "k")).select("doc_id", "rk", "text", "items").mapInArrow(_verified, _SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that contaminates it: doc_id, item_id, n_windows, n_matched, kind, n_slots."""
    return _found(docs, benchmark).drop("rk")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    bad = cut(_found(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("rk").alias("_k")).distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_k"])
    return docs.join(sent(bad), same, "left_anti")
