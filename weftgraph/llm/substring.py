"""Substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Hashing every window into the index
would move a row a word, so a window is filed under its least ``GRAM``-word
hash; equal windows agree on it, and neighbouring windows mostly share it, so a
run of neighbours is one entry (about one for twelve words).

The index lives in a folder and is opened again by later jobs. It keeps sorted
immutable runs (fingerprint, number of entries), bucketed by fingerprint, and
the entries of each batch as a segment in the order of the documents. A new
batch is counted by fingerprint and merge-joined with the runs, which are
neither shuffled nor moved for that; the entries of the batch and of the
history under a fingerprint that the batch repeats are verified, and then the
batch's counts become a run of their own. ``FAN`` runs of a level are compacted
into one of the next. Of the historical entries only those are shuffled that pass a
filter of fixed size of the repeated fingerprints, and of the historical texts,
which lie in ``PARTS`` parts by document, only the parts that are asked for are read.

Batches have names. A manifest, renamed into place, says which batches and files
count, so that a job that dies leaves the index as it was. A batch whose name is
known is judged against what came before it and takes the place of what it was:
a job that is repeated after its commit, because its result was lost, gets the same
result again. (Counts of the batch's former content stay in the runs until the index
is rebuilt; they only add candidates, which are verified.)

Verification: entries under a repeated fingerprint are compared by an
independent 64-bit hash of their whole word range (a repeat clears the entry at
once) and, where the ranges under a fingerprint differ, window by window for
one entry of each different range; the texts are those of the batch and of the
history, which the index keeps unless the caller has them. Fingerprint and
window hash together make 128 bits. A fingerprint with many different ranges is
dealt over several tasks.

``dedup`` without an index takes the table in ``BATCHES`` batches through a
temporary one and judges all rows against all; with an index the rows are one
named batch, judged against the history and themselves, and the history stays as
it is.

Defined results: null text has no words; a row given twice is two documents,
so that every window of it also starts elsewhere; null ids are kept; fewer than
35 words are never removed; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import bounded, cut, delete, shared_dir

WINDOW, GRAM = 35, 12
SPREAD = WINDOW - GRAM + 1  # grams in a window
BATCHES, FAN = 2, 4
#: ranges of a fingerprint that one task compares; rows of a key from which on it is sent to every task; at most so many keys
HOT, HOT_ROWS, MOST_HOT = 1000, 10_000, 100_000
FILTER = 1 << 26  # bits
PARTS = 256

_ENTRY = "f long, r long, n int, row_id long, rk long, lo int, hi int"


def _sliding_min(g: np.ndarray, size: int) -> np.ndarray:
    out, have = g, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _entries(words: wh.Words, h: np.ndarray):
    """(row, fingerprint, range hash, entries it counts for, first window, last window) for runs of neighbouring windows."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return None
    grams = wh.windows(h, GRAM, 3)
    least = _sliding_min(grams, SPREAD)[:n]
    row = words.row_of_word()
    whole = row[:n] == row[WINDOW - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    if not len(first):
        return None
    stop = np.append(np.flatnonzero(new), n)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    # windows past the end of a row follow its whole ones, so that a run may end in them
    last = np.minimum(last, words.row[row[first] + 1] - WINDOW)
    f = least[first]
    spans = last - first + SPREAD
    at = np.repeat(first - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
    again = np.add.reduceat((grams[at] == np.repeat(f, spans)).astype(np.int32), np.append(0, np.cumsum(spans)[:-1]))
    r = wh.ranges(h, first, last + WINDOW, 4)
    base = words.row[row[first]]
    return row[first], f, r, np.minimum(again, 2).astype(np.int32), (first - base).astype(np.int32), (last - base).astype(np.int32)


def _scan(batches):
    for batch in batches:
        ids, keys = batch.column("row_id"), batch.column("rk")
        for i, _, words in wh.each_slice(batch):
            got = _entries(words, words.hashes())
            if got is None:
                continue
            row, f, r, n, lo, hi = got
            take = pa.array(row + i)
            yield pa.RecordBatch.from_arrays([pa.array(wh.signed(f)), pa.array(wh.signed(r)), pa.array(n), ids.take(take), keys.take(take), pa.array(lo), pa.array(hi)], names=["f", "r", "n", "row_id", "rk", "lo", "hi"])


class FingerprintIndex:
    """Runs (f, n), segments of entries and texts under ``path``, as its newest manifest names them; a new folder without ``path``."""

    def __init__(self, spark, path: str | None = None, fan: int = FAN, keep_texts: bool = True):
        self.spark, self.fan, self.keep_texts = spark, fan, keep_texts
        self.path = (path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.runs, self.segments, self.batches = self._open()
        self.replaced: list[str] = []

    # runs: (name, level, buckets); segments: names, the texts of one beside it; batches: the names that the segments were given as

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _open(self) -> tuple[int, list[tuple[str, int, int]], list[str], list[str]]:
        fs, at = self._at("manifest-*.json")
        found = sorted(int(f.getPath().getName()[9:-5]) for f in fs.globStatus(at) or [])
        if not found:
            return 0, [], [], []
        said = json.loads(self.spark.read.text(f"{self.path}/manifest-{found[-1]}.json", wholetext=True).first()[0])
        return found[-1], [tuple(x) for x in said["runs"]], said["segments"], said["batches"]

    def _commit(self) -> None:
        fs, beside = self._at(f"manifest-{uuid.uuid4().hex}.new")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps({"runs": self.runs, "segments": self.segments, "batches": self.batches}).encode()))
        out.close()
        self.version += 1
        fs.rename(beside, self._at(f"manifest-{self.version}.json")[1])
        for old in range(self.version - 2, max(0, self.version - 5), -1):  # the one before stays for readers that have just opened it
            delete(self.spark, f"{self.path}/manifest-{old}.json")

    def _write_run(self, entries: DataFrame, level: int) -> tuple[str, int, int]:
        """A run of the sums of n by f. The buckets are the partitions of that sum, so that each is one file."""
        name, buckets = f"run_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        counts = entries.groupBy("f").agg(F.sum("n").cast("long").alias("n"))
        counts.write.bucketBy(buckets, "f").sortBy("f").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name, level, buckets

    def _run(self, name: str, buckets: int) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another session
            self.spark.sql(f"create table {name} (f bigint, n bigint) using parquet options (path '{self.path}/{name}') clustered by (f) sorted by (f) into {buckets} buckets")
        return self.spark.table(name)

    def _forget(self, runs: list[tuple[str, int, int]]) -> None:
        for name, *_ in runs:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, f"{self.path}/{name}")

    def counted(self) -> dict[int, int]:
        """Runs of each level."""
        return {level: sum(x[1] == level for x in self.runs) for level in {x[1] for x in self.runs}}

    def compact(self) -> None:
        """Merge the runs of a level into one of the next wherever there are ``fan`` of them."""
        level = 0
        while True:
            mine = [x for x in self.runs if x[1] == level]
            if not mine and not any(x[1] > level for x in self.runs):
                return
            if len(mine) >= self.fan:
                # as plain files: Spark 4.1 takes a union of bucketed scans for bucketed, but reads it as if it weren't
                every = self.spark.read.schema("f long, n long").parquet(*(f"{self.path}/{name}" for name, *_ in mine))
                self.runs = [x for x in self.runs if x not in mine] + [self._write_run(every, level + 1)]
                self._commit()
                self._forget(mine)
            level += 1

    def entries(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(*(f"{self.path}/{x}" for x in segments))

    def texts(self, again: DataFrame, segments: list[str]) -> DataFrame:
        """The rows that ``again`` may name, of the parts in which it names any."""
        parts = [r.part for r in again.select(_part().alias("part")).distinct().collect()]
        every = None
        for x in segments:
            one = self.spark.read.schema("row_id long, text string, rk long, part int").parquet(f"{self.path}/texts_{x}").where(F.col("part").isin(parts)).drop("part")
            every = one if every is None else every.unionByName(one)
        return _marked(every, again).where("near").drop("near")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Add a batch of ``_rows``; (row_id, rk, lo, hi): the spans of the batch and of the history that the batch repeats."""
        again, segments = self.repeated(rows, batch)
        found = cut(verified(again, self.texts(again, segments)))
        self.commit()
        return found

    def repeated(self, rows: DataFrame, batch: str) -> tuple[DataFrame, list[str]]:
        """The entries of a batch of ``_rows`` and of the history under a fingerprint that the batch repeats, not yet verified, and the segments they are of; ``commit`` then adds the batch."""
        name, place = uuid.uuid4().hex, self.batches.index(batch) if batch in self.batches else len(self.batches)
        history = self.segments[:place]
        if self.keep_texts:
            rows.withColumn("part", _part()).repartitionByRange("part", "row_id", "rk").write.partitionBy("part").parquet(f"{self.path}/texts_{name}")
            rows = self.spark.read.schema("row_id long, text string, rk long, part int").parquet(f"{self.path}/texts_{name}").drop("part")
        rows.mapInArrow(_scan, _ENTRY).write.parquet(f"{self.path}/{name}")
        fresh = self._write_run(self.entries([name]), 0)
        known = self._run(fresh[0], fresh[2]).select("f", F.col("n").alias("m"))
        if place < len(self.batches):  # the runs count what came later, too
            old = self.entries(history).groupBy("f").agg(F.sum("n").cast("long").alias("o"))
            known = known.join(old, "f", "left").select("f", (F.col("m") + F.coalesce("o", F.lit(0))).alias("m"))
            self.replaced.append(self.segments[place])
            self.segments[place] = name
        else:
            for run, _, buckets in self.runs:
                old = self._run(run, buckets).select("f", F.col("n").alias("o"))
                known = known.hint("merge").join(old.hint("merge"), "f", "left").select("f", (F.col("m") + F.coalesce("o", F.lit(0))).alias("m"))
            self.segments.append(name)
            self.batches.append(batch)
        self.runs.append(fresh)
        asked = cut(known.where("m > 1"))
        before = _marked(self.entries(history), asked, ("f",)).where("near").drop("near")
        return cut(_joined(before.unionByName(self.entries([name])), asked, ["f"], "m").drop("m")), [*history, name]

    def commit(self) -> None:
        self._commit()
        for old in self.replaced:
            delete(self.spark, f"{self.path}/{old}")
            delete(self.spark, f"{self.path}/texts_{old}")
        self.replaced = []
        self.compact()

    def drop(self) -> None:
        self._forget(self.runs)
        delete(self.spark, self.path)


def _window_rows(batches):
    """Window hashes of the entries asked for: (f, r, w, at, m) rows."""
    for batch in batches:
        spans = batch.column("spans")
        for i, j, words in wh.each_slice(batch):
            h = words.hashes(5)
            w = wh.windows(h, WINDOW, 6)
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for k in range(i, j):
                base = words.row[k - i]
                for s in spans[k].as_py() or ():
                    n = s["hi"] - s["lo"] + 1
                    cols[0].append(np.full(n, s["f"], np.int64))
                    cols[1].append(np.full(n, s["r"], np.int64))
                    cols[2].append(wh.signed(w[base + s["lo"] : base + s["hi"] + 1]))
                    cols[3].append(np.arange(n, dtype=np.int32))
                    cols[4].append(np.full(n, s["m"], np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["f", "r", "w", "at", "m"])


def _digest(batches):
    for batch in batches:
        buf, offs = wh.buffers(batch.column("text"))
        raw, spans = buf.tobytes(), batch.column("cut")
        total, gone, digests = [], [], []
        for k in range(batch.num_rows):
            words = raw[offs[k] : offs[k + 1]].split()
            total.append(len(words))
            todo = spans[k].as_py()
            if todo:
                kept, upto = [], 0
                for s in sorted(todo, key=lambda s: s["lo"]):
                    kept += words[upto : max(upto, s["lo"])]
                    upto = max(upto, s["hi"] + WINDOW)
                words = kept + words[upto:]
            gone.append(total[-1] - len(words))
            digests.append(sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rows(docs: DataFrame) -> DataFrame:
    """``keyed`` under another name, so that all joins with the texts get the same plan and share one exchange."""
    bounded(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("row_id"), body.alias("text"), F.xxhash64(body).alias("rk"))


def verified(again: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, rk, lo, hi): windows lo to hi of the row also start elsewhere among the entries ``again``. Overlaps may occur."""
    kinds = cut(again.groupBy("f", "r").agg(F.count("*").alias("c"), F.sum("n").cast("long").alias("n"), F.min(F.struct("row_id", "rk", "lo", "hi")).alias("one")))
    # entries whose whole range is unlike the others under their fingerprint, or that overlap themselves, are compared window by window
    single = F.col("c") == 1
    uneven = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.min("c").alias("least"), F.max(F.when(single, F.col("n"))).alias("own")).where("least = 1 and (kinds > 1 or own > 1)")
    asked = _joined(kinds, cut(uneven.select("f", "kinds", F.ceil(F.col("kinds") / HOT).cast("int").alias("m"))), ["f"], "kinds")
    spans = asked.select("one.row_id", "one.rk", F.struct("f", "r", "m", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi")).alias("s")).groupBy("row_id", "rk").agg(F.collect_list("s").alias("spans"))
    found = _with_text(rows, spans, "inner").mapInArrow(_window_rows, "f long, r long, w long, at int, m int")
    # the rows of a window are dealt over as many parts as its fingerprint needs
    twice = found.groupBy("f", "w").agg(F.count("*").alias("k"), F.max("m").alias("m")).where("k > 1")
    parts = twice.where("m = 1").select("f", "w", F.lit(0).alias("s")).unionByName(twice.where("m > 1").select("f", "w", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("s")))
    hit = found.withColumn("s", F.pmod(F.xxhash64("r"), F.col("m")).cast("int")).join(parts, ["f", "w", "s"], "left_semi").select("f", "r", "at")
    whole = _joined(again, kinds.where("c > 1").select("f", "r", "c"), ["f", "r"], "c").select("row_id", "rk", "lo", "hi")
    part = asked.where(single).join(hit, ["f", "r"]).select("one.row_id", "one.rk", (F.col("one.lo") + F.col("at")).alias("lo"))
    return whole.unionByName(part.withColumn("hi", F.col("lo")))


def _joined(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``found``, which has each key once with its number of rows ``weight``.

    Keys of more than ``HOT_ROWS`` rows, fewer than ``MOST_HOT`` by the bound, are sent to every task, so that
    none of them is one task's; the others are merge-joined.
    """
    least = max(HOT_ROWS, (found.agg(F.sum(weight)).first()[0] or 0) // MOST_HOT)
    hot, cold = F.broadcast(found.where(F.col(weight) > least)), found.where(F.col(weight) <= least)
    others = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(cold.hint("merge"), keys))


def _with_text(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    right = spans.withColumnRenamed("row_id", "d").withColumnRenamed("rk", "k")
    return rows.join(right, F.col("row_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k")), how).drop("d", "k")


def _part():
    return F.pmod(F.xxhash64("row_id", "rk"), F.lit(PARTS)).cast("int")


def _marked(rows: DataFrame, again: DataFrame, key: tuple[str, ...] = ("row_id", "rk")) -> DataFrame:
    """``rows`` with ``near``: false only if no row of ``again`` has the key. A filter of ``FILTER`` bits, of 4 KB parts, is sent to every task."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER))
    bits = again.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    asked = rows.withColumn("slot", slot + 1).withColumn("part", F.expr("bitmap_bucket_number(slot)")).withColumn("slot", F.expr("bitmap_bit_position(slot)"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("slot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = F.coalesce(F.expr("shiftright(octet, cast(slot % 8 as int)) & 1") == 1, F.lit(False))
    return asked.join(F.broadcast(bits), "part", "left").withColumn("octet", byte).select(*rows.columns, near.alias("near"))


def dedup_spans(rows: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """The spans (row_id, rk, lo, hi) of windows that also start elsewhere, overlaps included, and ``rows`` with ``near``: whether a row may have any."""
    index = FingerprintIndex(rows.sparkSession, keep_texts=False)
    found = []
    for b in range(batches):
        found.append(index.repeated(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(batches)) == b), str(b))[0])
        index.commit()
    index.drop()
    every = found[0]
    for again in found[1:]:
        every = every.unionByName(again)
    marked = _marked(rows, every)
    near = marked.where("near").drop("near")  # one exchange of these texts serves all joins
    spans = None
    for again in found:
        part = verified(again, near)
        spans = part if spans is None else spans.unionByName(part)
    return spans, marked


def removed_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(row_id, rk, lo, hi): windows lo to hi of the row also start elsewhere in ``docs``. Overlaps may occur."""
    return dedup_spans(_rows(docs), batches)[0]


def dedup(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256. With ``index`` the rows are its batch of the name ``batch``, which has to be given."""
    if index is not None and batch is None:
        raise ValueError("a batch of an index needs a name, by which a repeated job is known")
    rows, schema = _rows(docs), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if index is None:
        found, marked = dedup_spans(rows, batches)
    else:
        found = index.add(rows, batch)
        marked = _marked(rows, found)
    spans = found.groupBy("row_id", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("cut"))
    # the texts of rows without any entry stay where they are
    near, far = marked.where("near").drop("near"), marked.where("not near").select("row_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("cut"))
    return _with_text(near, spans, "left").select("row_id", "text", "cut").mapInArrow(_digest, schema).unionByName(far.mapInArrow(_digest, schema))
