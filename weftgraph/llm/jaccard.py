"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of ``SHINGLE``-word shingles; two are linked if their
Jaccard similarity is at least ``SIMILARITY``. Equal word sequences are one
class, compared once and never expanded. Classes that share one of ``BANDS``
keys of ``ROWS`` MinHash values each may be similar (a pair at the threshold is
missed with probability (1 - 0.8**5)**40, about 1e-7); each class is tied to
the least class of each of its buckets only, so no bucket is expanded into
pairs, and the connected groups of these ties are compared.

Within a group every pair is looked at, in blocks: a group of n classes is
dealt into ceil(n / ``BLOCK``) blocks, and each pair of blocks is a task of its
own. There the MinHash values of a pair are compared ``STEP`` at a time; with a
uniform prior, m equal values of h leave the similarity a Beta(m + 1, h - m + 1)
posterior, and the pair is dropped once its probability of reaching the
threshold is under ``TOLERANCE``. The rest are verified exactly on their
shingles. A task returns the number of links of each class and a spanning
forest of them, never the pairs.

Results: doc_id; exact_id, the least id of the same word sequence; class_id,
the least id of the connected component of links; n_links, how many other
documents it is linked to (copies included). Defined results: null and empty
texts have no shingles and no links; texts of fewer than five words are one
shingle; a row given twice is one document; of rows that share an id but not a
text each is compared, and the least classes and the most links count; null ids
come back with null classes and no links; an empty table gives an empty result;
further columns are ignored by ``links`` and kept by ``clean``, which tells rows
apart by id and text, so that every row is compared and only copies go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut, keyed, texts

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
BLOCK = 512
SALTS = 16
STEP, STEPS, TOLERANCE = 16, 8, 1e-6

_HASHES = BANDS * ROWS


def _multipliers(n: int, salt: int) -> np.ndarray:
    return wh.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BAND_MULT, _TEST_MULT = _multipliers(_HASHES // 2, 5), _multipliers(STEP * STEPS // 2, 6)


def shingles(words: wh.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the shingles of each row, in order, repeats included."""
    h, count = words.hashes(13), np.diff(words.row)
    grams = wh.windows(h, SHINGLE, 14)
    row = words.row_of_word()
    at = np.flatnonzero(row[: len(grams)] == row[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    values = np.concatenate([grams[at], wh.ranges(h, words.row[short], words.row[short + 1], 15)])
    rows = np.concatenate([row[at], short])
    order = np.argsort(rows, kind="stable")
    return values[order], np.searchsorted(rows[order], np.arange(len(words.offs)))


def minhashes(values: np.ndarray, offs: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """uint32 array, rows x 2 * len(multipliers); rows without values get the greatest value."""
    out = np.full((len(offs) - 1, 2 * len(multipliers)), np.uint32(0xFFFFFFFF), np.uint32)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        starts = offs[full]
        for k, m in enumerate(multipliers):
            x = values * m
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            pair = x.view(np.uint32).reshape(-1, 2)
            out[full, 2 * k] = np.minimum.reduceat(pair[:, 0], starts)
            out[full, 2 * k + 1] = np.minimum.reduceat(pair[:, 1], starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """int64 array, rows x BANDS."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        key = wh.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def _scan(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, words in wh.each_slice(batch):
            h = words.hashes(16)
            a = wh.ranges(h, words.row[:-1], words.row[1:], 17)
            b = wh.ranges(words.hashes(18), words.row[:-1], words.row[1:], 19)
            values, offs = shingles(words)
            keys = band_keys(minhashes(values, offs, _BAND_MULT))
            full = np.flatnonzero(np.diff(offs) > 0)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys[full].ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(full + i)), pa.array(wh.signed(a[full])), pa.array(wh.signed(b[full])), bands], names=["doc_id", "a", "b", "bands"])


def betainc_upper(t: float, a: int, b: int) -> float:
    """P(X >= t) for X ~ Beta(a, b) with whole a and b, as a binomial sum."""
    n = a + b - 1
    return sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(a))


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> list[int]:
    """For h = STEP, 2 * STEP, ... the fewest equal values that leave a pair in."""
    return [next(m for m in range(h + 1) if betainc_upper(similarity, m + 1, h - m + 1) >= tolerance) for h in range(STEP, STEP * STEPS + 1, STEP)]


def compare(texts_a: pa.Array, texts_b: pa.Array | None, similarity: float = SIMILARITY) -> np.ndarray:
    """Boolean matrix of the links between two blocks; within the first if there is no second."""

    def block(column):
        buf, offs = wh.buffers(column)
        sets, parts = [], []
        for i, j in wh.slices(offs):
            values, at = shingles(wh.Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            parts.append(minhashes(values, at, _TEST_MULT))
            sets += [np.unique(values[x:y]) for x, y in zip(at[:-1], at[1:])]
        return sets, np.concatenate(parts)

    sets_a, sig_a = block(texts_a)
    sets_b, sig_b = (sets_a, sig_a) if texts_b is None else block(texts_b)
    equal = np.zeros((len(sets_a), len(sets_b)), np.int16)
    left = np.ones(equal.shape, bool) if texts_b is not None else np.triu(np.ones(equal.shape, bool), 1)
    for step, least in enumerate(least_matches(similarity)):
        if step < 2:  # most pairs are alive: compare whole columns
            for k in range(step * STEP, (step + 1) * STEP):
                equal += sig_a[:, k, None] == sig_b[None, :, k]
        else:
            i, j = np.nonzero(left)
            span = slice(step * STEP, (step + 1) * STEP)
            for lo in range(0, len(i), 1 << 18):
                p, q = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
                equal[p, q] += (sig_a[p, span] == sig_b[q, span]).sum(1, dtype=np.int16)
        left &= equal >= least
    out = np.zeros_like(left)
    for i in np.flatnonzero(left.any(1)):
        mine = sets_a[i]
        others = np.flatnonzero(left[i])
        sizes = np.array([len(sets_b[j]) for j in others])
        fits = np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine))  # else the sizes alone rule it out
        others, sizes = others[fits], sizes[fits]
        if not len(others):
            continue
        cat = np.concatenate([sets_b[j] for j in others])
        at = np.minimum(np.searchsorted(mine, cat), len(mine) - 1)
        common = np.add.reduceat((mine[at] == cat).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
        out[i, others] = common >= similarity * (len(mine) + sizes - common)
    return out


def _least_neighbour(adjacent: np.ndarray) -> np.ndarray:
    """The least index of each node's connected component."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = "id long, other long, links long"


def _task(task: pa.Table, similarity: float):
    """(id, least linked id, linked documents) arrays of one task's documents, None if there is nothing to compare."""
    side, text = task.column("side").to_numpy(), task.column("text").combine_chunks()
    ids, where = np.unique(task.column("id").to_numpy(), return_inverse=True)  # repeated rows are one document
    copies = np.zeros(len(ids), np.int64)
    copies[where] = task.column("copies").to_numpy()
    same = task.column("i")[0].as_py() == task.column("j")[0].as_py()
    left, right = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if len(ids) < 2 or not len(left) or not len(right):
        return None
    i, j = np.nonzero(compare(text.take(pa.array(left)), None if same else text.take(pa.array(right)), similarity))
    adjacent = np.zeros((len(ids), len(ids)), bool)
    adjacent[where[left[i]], where[right[j]]] = True
    adjacent |= adjacent.T
    np.fill_diagonal(adjacent, False)
    some = np.flatnonzero(adjacent.any(1))
    return ids[some], ids[_least_neighbour(adjacent)[some]], adjacent[some] @ copies


def _verified(similarity: float):
    """Rows come sorted by task (grp, i, j), so that each task's documents stand together."""

    def run(batches):
        waiting = None
        for batch in _with_end(batches):
            done = []
            if batch is not None:
                table = pa.Table.from_batches([batch])
                table = table if waiting is None else pa.concat_tables([waiting, table])
                key = np.stack([table.column(c).to_numpy() for c in ("grp", "i", "j")])
                borders = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
                done = [table.slice(a, b - a) for a, b in zip(borders, borders[1:])]
                waiting = table.slice(borders[-1])
            elif waiting is not None and waiting.num_rows:
                done = [waiting]
            out = [x for x in (_task(t, similarity) for t in done) if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["id", "other", "links"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def _looked_up(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the root that ``found`` (id, root) gives for ``column``, else the column itself.

    Only names that ``rows`` holds are looked up; a name that many rows share is dealt over ``SALTS`` tasks.
    """
    asked = rows.select(F.col(column).alias("id")).distinct()
    known = found.join(asked, "id", "left_semi").select(F.col("id").alias("_n"), F.col("root").alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_t"))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    out = salted.join(known, (F.col(column) == F.col("_n")) & (F.col("_s") == F.col("_t")), "left")
    return out.select(*rows.columns, F.coalesce("_r", column).alias(name))


def _roots(forest: DataFrame) -> DataFrame:
    """(id, root) of a forest of such rows in which each points to a lesser one, by pointer doubling."""
    forest = cut(forest)
    while True:
        inner = cut(forest.join(forest.select(F.col("root").alias("id")).distinct(), "id", "left_semi"))
        if inner.isEmpty():
            return forest
        forest = cut(_looked_up(forest, "root", inner, "up").select("id", F.col("up").alias("root")))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the nodes of an undirected graph (id, other): root is the least id of the connected component.

    By contraction: each node points to its least lesser neighbour, the forest of these pointers is
    resolved to its roots, and what is left of the graph are edges between different roots, each once. The
    other lesser neighbours of a node are tied to the one that it points to, so that the node itself is
    never needed again.
    """
    def oriented(df):
        return cut(df.where("id != other").select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct())

    left, out = oriented(edges), None
    while not left.isEmpty():
        least = cut(left.groupBy("id").agg(F.min("other").alias("root")))
        root = _roots(least)
        out = root if out is None else cut(_looked_up(out, "root", root, "up").select("id", F.col("up").alias("root")).unionByName(root.join(out.select("id"), "id", "left_anti")))
        tied = left.join(least, "id").where("other != root").select(F.col("root").alias("id"), "other").distinct()
        tied = _looked_up(_looked_up(tied, "id", root, "a"), "other", root, "b")
        left = oriented(tied.select(F.col("a").alias("id"), F.col("b").alias("other")))
    if out is None:
        return left.select("id", F.col("other").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("id"), "root").distinct())


def links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, exact_id, class_id, n_links."""
    rows = texts(docs)
    scanned = cut(rows.where("doc_id is not null").mapInArrow(_scan, "doc_id long, a long, b long, bands array<long>"))
    member = scanned.select("doc_id", "a", "b").distinct()
    classes = cut(member.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    own = classes.select(F.col("id").alias("doc_id"), "a", "b")
    bucket = scanned.join(own, ["doc_id", "a", "b"]).select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    least = bucket.groupBy("band", "key").agg(F.min("id").alias("other"), F.max("id").alias("most")).where("other < most").select("band", "key", "other")
    group = components(bucket.join(least, ["band", "key"]).where("id != other").select("id", "other"))
    size = group.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    copies = classes.groupBy("id").agg(F.sum("copies").alias("copies"))
    part = group.join(size, "root").select("id", F.col("root").alias("grp"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")).join(copies, "id")
    tasks = rows.join(part, F.col("doc_id") == F.col("id")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("grp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.when(F.col("block") <= F.col("with"), 0).otherwise(1).alias("side"), "id", "copies", "text")
    # by number, so that small rows with much work in them aren't gathered into few tasks
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(tasks.repartition(spread, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_verified(similarity), "id long, other long, links long"))
    root = components(found.select("id", "other"))
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.join(root, "id", "left").join(count, "id", "left").select(
        "a", "b", F.col("id").alias("exact_id"), F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    each = member.join(per_class, ["a", "b"]).groupBy("doc_id").agg(F.min("exact_id").alias("exact_id"), F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return rows.select("doc_id").join(each, "doc_id", "left").select(
        "doc_id", F.coalesce("exact_id", "doc_id").alias("exact_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any letter case."""
    taken = {x.lower() for x in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with their columns, one of each class: the one with the least id (then hash of the text), one with an id if there is any.

    Of rows with equal id and text the one stays whose other columns, written as JSON, are least.
    """
    key, id_, rk, stays_, row = (_free(docs, x) for x in ("weft_key", "weft_id", "weft_rk", "weft_stays", "weft_row"))
    ids = keyed(docs).groupBy("doc_id").agg(F.min("rk").alias("low"), F.max("rk").alias("high"), F.count("rk").alias("n"))
    odd = cut(ids.where("doc_id is null or n > 1"))
    plain = odd.where("doc_id is null or low != high").isEmpty()  # each id names one text
    if plain:
        rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    else:
        pairs = keyed(docs).select("doc_id", "rk").distinct()
        order = F.asc_nulls_last("doc_id"), F.asc("rk")
        keys = cut(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()))
        keys = keys.select(F.col("doc_id").alias(id_), F.col("rk").alias(rk), key)
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(rk))
        rows = cut(docs.join(keys, same).select(*(docs[x] for x in docs.columns), key))
    stays = links(rows.select(F.col(key).alias("doc_id"), "text"), similarity).where("doc_id = class_id").select(F.col("doc_id").alias(stays_)).distinct()
    kept = rows.join(stays, F.col(key) == F.col(stays_), "left_semi")
    if odd.isEmpty():  # no row stands twice, nothing is left to choose
        return kept.select(*docs.columns)
    others = F.to_json(F.struct(*(x for x in docs.columns if x.lower() not in ("doc_id", "text")), F.lit(0).alias(row)), {"ignoreNullFields": "false"})
    return kept.groupBy(key).agg(F.min_by(F.struct(*docs.columns), others).alias(row)).select(f"{row}.*")
