"""Centroid clustering: float32 screening with rigorous rounding-error intervals, exact integers where intervals overlap.

Vectors become integers, ``floor(SCALE * x)``. In every round each task takes
the matrix product of its vectors with the centroids in float32. The product
and its worst rounding error give an interval for the squared distance to each
centroid (less the vector's own square, which all share); centroids whose
interval reaches below the least upper end are the short list. A short list of
one decides; of longer ones the distances are computed again as exact integers,
and the lowest number wins a tie. So the result does not depend on the order of
summation, the batch, the task or the machine. Tasks send one exact sum for each
centroid and component; the driver holds the centroids and nothing else.

The error bound: a float32 dot product of n terms, in any order and with or
without fused operations, is off by at most g(n) |x| |c| with
g(n) = n u / (1 - n u), u = 2**-24; rounding the integers to float32 first adds
two more factors 1 + u. The rest is done in float64 with a slack of its own.

Defined results: vectors that are null, not of the asked number of components,
or hold a null or non-finite component are left out; integers beyond
``LIMIT`` are held at it (no long could hold their distances); distances and
their sums beyond a long are its largest value; a null id is hashed as no digits and
stays null; rows of one id are vectors of their own, ordered by their components
where the hash ties; fewer vectors than centroids give as many centroids as
vectors; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, K, ROUNDS, SEED, SCALE = 64, 8, 10, "3:", 1024
LIMIT = 1 << 60
LONGEST = (1 << 63) - 1
PAIRS = 1 << 20  # distances that are looked at at once
LOW = 30  # bits of a sum's lower part

_U = 2.0**-24


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the kept rows, their integer vectors)."""
    offs = np.asarray(column.offsets)
    ok = np.asarray(column.is_valid()) & (np.diff(offs) == dim)
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    at = np.flatnonzero(ok)
    x = flat[offs[:-1][at][:, None] + np.arange(dim)].astype(np.float64) if len(at) else np.zeros((0, dim))
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(x[fine] * SCALE), -LIMIT, LIMIT)
    return at[fine], x.astype(np.int64)


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances row by row: int64 where that can't overflow, else Python integers."""
    if not len(x):
        return np.zeros(0, np.int64)
    most = max(int(x.max()), -int(x.min()), int(c.max()), -int(c.min()))
    d = x - c  # at most 2**61
    if x.shape[1] * (2 * most) ** 2 <= LONGEST:
        return (d * d).sum(axis=1)
    d = d.astype(object)
    return (d * d).sum(axis=1)


class Screen:
    """Nearest centroids of integer vectors."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.c32 = np.ascontiguousarray(centroids.astype(np.float32).T)
        self.square = np.array([float(sum(int(v) ** 2 for v in row)) for row in centroids])
        self.norm = np.sqrt(self.square) * (1 + 1e-12)
        n = (centroids.shape[1] + 4) * _U
        self.share = n / (1 - n)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|**2 - 2 x.c for all pairs."""
        wide = x.astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", wide, wide)) * (1 + 1e-12)
        size = 2 * norm[:, None] * self.norm
        middle = self.square - 2 * (x.astype(np.float32) @ self.c32).astype(np.float64)
        error = self.share * size + 2.0**-50 * (size + self.square)
        return middle - error, middle + error

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """(number of the nearest centroid of each row, how many pairs were computed exactly)."""
        out, step, checked = np.zeros(len(x), np.int64), max(1, PAIRS // len(self.c)), 0
        for i in range(0, len(x), step):
            part = x[i : i + step]
            low, high = self.intervals(part)
            listed = low <= high.min(axis=1)[:, None]
            out[i : i + step] = listed.argmax(axis=1)
            more = np.flatnonzero(listed.sum(axis=1) > 1)
            if len(more):
                row, number = np.nonzero(listed[more])
                distance = exact(part[more[row]], self.c[number])
                checked += len(row)
                # rows ascend, numbers ascend within a row: a stable sort keeps the lowest number of a tie first
                order = np.lexsort((number, distance, row)) if distance.dtype != object else np.array(sorted(range(len(row)), key=lambda k: (row[k], distance[k], number[k])))
                first = order[np.append(True, row[order][1:] != row[order][:-1])]
                out[i + more] = number[first]
        return out, checked


def _sums(shared, dim):
    def run(batches):
        screen = Screen(shared.value)
        k = len(screen.c)
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            _, x = integers(batch.column("v"), dim)
            label, _ = screen.nearest(x)
            order = np.argsort(label, kind="stable")
            there, start = np.unique(label[order], return_index=True)
            if len(there):
                n += np.bincount(label, minlength=k)
                high[there] += np.add.reduceat(x[order] >> LOW, start, axis=0)
                low[there] += np.add.reduceat(x[order] & ((1 << LOW) - 1), start, axis=0)
        number = np.repeat(np.flatnonzero(n), dim)
        place = np.tile(np.arange(dim), len(number) // dim)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(n[number]), pa.array(high[number, place]), pa.array(low[number, place])], names=["cluster", "place", "n", "high", "low"])

    return run


def _kept(dim):
    def run(batches):
        for batch in batches:
            at, x = integers(batch.column("v"), dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), flat], names=["vec_id", "v"])

    return run


def _assigned(shared, dim, said):
    """said: for each centroid its inertia, hash and the whole inertia, or None."""

    def run(batches):
        screen = Screen(shared.value)
        for batch in batches:
            at, x = integers(batch.column("v"), dim)
            label, _ = screen.nearest(x)
            distance = np.minimum(exact(x, screen.c[label]), LONGEST).astype(np.int64)
            columns, names = [batch.column("vec_id").take(pa.array(at)), pa.array(label, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            if said:
                inertia, total, digest = said.value
                columns += [pa.array(inertia[label]), pa.array(np.full(len(label), total, np.int64)), pa.array(digest, pa.string()).take(pa.array(label))]
                names += ["cluster_inertia", "inertia", "centroid_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) alone."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(rows: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the least hashes."""
    at = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.mapInArrow(_kept(dim), "vec_id long, v array<long>").orderBy(at, "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), dim)


def step(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact mean of each one's vectors, rounded down."""
    dim = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    sums = rows.mapInArrow(_sums(shared, dim), "cluster int, place int, n long, high long, low long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    new = centroids.copy()
    for r in sums.collect():  # one row for each centroid and component
        new[r.cluster, r.place] = ((r.high << LOW) + r.low) // r.n
    return new


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> np.ndarray:
    centroids = first_centroids(rows, k, dim, seed)
    for _ in range(rounds if len(centroids) else 0):
        new = step(rows, centroids)
        if (new == centroids).all():  # no later round can change anything
            break
        centroids = new
    return centroids


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = vectors(embeddings)
    sc = rows.sparkSession.sparkContext
    centroids = fit(rows, k, rounds, dim, seed)
    kinds = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], kinds + ", cluster_inertia long, inertia long, centroid_sha256 string")
    shared = sc.broadcast(centroids)
    sums = rows.mapInArrow(_assigned(shared, dim, None), kinds).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = np.zeros(len(centroids), np.int64)
    for r in sums:
        inertia[r.cluster] = min(int(r.s), LONGEST)
    digest = [hashlib.sha256(",".join(str(v) for v in row.tolist()).encode()).hexdigest() for row in centroids]
    said = sc.broadcast((inertia, min(sum(int(r.s) for r in sums), LONGEST), digest))
    return rows.mapInArrow(_assigned(shared, dim, said), kinds + ", cluster_inertia long, inertia long, centroid_sha256 string")


def sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> str:
    """DuckDB SQL of ``cluster`` over ``embeddings``, one pair of tables for each round."""
    parts = [
        f"kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: isfinite(x::double))) = {dim})",
        f"x as materialized (select r, unnest(v) as x, unnest(range({dim})) as d from kept)",
        f"c0 as materialized (select j, unnest(v) as c, unnest(range({dim})) as d from (select row_number() over (order by sha256('{seed}' || coalesce(vec_id::varchar, '')), v) - 1 as j, v from kept qualify j < {k}) t)",
    ]
    nearest = "(select r, j, s from (select r, j, sum((x - c) * (x - c))::bigint as s from x join c{0} using (d) group by r, j) t qualify row_number() over (partition by r order by s, j) = 1)"
    for i in range(rounds):
        parts += [
            f"a{i} as materialized {nearest.format(i)}",
            f"c{i + 1} as materialized (select j, d, coalesce((s - ((s % n) + n) % n) // n, c)::bigint as c from c{i} left join (select j, d, sum(x)::hugeint as s, count(*)::hugeint as n from x join a{i} using (r) group by j, d) t using (j, d))",
        ]
    parts += [
        f"last as materialized {nearest.format(rounds)}",
        "sums as (select j, sum(s)::bigint as n from last group by j)",
        f"digests as (select j, sha256(string_agg(c::varchar, ',' order by d)) as h from c{rounds} group by j)",
    ]
    return f"with {', '.join(parts)} select vec_id, j::int as cluster, s as distance, n as cluster_inertia, (select sum(s)::bigint from last) as inertia, h as centroid_sha256 from last join kept using (r) join sums using (j) join digests using (j)"
