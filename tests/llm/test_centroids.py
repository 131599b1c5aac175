"""Centroid clustering against plain Python integers; the error bound against exact arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from weftgraph.llm import centroids as ce

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("cluster", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dim, seed="3:"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-ce.LIMIT, min(ce.LIMIT, math.floor(Fraction(x) * 1024))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256((seed + ("" if r[0] is None else str(r[0]))).encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, u: sum((a - b) ** 2 for a, b in zip(v, u))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds if c else 0):
        label = [near(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, label) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    label = [near(v) for _, v in kept]
    distance = [min(far(v, c[a]), ce.LONGEST) for (_, v), a in zip(kept, label)]
    own = [min(sum(d for d, a in zip(distance, label) if a == j), ce.LONGEST) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return [(i, a, d, own[a], min(sum(distance), ce.LONGEST), digest[a]) for (i, _), a, d in zip(kept, label, distance)]


def key(rows):
    return sorted(map(str, rows))


def compared(spark, rows, k, rounds, dim):
    found = ce.cluster(table(spark, rows), k, rounds, dim)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert key(tuple(r) for r in found.collect()) == key(plain(rows, k, rounds, dim))


def test_awkward_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.1] * 5), (203, [0.1] * 7), (204, [0.1] * 5 + [None]), (205, [0.1] * 5 + [float("nan")]), (206, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (None, [-0.5] * 6), (3, [0.25] * 6), (3, [0.25] * 6)]
    rows += [(300 + i, [0.125, -0.125] * 3) for i in range(60)]  # a large group of equal vectors
    compared(spark, rows, 5, 4, 6)


def test_ties_go_to_the_lowest_number(spark):
    rows = [(i, [float((i * 7) % 3 - 1), float((i * 5) % 3 - 1)]) for i in range(90)]  # a small grid: many equal distances
    compared(spark, rows, 6, 5, 2)


def test_few_vectors_and_empty_tables(spark):
    compared(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])], 8, 3, 2)
    compared(spark, [], 8, 3, 2)
    compared(spark, [(1, None), (2, [1.0])], 8, 3, 2)


def test_values_that_no_float_holds(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([1e6, 1e12, -1e12, 1e17, 3e300, -1e20]) * r.random() for _ in range(4)]) for i in range(40)]
    compared(spark, rows, 4, 3, 4)
    near = [(i, [2.0**30 + r.randrange(8) / 1024 for _ in range(4)]) for i in range(60)]  # far from zero, close together
    compared(spark, near, 4, 3, 4)


@pytest.mark.parametrize("scale", [1, 100, 1 << 20, 1 << 40, 1 << 58])
def test_intervals_hold_the_exact_value(scale):
    r = np.random.default_rng(scale)
    x, c = (r.integers(-scale, scale, (50, 64), endpoint=True) for _ in "ab")
    low, high = ce.Screen(c[:9]).intervals(x)
    for i in range(50):
        for j in range(9):
            value = sum(int(v) ** 2 for v in c[j]) - 2 * sum(int(a) * int(b) for a, b in zip(x[i], c[j]))
            assert Fraction(low[i, j]) <= value <= Fraction(high[i, j])


def test_the_screen_decides_nearly_everything():
    r = np.random.default_rng(5)
    x = r.integers(-300, 300, (2000, 64))
    label, checked = ce.Screen(x[:8]).nearest(x)
    assert checked < 100 and (label[:8] == np.arange(8)).all()
    # one centroid twice: every row of it is computed exactly and goes to the lower number
    label, checked = ce.Screen(np.concatenate([x[:4], x[:4]])).nearest(x)
    assert checked >= 4000 and label.max() < 4
