"""Small corpora with the awkward cases: nulls, empty and long texts, repeated rows and ids, clashing extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("rk", T.StringType()),
        T.StructField("f", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_d", T.StringType()),
        T.StructField("_key", T.StringType()),
        T.StructField("stays_id", T.StringType()),
    ]
)


def docs(spark, rows):
    """rows: (doc_id, text) pairs; extra columns carry names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "d", "k", "s") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["w" + "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def rows(df):
    return [r.asDict() for r in df.collect()]
