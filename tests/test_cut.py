"""Tables that are cut: their sizes, and what Spark sends to all tasks because of them."""

import pytest
from pyspark.sql import functions as F

from weftgraph.session import cut, measured_joins
from weftgraph.sources import code

ESTIMATE = "spark.sql.autoBroadcastJoinThreshold"


def size(df) -> str:
    return str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_the_size_of_a_cut_table_does_not_grow_with_the_rounds_of_a_loop(spark):
    at = cut(spark.range(20).select("id", (F.col("id") + 1).alias("after")))
    for _ in range(5):
        at = cut(at.join(at.select(F.col("id").alias("k"), F.col("after").alias("a")), F.col("after") == F.col("k"), "left").select("id", F.coalesce("a", "after").alias("after")))
    assert len(size(at)) < 7  # squared in every round, it had over 100 digits
    assert {r.id: r.after for r in at.collect()} == {i: min(i + 32, 20) for i in range(20)}


def test_no_large_text_is_sent_to_all_tasks_by_its_estimate(spark):
    long = spark.range(2000).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))  # 40 MB, estimated as 56 kB
    joined = lambda: spark.range(5000).repartition(2).join(long.repartition(2, F.col("text")), "id").select("id", "text")
    former = spark.conf.get(ESTIMATE)
    assert "BroadcastHashJoin" in joined()._jdf.queryExecution().sparkPlan().toString()
    with measured_joins(spark):
        assert "BroadcastHashJoin" not in joined()._jdf.queryExecution().sparkPlan().toString()
    assert spark.conf.get(ESTIMATE) == former and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    with pytest.raises(ZeroDivisionError), measured_joins(spark):
        1 / 0
    assert spark.conf.get(ESTIMATE) == former


def test_files_that_lie_together_are_parsed_by_several_tasks(spark):
    files = spark.range(40).select(F.concat(F.lit("a/f"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit("x = 1\n").alias("content")).coalesce(1)
    parsed = code.symbols(files).where("kind = 'file'").select(F.spark_partition_id().alias("p"), "path")
    assert "REPARTITION_BY_NUM" in parsed._jdf.queryExecution().toString()
    assert parsed.count() == 40


def test_what_is_cut_goes_in_small_parts(spark):
    """And the session's own settings stand again afterwards; smaller ones hold all the time."""
    from weftgraph.session import PART, _bytes, small_parts

    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    with small_parts(spark):
        assert [_bytes(spark.conf.get(n)) for n in names] == [PART, 2 * PART]
    assert [spark.conf.get(n) for n in names] == before
    spark.conf.set(names[0], "1MB")
    try:
        with small_parts(spark):
            assert _bytes(spark.conf.get(names[0])) == 1 << 20
    finally:
        spark.conf.set(names[0], before[0])
