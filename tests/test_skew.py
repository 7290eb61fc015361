"""Hot keys are cut, and results stay whole."""

from pyspark.sql import functions as F

from partloom.operators.skew import split_join


def test_hot_key_is_spread_and_nothing_is_lost(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 100 + 50).alias("k"), F.col("id").alias("i"))
    records = spark.createDataFrame([(k, c) for k in (7, *range(50, 140)) for c in ("a", "b")], "k bigint, c string")
    out = split_join(rows, records, ["k"], ["i"], hot_rows=200)
    plain = rows.join(records, "k")
    assert out.columns == plain.columns
    assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()


def test_left_join_keeps_rows_without_records(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"))
    records = spark.createDataFrame([(0, "x")], "k bigint, c string")
    out = split_join(rows, records, ["k"], ["i"], "left", hot_rows=100)
    assert out.count() == 1000 and out.filter("c is null").count() == 500


def test_pieces_of_a_hot_key_land_in_different_tasks(spark):
    """With broadcasts off, the hot key of a sorted join is worked on by several tasks."""
    rows = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    records = spark.createDataFrame([(1, "x")], "k int, c string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "false")):
            spark.conf.set(c, v)
        out = split_join(rows, records, ["k"], ["i"], hot_rows=1000)
        tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(r["count"] for r in tasks) == 20000 and len(tasks) > 3
