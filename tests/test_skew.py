"""Hot and missing keys: complete results, work spread over tasks."""

from pyspark.sql import functions as F

from vigilflow.functions.skew import join_facts, join_facts_spread


def frame(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    return spark.range(30_000).select("id", key.cast("long").alias("k"))


def test_hot_and_missing_keys(spark):
    rows = frame(spark)
    facts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 5")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for joined in (join_facts(rows, facts, "k"), join_facts_spread(rows, facts, "k", "n")):
            got = joined.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).collect()
            by = {r.k: (r.rows, r.n) for r in got}
            assert by[7] == (10_000, 10_000) and by[None] == (10_000, None) and by[5] == (1, None) and by[8] == (1, 1)
        spread = join_facts_spread(rows, facts, "k", "n").withColumn("task", F.spark_partition_id())
        tasks = spread.filter("k = 7").groupBy("task").count().collect()
        assert len(tasks) > 1 and max(t["count"] for t in tasks) < 10_000
        empty = join_facts(rows, facts, "k").withColumn("task", F.spark_partition_id()).filter("k IS NULL")
        assert empty.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_keys_get_parts_by_their_share(spark):
    """A key with a third of the rows is cut finer than the tasks, whatever their number."""
    rows = frame(spark)
    facts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spread = join_facts_spread(rows, facts, "k", "n").withColumn("task", F.spark_partition_id())
            largest = spread.groupBy("task").count().agg(F.max("count")).first()[0]
            assert largest < 4 * 30_000 / n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_rows_are_cut_before_the_shuffle(spark):
    from vigilflow.operators.paging import newest_per_group

    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    plan = newest_per_group(rows, ["g"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
