from shelfmark.plans import domain as D


def test_commands_of_a_small_file_use_every_core(spark, tmp_path):
    rows = [(i, "2024-01-01 00:00:00", i % 7, "view", 0.5, '{"k": %d}' % i) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", events.ts.cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    orders = spark.createDataFrame([(i, i % 5, "1998-01-02") for i in range(100)], "o_orderkey long, o_custkey long, o_orderdate string")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = D.commands(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["seq"] for r in made.select("seq").collect()) == list(range(200))
