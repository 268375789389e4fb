from pyspark.sql import functions as F

from corvane.streaming import events as S


def test_streams_equal_their_batch_twins(spark, data, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{data}/events.parquet")
    table.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = S.tumbling(stream, late=None).writeStream.outputMode("complete").format("memory").queryName("t").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("t").collect()} == {tuple(r) for r in S.tumbling(table).collect()}


def test_upsert_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "id int, v string, seq int"
    assert S.current(spark, out) is None
    many = [(i, f"m{i}", 1) for i in range(100, 300)]
    for rows in ([(1, "a", 1), (2, "b", 1), *many], [(2, "c", 2), (3, "d", 1)], [(2, "x", 3)], [(2, "y", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = S.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), out, "id", "seq", str(tmp_path / "cp"), buckets=8).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {tuple(r) for r in S.current(spark, out).select("id", "v", "seq").collect()} == {(1, "a", 1), (2, "y", 4), (3, "d", 1), *many}
    held = S._snapshots(spark, out)
    assert len(held) == 8 and max(map(len, held.values())) == 2 and sum(map(len, held.values())) <= 10  # only touched buckets are rewritten


def test_usage_stream_equals_its_batch_twin(spark, data, tmp_path):
    from corvane.operators.learning import usage_fold

    table = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("ok")).dropDuplicates(["user_id", "ts"])
    middle = table.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    for early in (True, False):
        part = table.where((F.unix_micros("ts") <= middle) == early)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        sink = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out{n}"))
        S.usage_stream(stream, "user_id", "ts", "ok").writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    newest = {r.user_id: tuple(r) for n in (0, 1) for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()}
    assert set(newest.values()) == {tuple(r) for r in usage_fold(table, "user_id", "ts", F.col("ok")).collect()}


def test_distinct(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, None)], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert S.distinct(rows, "user_id", "ts").count() == 2
