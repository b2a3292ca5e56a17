from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.plans import tables
from tracewarden.streaming import monitor


def test_stream_equals_batch(spark, tmp_path):
    """Events in several micro-batches give the rows that the batch replay gives."""
    sf = "/root/testdata/sf0.001"
    s = tables.steps(spark, sf).withColumn("event_id", F.col("step_index").cast("long")).select("trajectory_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("symbol").cast("int").alias("symbol"))
    for k in range(3):  # files by time
        cut = s.withColumn("k", F.ntile(3).over(W.orderBy("ts"))).where(F.col("k") == k + 1).drop("k")
        cut.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    dfa = tables.monitor()
    risk = {i: i / 10 for i in range(6)}
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "100 days")
    q = monitor.monitor_stream(stream, dfa, risk, 0.4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["trajectory_id"], r["step_index"]): r["state"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["trajectory_id"], r["step_index"]): r["state"] for r in tables.replayed(spark, sf).collect()}
    assert got == want


def test_first_alert():
    dfa = tables.monitor()
    rows, state, step, first = monitor.replay_batch([0, 1, 2], dfa, dict.fromkeys(range(6), 0.9), 0.5, dfa.start, 0, -1)
    assert first == 1 and step == 3 and [r[4] for r in rows] == [1, 1, 1]
    assert monitor.replay_batch([0], dfa, {}, 0.5, state, step, first)[0][0][0] == 4
