import shutil

from pyspark.sql import functions as F

from tessera.plans import relational
from tessera.streaming import windows as W


def streamed(spark, df, made, tmp_path, mode="append"):
    """The rows of a streaming query over the rows of df, in one micro-batch after another."""
    source = tmp_path / "in"
    df.repartition(1).write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    q = made(stream).writeStream.format("memory").queryName("made").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        return spark.table("made").collect()
    finally:
        q.stop()
        shutil.rmtree(tmp_path / "state", ignore_errors=True)


def test_minute_counts_equal_the_batch_query(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100)))
    events.write.parquet(str(tmp_path / "t" / "events.parquet"))
    want = relational.st1_sliding_60s(spark, str(tmp_path / "t")).join(events, "event_id").select("user_id", "ts", "recent").collect()
    got = streamed(spark, events.select("user_id", "ts", "value"), W.minute_counts, tmp_path)
    # Events of one user at the very same time count each other in the batch query only.
    assert len(got) == len(want)
    assert sorted((r["user_id"], r["ts"], r["recent"]) for r in got) == sorted((r["user_id"], r["ts"], r["recent"]) for r in want)


def test_tumbling_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    got = streamed(spark, events, W.tumbling, tmp_path, "complete")
    assert sorted((r["start"], r["event_type"], r["n"]) for r in got) == sorted(map(tuple, want.collect()))


def test_sessions(spark, tmp_path):
    rows = [("u", 0), ("u", 60), ("u", 4000), ("v", 10)]
    df = spark.createDataFrame(rows, "user_id string, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = streamed(spark, df, W.sessions, tmp_path, "complete")
    assert sorted((r["user_id"], r["n"]) for r in got) == [("u", 1), ("u", 2), ("v", 1)]


def test_limiter():
    x = W.Limiter(requests=2, tokens=100)
    assert x.wait(0, 50) == 0
    x.add(0, 60)
    x.add(10_000, 30)
    assert x.totals(10_000) == (2, 90) and x.wait(10_000, 5) == 50_100
    assert x.wait(10_000, 50) == 50_100 and x.wait(10_000, 80) == 60_100
    assert x.totals(60_000) == (2, 90) and x.totals(60_001) == (1, 30)  # strictly more than a minute
    assert x.wait(70_001, 1000) == 0
