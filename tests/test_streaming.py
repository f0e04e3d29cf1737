"""The stream gives the rows of the batch for all windows that the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.streaming import windows


def test_windows_in_two_runs(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    source, target, marks = (f"file://{tmp_path}/{n}" for n in ("in", "out", "marks"))
    first = events.where(F.col("event_id") <= middle)
    first.unionByName(first.where("event_id % 3 = 0")).write.parquet(f"{source}/a")
    counts = lambda: windows.windowed_counts(windows.event_stream(spark, f"{source}/*", events.schema), late="400 days")
    windows.run_once(counts(), target, marks)
    events.where(F.col("event_id") > middle).write.parquet(f"{source}/b")
    end = spark.createDataFrame([(-1, 5000 * 86400)], "event_id bigint, s bigint").select(F.col("event_id"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(5000))).alias("ts"), F.lit(0).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    end.write.parquet(f"{source}/c")
    windows.run_once(counts(), target, marks)
    windows.run_once(counts(), target, marks)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(target).collect()}
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in batch.collect()}
    assert got == want
