"""The threshold of the quality rules against the labels it was set by."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import quality

TABLES = "/root/testdata/sf0.01"


def test_threshold_lies_between_trusted_and_low_labels(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    trusted = quality.trusted_labels(labels)
    found = quality.quality(docs, trusted).join(labels.where("quality = 0").select("doc_id", F.lit("low").alias("kind")).unionByName(trusted.withColumn("kind", F.lit("trusted"))), "doc_id")
    over = {r["kind"]: r["over"] for r in found.groupBy("kind").agg(F.avg((F.col("score") >= quality.THRESHOLD).cast("int")).alias("over")).collect()}
    assert over["trusted"] > 0.95
    assert over["low"] < 0.05
