"""The number of sequences depends on the pieces, not on a setting of the cluster."""

from __future__ import annotations

from millrace.llm import packing


def test_sequences_do_not_depend_on_shuffle_partitions(spark):
    cut = spark.createDataFrame([(d, 0, 0, 200 + 37 * (d % 20), d) for d in range(100)], packing.PIECE)
    total = sum(200 + 37 * (d % 20) for d in range(100))
    was, found = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in ("1", "4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.add(packing.pack(cut, 100).select("sequence_id").distinct().count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(found) == 1 and found.pop() <= -(-total // packing.CAPACITY) + 1
