"""Training examples from candidates: which repairs count, which candidates are taken, and their messages up to a reviewed place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_repairs(repairs: DataFrame, reviews: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """(key, repair_id) of the repairs that are selected and accepted (reviews: repair_id, decision). Two for one candidate fail the job."""
    found = repairs.join(selected.select("repair_id").distinct(), "repair_id", "left_semi").join(reviews.where("decision = 'accepted'").select("repair_id").distinct(), "repair_id", "left_semi")
    twice = F.raise_error(F.concat(F.lit("two repairs of candidate "), F.col(key).cast("string"))).cast("string")
    once = found.groupBy(key).agg(F.countDistinct("repair_id").alias("__n"), F.min("repair_id").alias("__id"))
    return once.select(key, F.when(F.col("__n") == 1, F.col("__id")).otherwise(twice).alias("repair_id"))


def selections(candidates: DataFrame, usable: DataFrame, key: str) -> DataFrame:
    """Candidates (eligible, status, n_blocks) with their fate and repair: `ineligible`, `incomplete`, `needs repair`, `repaired` or
    `original`, the first that holds. Those without blocks take no repair."""
    joined = candidates.join(usable, key, "left")
    blocked = F.col("n_blocks") > 0
    fate = F.when(~F.coalesce("eligible", F.lit(False)), "ineligible").when(~F.col("status").eqNullSafe(F.lit("complete")), "incomplete").when(blocked & F.col("repair_id").isNull(), "needs repair").when(blocked, "repaired").otherwise("original")
    return joined.withColumn("fate", fate).withColumn("repair_id", F.when(F.col("fate") == "repaired", F.col("repair_id")))


def examples(taken: DataFrame, messages: DataFrame, dropped: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """A row per taken candidate with an accepted review (key, decision, boundary): its messages up to the boundary, without those that its
    repair drops: n_messages and a hash of them in order.

    messages: key, ordinal, role, text; dropped: repair_id, ordinal. Candidates whose boundary is no single message of the assistant
    that is left are gone, as are those with no review.
    """
    held = taken.where(F.col("fate").isin("original", "repaired")).join(reviews.where("decision = 'accepted'").select(key, "boundary"), key)
    rows = held.join(messages.select(key, "ordinal", "role", "text"), key).where(F.col("ordinal") <= F.col("boundary"))
    left = rows.join(dropped.select("repair_id", "ordinal").distinct(), ["repair_id", "ordinal"], "left_anti")
    at_boundary = F.col("ordinal") == F.col("boundary")
    line = F.concat_ws("\x1f", "role", F.md5(F.coalesce("text", F.lit(""))))
    out = left.groupBy(key, "fate").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda m: m["line"]), "\n")).alias("messages_hash"),
        F.count_if(at_boundary).alias("__n"),
        F.max(F.when(at_boundary, F.col("role"))).alias("__role"),
    )
    return out.where("__n = 1 and __role = 'assistant'").drop("__n", "__role")
