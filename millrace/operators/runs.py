"""Runs of calls that repeat the one before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _marked(calls: DataFrame, group: str, ordinal: str, identity: list[str], status: str, before: str, after: str, observation: str) -> DataFrame:
    """calls with `again`: whether a successful call is the same as the successful one before it, on an unchanged workspace, which it
    leaves unchanged, with the same observation."""
    w = Window.partitionBy(group).orderBy(ordinal)
    lag = lambda c: F.lag(c).over(w)
    again = (F.col(status) == "ok") & (lag(status) == "ok") & (F.col(before) == lag(after)) & (F.col(after) == lag(after)) & (F.col(observation) == lag(observation))
    for c in identity:
        again = again & (F.col(c) == lag(c))
    return calls.withColumn("again", F.coalesce(again, F.lit(False)))


def repeated_calls(calls: DataFrame, group: str, ordinal: str, identity: list[str], status: str, before: str, after: str, observation: str) -> DataFrame:
    """A row per maximal run: its group, the ordinal of its first call (`baseline`), its identity, and how many calls repeat it.

    Unknown values (null) are equal to nothing. Calls next to each other are those with neighbouring ordinals in a group.
    """
    marked = _marked(calls, group, ordinal, identity, status, before, after, observation)
    run = F.count_if(~F.col("again")).over(Window.partitionBy(group).orderBy(ordinal))
    found = marked.withColumn("run", run).groupBy(group, "run").agg(F.min(ordinal).alias("baseline"), F.count_if("again").alias("n_redundant"), *(F.min_by(c, ordinal).alias(c) for c in identity))
    return found.where("n_redundant > 0").drop("run")


def without(calls: DataFrame, group: str, ordinal: str, identity: list[str], status: str, before: str, after: str, observation: str) -> DataFrame:
    """The calls that repeat nothing, with `call_id`: their number in the group, from 1, in four digits."""
    left = _marked(calls, group, ordinal, identity, status, before, after, observation).where(~F.col("again")).drop("again")
    return left.withColumn("call_id", F.format_string("tool_call_%04d", F.row_number().over(Window.partitionBy(group).orderBy(ordinal))))
