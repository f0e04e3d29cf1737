"""Replays, controls and audits held against what they should give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_matches(source: DataFrame, replay: DataFrame, attempt: str, name: str, digest: str) -> DataFrame:
    """(attempt, matches, n, n_matched, matched): by artifact of either side whether both have it with one digest; a null digest
    matches nothing. Artifacts are unique by attempt and name on each side."""
    s, r = (df.select(attempt, name, F.col(digest).alias(side)) for df, side in ((source, "__s"), (replay, "__r")))
    both = s.join(r, [attempt, name], "full").select(attempt, name, F.coalesce(F.col("__s") == F.col("__r"), F.lit(False)).alias("__same"))
    entries = F.array_sort(F.collect_list(F.struct(name, "__same")))
    found = both.groupBy(attempt).agg(F.map_from_entries(entries).alias("matches"), F.count(F.lit(1)).alias("n"), F.count_if("__same").alias("n_matched"))
    return found.withColumn("matched", F.col("n") == F.col("n_matched"))


def expectation_rows(df: DataFrame, key: str, **fields: tuple[Column, Column]) -> DataFrame:
    """(key, field, expected, actual, matched) for every field (expected, actual) whose expectation is declared, i.e. not null."""
    rows = F.array(*(F.struct(F.lit(n).alias("field"), e.cast("string").alias("expected"), a.cast("string").alias("actual")) for n, (e, a) in fields.items()))
    declared = df.select(key, F.inline(F.filter(rows, lambda x: x["expected"].isNotNull())))
    return declared.withColumn("matched", F.col("expected").eqNullSafe(F.col("actual")))


def control_match(expected_status: Column, status: Column, expected_steps: Column, steps: Column) -> Column:
    """Whether status and steps, in their order, are those expected; what is not expected (null) matches."""
    same = lambda e, a: e.isNull() | e.eqNullSafe(a)
    return same(expected_status, status) & same(expected_steps, steps)


def unlinked_calls(df: DataFrame, group: str, call: Column, result: Column) -> DataFrame:
    """(group, n_ids, n_unlinked): ids that are not there as often as a call as they are as a result. Rows without an id do not count."""
    ids = df.select(group, F.inline(F.array(F.struct(call.alias("id"), F.lit(1).alias("side")), F.struct(result.alias("id"), F.lit(-1).alias("side"))))).where(F.col("id").isNotNull())
    return ids.groupBy(group, "id").agg(F.sum("side").alias("d")).groupBy(group).agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("d") != 0).alias("n_unlinked"))
