"""Aggregates whose treatment of nulls, zeros and order is part of their meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_or_null(c: Column) -> Column:
    """Null if any value is null, or there is none."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def sum_known(c: Column) -> Column:
    """Nulls skipped; null only if nothing is known."""
    return F.sum(c)


def count_true(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def median_int(c: Column) -> Column:
    """Exact median, cut to a whole number; null for no values."""
    return F.floor(F.median(c)).cast("long")


def layered_counts(df: DataFrame, group: str, **layers: str) -> DataFrame:
    """group, layer, status, n for each status column; null statuses are left out. One pass: columns are unpivoted, then counted."""
    pairs = F.array(*(F.struct(F.lit(name).alias("layer"), F.col(c).cast("string").alias("status")) for name, c in layers.items()))
    long = df.select(group, F.inline(pairs)).where(F.col("status").isNotNull())
    return long.groupBy(group, "layer", "status").agg(F.count(F.lit(1)).alias("n"))


def rolled_up(counts: DataFrame, group: str) -> DataFrame:
    """Counts of `layered_counts` summed over all groups."""
    return counts.groupBy("layer", "status").agg(F.sum("n").alias("n"))


def zero_filled(df: DataFrame, group: str, column: str, values: list[str]) -> DataFrame:
    """Counts by group for each of the values, 0 where there is none; nulls and other values are not counted."""
    one = [count_true(F.col(column) == v).alias(v) for v in values]
    wide = df.groupBy(group).agg(*one)
    pairs = F.array(*(F.struct(F.lit(v).alias("status"), F.col(f"`{v}`").alias("n")) for v in values))
    return wide.select(group, F.inline(pairs))


def first_seen(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, values): the distinct values of each group in the order of their first appearance; nulls do not count.

    Rows are first reduced to one for each group and value, so a group's array is as long as it has values, not rows.
    """
    once = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(F.struct(*order)).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", F.col(value).alias("v"))))
    return once.groupBy(group).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))
