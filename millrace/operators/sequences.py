"""Operators over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: str, order: list[str], same: list[str], least: int = 2) -> DataFrame:
    """Maximal runs of at least `least` neighbours that agree in `same`: group, run number, first order key, length."""
    w = Window.partitionBy(group).orderBy(*order)
    key = F.struct(*same)
    fresh = F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)
    runs = df.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(w))
    found = runs.groupBy(group, "run").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct(*order)).alias("__first"), *(F.first(c).alias(c) for c in same))
    return found.where(F.col("length") >= least)


def running_state(df: DataFrame, group: str, order: list[str], update: Column, name: str) -> DataFrame:
    """The last value that `update` set before each row; rows where it is null leave the state."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(update, ignorenulls=True).over(w))


def remaining(group: str, order: list[str]) -> Column:
    w = Window.partitionBy(group).orderBy(*order)
    return (F.count(F.lit(1)).over(Window.partitionBy(group)) - F.row_number().over(w)).cast("long")


def up_to_last(df: DataFrame, group: str, ordinal: str, is_boundary: Column) -> DataFrame:
    """Rows up to and including the last boundary of their group; groups without one are gone."""
    last = F.max(F.when(is_boundary, F.col(ordinal))).over(Window.partitionBy(group))
    return df.withColumn("__last", last).where(F.col(ordinal) <= F.col("__last")).drop("__last")


def contiguous(df: DataFrame, group: str, ordinal: str, start: int) -> DataFrame:
    """group, n and ok: whether the ordinals are start, start + 1, ... without gap or repeat."""
    found = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    ok = (F.col("lo") == start) & (F.col("hi") == start + F.col("n") - 1) & (F.col("d") == F.col("n"))
    return found.select(group, "n", F.coalesce(ok, F.lit(False)).alias("ok"))


def merged_intervals(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Closed intervals of a group that overlap or touch, as one: group, start, end."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(group, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def chunks(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Adds `chunk`: the number, from 0, of the fixed-size chunk that a row falls in."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def unordered_pairs(df: DataFrame, context: list[str], action: str) -> DataFrame:
    """All pairs a < b of distinct actions that share a context. Meant for small sets of actions: the actions of a context are
    reduced to distinct ones first, so repeated evidence adds no pairs."""
    actions = df.groupBy(*context).agg(F.array_sort(F.collect_set(action)).alias("actions")).where(F.size("actions") > 1)
    pairs = F.flatten(F.transform("actions", lambda a, i: F.transform(F.slice(F.col("actions"), i + 2, F.size("actions")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return actions.select(*context, F.inline(pairs))
