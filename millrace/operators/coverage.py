"""Coverage of one table by another, duplicate keys, and keyed differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(left: DataFrame, right: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """Status of every key of either side: matched, mismatch (where `same`, over l and r, is false), missing (only left), unknown (only right)."""
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    status = F.when(F.col(f"r.{key}").isNull(), "missing").when(F.col(f"l.{key}").isNull(), "unknown")
    status = status.when(~F.coalesce(same, F.lit(False)), "mismatch") if same is not None else status
    return both.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), status.otherwise("matched").alias("status"))


def outer_diff(old: DataFrame, new: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, change (added, removed, changed, unchanged) and the changed fields, in the order given, joined by commas."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    differs = [F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]
    changed = F.concat_ws(",", *differs)
    change = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(changed != "", "changed").otherwise("unchanged")
    return both.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), change.alias("change"), F.when(change == "changed", changed).otherwise("").alias("fields"))


def reference_problems(references: DataFrame, artifacts: DataFrame, keys: list[str], pin: str) -> DataFrame:
    """References (keys) whose artifact is absent or has no content hash in `pin`, with `problem`. Artifacts are unique by their keys; a
    reference with a null key is absent."""
    held = artifacts.select(*keys, F.lit(True).alias("__there"), F.col(pin).alias("__pin"))
    problem = F.when(F.col("__there").isNull(), "absent").when(F.col("__pin").isNull(), "not pinned")
    return references.join(held, keys, "left").select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())
