"""Packs of tasks: the lock of their splits, who owns a task, and files that nobody asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markers import path_markers


def split_problems(lock: DataFrame, manifests: DataFrame, task: str, split: str) -> DataFrame:
    """(task, problem): `twice` in the lock, `unlocked`, `unknown` to the manifests, or `mismatch` of its one split. Manifests are unique by
    task."""
    locked = lock.groupBy(task).agg(F.count(F.lit(1)).alias("__n"), F.min(split).alias("__locked"))
    both = locked.join(manifests.select(task, F.col(split).alias("__own"), F.lit(True).alias("__there")), task, "full")
    problem = (
        F.when(F.col("__n") > 1, "twice")
        .when(F.col("__n").isNull(), "unlocked")
        .when(F.col("__there").isNull(), "unknown")
        .when(~F.col("__locked").eqNullSafe(F.col("__own")), "mismatch")
    )
    return both.select(task, problem.alias("problem")).where(F.col("problem").isNotNull())


def owners(manifests: DataFrame, task: str, path: str) -> DataFrame:
    """(task, n, path): how many manifests claim a task, and the path of the one that owns it, null if it is not the only one."""
    found = manifests.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("__path"))
    return found.select(task, "n", F.when(F.col("n") == 1, F.col("__path")).alias(path))


def uncovered(files: DataFrame, path: str, required: DataFrame, root: str) -> DataFrame:
    """Files that neither are a required path nor lie under one. Paths meet their folders by equality, so nothing is compared by prefix."""
    folders = files.select(path).distinct().select(path, F.explode(path_markers(F.col(path))).alias(root))
    covered = folders.join(required.select(root).distinct(), root, "left_semi").select(path).distinct()
    return files.join(covered, path, "left_anti")
