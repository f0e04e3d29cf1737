"""Data-quality rules as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: Column, **rules: Column) -> DataFrame:
    """(rule, key) for each rule that does not hold for a row; a null result does not hold. One pass over the rows."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.explode(broken).alias("rule"), key.alias("key"))


def strict(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows; a row that is not ok fails the job."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
