"""Preference data: comparisons of two actions in one context, their adjudication, and oriented pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFERRED = "preferred"


def alternatives(actions: DataFrame, context: str, action: str, evidence: str) -> DataFrame:
    """(context, action, evidence, n_evidence): the distinct actions of each context, the least evidence for each and how much there is.
    Rows without context or action do not count; evidence that is there twice counts once."""
    rows = actions.where(F.col(context).isNotNull() & F.col(action).isNotNull())
    return rows.groupBy(context, action).agg(F.min(evidence).alias("evidence"), F.countDistinct(evidence).alias("n_evidence"))


def comparisons(found: DataFrame, context: str, action: str) -> DataFrame:
    """All unordered pairs of different actions of a context, the lesser as `left`. Contexts with one action have none.

    found: the distinct actions of `alternatives`; a context's pairs grow with the square of its distinct actions, which are what is
    asked for.
    """
    left, right = found.select(context, F.col(action).alias("left")), found.select(context, F.col(action).alias("right"))
    pairs = left.join(right, context).where(F.col("left") < F.col("right"))
    return pairs.withColumn("comparison_id", F.concat(F.lit("comparison_"), F.md5(F.concat_ws("\x1f", context, "left", "right"))))


def coverage(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """(problem, key): keys that are asked and not answered, answered and not asked, or answered twice or more."""
    missing = asked.join(answered, key, "left_anti").select(F.lit("missing").alias("problem"), key)
    unknown = answered.join(asked, key, "left_anti").select(F.lit("unknown").alias("problem"), key)
    again = answered.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), key)
    return missing.unionByName(unknown).unionByName(again)


def oriented(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The pairs whose verdict (comparison_id, outcome, preferred) is `preferred`, as chosen and rejected, with a pair_id of their own.
    A preferred action that is none of the two fails the job; comparisons without verdict or with another one give no pair."""
    joined = pairs.join(verdicts.where(F.col("outcome") == PREFERRED), "comparison_id")
    is_left, is_right = F.col("preferred").eqNullSafe(F.col("left")), F.col("preferred").eqNullSafe(F.col("right"))
    wrong = F.raise_error(F.concat(F.lit("neither alternative is preferred: "), "comparison_id")).cast("string")
    chosen = F.when(is_left, F.col("left")).when(is_right, F.col("right")).otherwise(wrong)
    out = joined.withColumn("chosen", chosen).withColumn("rejected", F.when(F.col("chosen") == F.col("left"), F.col("right")).otherwise(F.col("left")))
    return out.withColumn("pair_id", F.concat(F.lit("pair_"), F.md5(F.concat_ws("\x1f", "comparison_id", "chosen", "rejected")))).drop("left", "right", "preferred", "outcome")


def shared_prompt(left, right, n):
    """Whether two arrays begin with the same n elements, both having them."""
    return (F.size(left) >= n) & (F.size(right) >= n) & (F.slice(left, F.lit(1), n) == F.slice(right, F.lit(1), n))


def response_span(spans, start):
    """Of an array of (start, stop) the one span that begins at `start` or behind it, if it is the only one and begins there; else null."""
    later = F.filter(spans, lambda s: s["start"] >= start)
    return F.when((F.size(later) == 1) & (F.get(later, F.lit(0))["start"] == start), F.get(later, F.lit(0)))


def spans_in_order(spans, length):
    """Whether the spans are not empty, lie inside `length`, and each begins where the one before it ends or behind."""
    inside = F.forall(spans, lambda s: (s["start"] >= 0) & (s["stop"] > s["start"]) & (s["stop"] <= length))
    ordered = F.transform(spans, lambda s, i: (i == 0) | (s["start"] >= F.get(spans, i - 1)["stop"]))
    return inside & F.forall(ordered, lambda x: F.coalesce(x, F.lit(True)))
