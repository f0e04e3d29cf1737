"""The report over policies: what came of their attempts, and rates over chosen policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summaries import count_true, median_int, sum_known


def status_text(status: Column, known: list[str]) -> Column:
    """Aggregate: `status=n` for the known statuses that are there, sorted, joined by a comma; empty for none. One pass, no lists of rows."""
    counted = (F.struct(F.lit(s).alias("s"), count_true(status == s).alias("n")) for s in sorted(known))
    return F.array_join(F.transform(F.filter(F.array(*counted), lambda x: x["n"] > 0), lambda x: F.concat(x["s"], F.lit("="), x["n"].cast("string"))), ", ")


def policy_report(attempts: DataFrame, policy: str, layers: dict[str, list[str]], counts: dict[str, Column], sums: dict[str, Column], settings: list[str], duration: str) -> DataFrame:
    """A row per policy: attempts, counts of the known statuses of each layer as text, attempts for which a condition holds, sums of what
    is known (null if nothing is), the distinct settings as sorted text, and the exact median duration cut to a whole number.

    settings are meant to have few values per policy, as models and temperatures have: these are what is listed.
    """
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ")
    return attempts.groupBy(policy).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        *(status_text(F.col(c), known).alias(f"{c}_counts") for c, known in layers.items()),
        *(count_true(c).alias(name) for name, c in counts.items()),
        *(sum_known(c).cast("long").alias(name) for name, c in sums.items()),
        *(listed(c).alias(f"{c}_values") for c in settings),
        median_int(F.col(duration)).alias("median_duration"),
    )


def expectation_met(report: DataFrame, expected: dict[str, dict[str, Column]], policy: str, attempts: str) -> DataFrame:
    """Policies with an expectation, and whether all their attempts meet it: each of its counts is the number of attempts."""
    met = F.lit(None).cast("boolean")
    for name, counts in expected.items():
        ok = F.lit(True)
        for c in counts.values():
            ok = ok & (c == F.col(attempts))
        met = F.when(F.col(policy) == name, ok).otherwise(met)
    return report.select(policy, met.alias("met")).where(F.col("met").isNotNull())


def named_rates(report: DataFrame, policy: str, attempts: str, **rates: tuple[str, list[str] | None]) -> DataFrame:
    """(name, n, total) by name of a rate: the sum of a count and of attempts over the policies named (None: all). Both are null if none of
    them is there."""
    out = []
    for name, (count, names) in rates.items():
        taken = F.lit(True) if names is None else F.col(policy).isin(*names)
        out.append(F.struct(F.lit(name).alias("name"), F.sum(F.when(taken, F.col(count))).alias("n"), F.sum(F.when(taken, F.col(attempts))).alias("total")))
    return report.agg(F.array(*out).alias("r")).select(F.inline("r"))
