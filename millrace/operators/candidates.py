"""Candidates for training: what became of a run, joined with its one review, gated for every way that its records may be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gates import first_reason
from ..functions.statuses import training_block

#: The ways of use, and what is said where nothing is against one.
PATHS = {"positive": "accepted review, nothing against it as an example", "negative": "accepted review, nothing against it as a counterexample", "preference": "the evidence of the run can be trusted"}


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right on a key that both have once for each row: a key that is null, repeated or on one side only fails the job."""
    counts = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = counts(left, "__l").join(counts(right, "__r"), key, "full")
    told = F.raise_error(F.format_string("%s: %d rows on the left, %d on the right", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce("__l", F.lit(0)), F.coalesce("__r", F.lit(0))))
    right_keys = both.where((F.coalesce("__l", F.lit(0)) == 1) & (F.coalesce("__r", F.lit(0)) == 1) & F.col(key).isNotNull() | told.cast("boolean")).select(key)
    return left.join(right_keys, key).join(right, key)


def review_block(status: Column, decision: Column) -> Column:
    """Why a review does not accept, null if it does."""
    accepted = status.eqNullSafe(F.lit("reviewed")) & decision.eqNullSafe(F.lit("accepted"))
    return F.when(~accepted, first_reason((status == "not_reviewed", "not reviewed"), (decision == "rejected", "rejected in review"), (decision == "needs_followup", "review asks for more"), otherwise="not accepted in review"))


def adjudication_block(finding: Column, hack_decision: Column) -> Column:
    """An ambiguous finding that nobody has looked at."""
    return F.when((finding == "ambiguous") & hack_decision.isNull(), "ambiguous finding without adjudication")


def positive_block(finding: Column, hack_decision: Column) -> Column:
    """Why findings forbid an example: a review that confirms, a confirmed finding, an ambiguous one that is not cleared, in this order."""
    return first_reason((hack_decision == "confirmed", "finding confirmed in review"), (finding == "confirmed", "confirmed finding"), ((finding == "ambiguous") & ~hack_decision.eqNullSafe(F.lit("cleared")), "ambiguous finding not cleared"))


def candidates(runs: DataFrame, reviews: DataFrame, key: str, evidence: Sequence[str], model_type: str, barred_splits: tuple[str, ...]) -> DataFrame:
    """One row per run: key, missing (names of the evidence that is null, in the order given), and for each of PATHS `<path>` (whether it
    may be used that way) and `<path>_reason`; downstream (some way is open), analysis_only (reviewed, but none is) and closed (none is,
    and there is no accepted review).

    runs: key, policy_type, split, leaked, failed, detection, finding, task_success, and the evidence; reviews: key, status, decision,
    hack_decision. There is one review for each run. Positive and negative use need an accepted review first, then what all training
    needs, then adjudication of ambiguous findings; preferences need what all training needs alone.
    """
    rows = one_to_one(runs, reviews, key)
    c = F.col
    common = training_block(c("policy_type"), c("split"), c("leaked"), c("failed"), c("detection"), {n: c(n) for n in evidence}, model_type, barred_splits)
    rows = rows.withColumns({"__common": common, "__review": review_block(c("status"), c("decision"))})
    gated = F.coalesce("__review", "__common", adjudication_block(c("finding"), c("hack_decision")))
    blocks = {"positive": F.coalesce(gated, positive_block(c("finding"), c("hack_decision"))), "negative": F.coalesce(gated, F.when(c("task_success"), "the run succeeded")), "preference": c("__common")}
    missing = F.filter(F.array(*(F.when(c(n).isNull(), F.lit(n)) for n in evidence)), lambda x: x.isNotNull())
    rows = rows.select(key, missing.alias("missing"), "__review", *(b.alias(f"__{p}") for p, b in blocks.items()))
    flags = [x for p, said in PATHS.items() for x in (c(f"__{p}").isNull().alias(p), F.coalesce(f"__{p}", F.lit(said)).alias(f"{p}_reason"))]
    rows = rows.select(key, "missing", "__review", *flags)
    open_way = c("positive") | c("negative") | c("preference")
    return rows.select(key, "missing", *(x for p in PATHS for x in (p, f"{p}_reason")), open_way.alias("downstream"), (~open_way & c("__review").isNull()).alias("analysis_only"), (~open_way & c("__review").isNotNull()).alias("closed"))


def candidate_counts(rows: DataFrame) -> DataFrame:
    """One row: n, and how many are open for each way, downstream, for analysis only, and closed."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(p).alias(f"n_{p}") for p in (*PATHS, "downstream", "analysis_only", "closed")))
