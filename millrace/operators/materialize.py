"""Token rows of examples and of preference pairs: all of a record or nothing, failures as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import first_reason

#: Fixed value: the label of a token that is not learned from.
IGNORED = -100
ROLES = ("system", "user", "assistant", "tool")


def branches(messages: DataFrame, group: str, limit: int, tokens: Callable[[Column, Column], Column], last_only: bool = False) -> DataFrame:
    """One row per group: group, error, length, n_prompt, prompt (hash of the tokens before the last message), ids, labels.

    messages: group, ordinal, role, content. `tokens` gives the ids of a message by (role, content). Labels are the ids of the
    assistant's messages, or of the last message alone (last_only), and IGNORED elsewhere. error is the first that holds, else null:
    `places not contiguous`, `unknown role`, `no content`, `no assistant` (last_only: the last message is not one), `no response`
    (nothing to learn from). ids and labels are null on errors and beyond `limit` tokens: lengths are summed first, so what is
    gathered for a group is at most `limit` long.
    """
    last = F.max("ordinal").over(Window.partitionBy(group))
    rows = messages.select(group, "ordinal", "role", "content", last.alias("last"), tokens(F.col("role"), F.col("content")).alias("ids"))
    own = (F.col("role") == "assistant") & ((F.col("ordinal") == F.col("last")) if last_only else F.lit(True))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(False))).withColumn("size", F.coalesce(F.size("ids"), F.lit(0)))
    sums = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("ordinal").alias("d"),
        F.min("ordinal").alias("lo"),
        F.max("ordinal").alias("hi"),
        F.count_if(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).alias("n_strange"),
        F.count_if(F.col("content").isNull()).alias("n_null"),
        F.count_if("own").alias("n_own"),
        F.sum("size").alias("length"),
        F.sum(F.when(F.col("ordinal") < F.col("last"), F.col("size")).otherwise(0)).alias("n_prompt"),
        F.sum(F.when(F.col("own"), F.col("size")).otherwise(0)).alias("n_learned"),
    )
    contiguous = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    tests = ((~F.coalesce(contiguous, F.lit(False)), "places not contiguous"), (F.col("n_strange") > 0, "unknown role"), (F.col("n_null") > 0, "no content"), (F.col("n_own") == 0, "no assistant"), (F.col("n_learned") == 0, "no response"))
    sums = sums.select(group, first_reason(*tests).alias("error"), "length", "n_prompt", "n_learned")
    short = sums.where(F.col("error").isNull() & (F.col("length") <= limit)).select(group)
    labels = F.when(F.col("own"), F.col("ids")).otherwise(F.array_repeat(F.lit(IGNORED).cast("long"), F.col("size")))
    kept = rows.join(short, group, "left_semi").withColumn("labels", labels)
    parts = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ordinal", "ids", "labels"))).alias("parts"))
    ids = parts.select(group, F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.flatten(F.transform("parts", lambda p: p["labels"])).alias("labels"))
    return sums.join(ids, group, "left")


def _union(failed: Column, kind: Column, error: Column, **payload: Column) -> list[Column]:
    """status, failure_kind and error, and the payload that only completed records have."""
    return [F.when(failed, "failed").otherwise("completed").alias("status"), F.when(failed, kind).alias("failure_kind"), F.when(failed, error).alias("error"), *(F.when(~failed, c).alias(n) for n, c in payload.items())]


def examples(messages: DataFrame, key: str, limit: int, tokens: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per example: key, status, failure_kind, error, observed_length, length, n_supervised, n_ignored, ids, labels.

    `completed` records have the last five; `failed` ones have none of them, but a kind and an error: `materialization_error`, or
    `sequence_length_exceeded` with the length observed.
    """
    found = branches(messages, key, limit, tokens)
    long = F.col("error").isNull() & (F.col("length") > limit)
    failed = F.col("error").isNotNull() | long
    kind = F.when(long, "sequence_length_exceeded").otherwise("materialization_error")
    told = F.coalesce("error", F.format_string(f"%d tokens of {limit}", "length"))
    columns = _union(failed, kind, told, length=F.col("length"), n_supervised=F.col("n_learned"), n_ignored=F.col("length") - F.col("n_learned"), ids=F.col("ids"), labels=F.col("labels"))
    return found.select(key, *columns[:3], F.when(long, F.col("length")).alias("observed_length"), *columns[3:])


def pairs(wanted: DataFrame, messages: DataFrame, key: str, limit: int, tokens: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per pair: key, status, failure_kind, error, observed_chosen, observed_rejected, n_prompt, and ids and labels of both sides.

    wanted: key, chosen, rejected (branches); messages: branch, ordinal, role, content, a branch being the context and one action.
    A pair is whole or failed: an error of one side (chosen first), `branch unknown`, `prompts differ` or `responses equal` fails it, and
    so does a side beyond the limit, with both lengths observed. No side of a failed pair has a payload.
    """
    found = branches(messages, "branch", limit, tokens, last_only=True)
    hashed = found.withColumn("whole", F.md5(F.array_join("ids", ","))).withColumn("prompt", F.slice("ids", F.lit(1), F.col("n_prompt").cast("int")))
    side = lambda s: hashed.select(F.col("branch").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("error", "length", "n_prompt", "prompt", "whole", "ids", "labels")))
    both = wanted.select(key, "chosen", "rejected").join(side("chosen"), "chosen", "left").join(side("rejected"), "rejected", "left")
    error_of = lambda s: F.when(F.col(f"{s}_length").isNull(), f"{s}: branch unknown").otherwise(F.concat(F.lit(f"{s}: "), F.col(f"{s}_error")))
    long = (F.col("chosen_length") > limit) | (F.col("rejected_length") > limit)
    late = F.when(~F.coalesce(long, F.lit(False)), F.when(F.col("chosen_prompt") != F.col("rejected_prompt"), "prompts differ").when(F.col("chosen_whole") == F.col("rejected_whole"), "responses equal"))
    error = F.coalesce(error_of("chosen"), error_of("rejected"), late)
    too_long = error.isNull() & long
    failed = error.isNotNull() | too_long
    kind = F.when(too_long, "sequence_length_exceeded").otherwise("materialization_error")
    told = F.coalesce(error, F.format_string(f"%d and %d tokens of {limit}", "chosen_length", "rejected_length"))
    payload = {"n_prompt": F.col("chosen_n_prompt")} | {f"{s}_{c}": F.col(f"{s}_{c}") for s in ("chosen", "rejected") for c in ("length", "ids", "labels")}
    columns = _union(failed, kind, told, **payload)
    observed = [F.when(too_long, F.col(f"{s}_length")).alias(f"observed_{s}") for s in ("chosen", "rejected")]
    return both.select(key, *columns[:3], *observed, *columns[3:])


def recounted(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(name, n): how many rows there are, by status, by kind of failure, and the named sums of columns, from the rows alone."""
    counted = lambda name, c: rows.where(F.col(c).isNotNull()).groupBy(F.concat(F.lit(name), F.col(c)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()))
    named = whole.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in whole.columns))))
    return named.unionByName(counted("status ", "status")).unionByName(counted("failure ", "failure_kind"))


def miscounted(declared: DataFrame, rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(name, declared, counted) of the counts (name, n) that a manifest declares otherwise than the rows give them; a count that one
    side lacks is 0 there."""
    both = declared.select("name", F.col("n").alias("declared")).join(recounted(rows, sums).withColumnRenamed("n", "counted"), "name", "full")
    return both.na.fill(0, ["declared", "counted"]).where("declared <> counted")
