"""Linkage of calls, the messages that answer them and the results behind those: by key and by place at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import first_reason

#: What may be wrong with a link, the first that holds.
PROBLEMS = (
    "message without id",
    "id answered twice",
    "id called twice",
    "no call",
    "call is no tool call",
    "call comes later",
    "result missing",
    "result surplus",
    "result swapped",
    "name differs",
    "content differs",
    "arguments differ",
)


def ordinals(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with their place in the group, from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def _zipped(calls: DataFrame, messages: DataFrame, results: DataFrame, group: str) -> DataFrame:
    """Messages and results of a group, paired by ordinal and by id at once, with what calls have the message's id.

    A row holds both sides (same ordinal), or one of them; `result_at` is the ordinal at which the result with the message's id is, and
    `answered_at` the ordinal of the message that has the result's id, so that what is at the wrong place is told from what is missing.
    Rows of all three are dealt by group alone, and only sorted by id and by ordinal where they are.
    """
    sides = {
        "__c": calls.where("id is not null").select(group, F.lit(None).cast("long").alias("ordinal"), "id", F.struct("at", "is_tool", "name", "arguments").alias("__c")),
        "__m": messages.select(group, "ordinal", "id", F.struct("at", "name", "content").alias("__m")),
        "__r": results.select(group, "ordinal", "id", F.struct("name", "content", "arguments").alias("__r")),
    }
    rows = sides["__c"].repartition(group)
    for name in ("__m", "__r"):
        rows = rows.unionByName(sides[name].repartition(group), allowMissingColumns=True)
    same_id = Window.partitionBy(group, "id")
    # What is null equals nothing, though a window has all of it in one partition.
    known = lambda c: F.when(F.col(group).isNotNull() & F.col("id").isNotNull(), c.over(same_id))
    at = lambda name: F.when(F.col(name).isNotNull(), F.col("ordinal"))
    found = {"n_calls": F.count("__c"), "call": F.min("__c"), "n_messages": F.count("__m"), "answered_at": F.min(at("__m")), "result_at": F.min(at("__r"))}
    rows = rows.select(group, "ordinal", "id", *sides, *(known(c).alias(f"__{n}") for n, c in found.items())).where("__c is null")
    m = F.when(F.col("__m").isNotNull(), F.struct("id", "__m.*", "__result_at", "__n_messages", "__n_calls", "__call"))
    r = F.when(F.col("__r").isNotNull(), F.struct("id", "__r.*", "__answered_at"))
    apart = F.when(F.col(group).isNull(), F.col("__m").isNull())
    both = rows.select(group, "ordinal", apart.alias("__apart"), m.alias("__m"), r.alias("__r")).groupBy(group, "ordinal", "__apart").agg(F.first("__m", ignorenulls=True).alias("__m"), F.first("__r", ignorenulls=True).alias("__r"))
    told = lambda side, names: [F.col(f"__{side}.{c}").alias(f"{side}_{c}") for c in names]
    there = lambda side: F.when(F.col(f"__{side}").isNotNull(), True)
    n_calls = F.when(F.col("__m.__n_calls") > 0, F.col("__m.__n_calls"))
    of_ids = {"result_at": F.col("__m.__result_at"), "n_messages": F.col("__m.__n_messages"), "n_calls": n_calls, "call": F.col("__m.__call"), "answered_at": F.col("__r.__answered_at")}
    return both.select(group, "ordinal", there("m").alias("has_message"), there("r").alias("has_result"), *told("m", ("id", "at", "name", "content")), *told("r", ("id", "name", "content", "arguments")), *(c.alias(n) for n, c in of_ids.items()))


def linked_calls(calls: DataFrame, messages: DataFrame, results: DataFrame, group: str) -> DataFrame:
    """One row per place of a group's messages and results: group, ordinal, id, problem (null if all is right).

    calls: group, id, at, is_tool, name, arguments; messages (in the order that they have): group, ordinal, id, at, name, content;
    results: group, ordinal, id, name, content, arguments. Ordinals are places from 0 in their own sequence. Message k belongs to
    result k and to the call that has its id and comes before it. Problems are those of PROBLEMS: `result missing` is a message whose
    id no result has, `result surplus` a result whose id no message has, `result swapped` an id that stands at different
    places; results without ids are taken by place alone, and are missing or surplus where the other sequence is longer.
    """
    rows = _zipped(calls, messages, results, group)
    has, got = F.col("has_message").isNotNull(), F.col("has_result").isNotNull()
    keyed = F.col("r_id").isNotNull()
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    tests = (
        has & F.col("m_id").isNull(),
        has & (F.col("n_messages") > 1),
        has & (F.col("n_calls") > 1),
        has & F.col("n_calls").isNull(),
        has & ~F.coalesce(F.col("call.is_tool"), F.lit(False)),
        has & (F.col("call.at") >= F.col("m_at")),
        has & (~got | keyed & F.col("result_at").isNull()),
        got & (~has | keyed & F.col("answered_at").isNull()),
        has & got & keyed & differs("m_id", "r_id"),
        has & got & (differs("m_name", "r_name") | differs("call.name", "r_name")),
        has & got & differs("m_content", "r_content"),
        has & got & differs("call.arguments", "r_arguments"),
    )
    problem = first_reason(*zip(tests, PROBLEMS, strict=True))
    return rows.select(group, "ordinal", F.coalesce("m_id", "r_id").alias("id"), problem.alias("problem"))


def without_calls(messages: DataFrame, results: DataFrame, dropped: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """messages and results without those of the dropped calls (group, id), removed in lockstep: result k goes with message k.

    Groups whose messages and results are not equally many fail the job, as no result can be told from another there. Ordinals of what
    is left are counted anew.
    """
    counts = messages.groupBy(group).agg(F.count(F.lit(1)).alias("__m")).join(results.groupBy(group).agg(F.count(F.lit(1)).alias("__r")), group, "full")
    told = F.raise_error(F.format_string("group %s has %d messages and %d results", F.col(group).cast("string"), F.coalesce("__m", F.lit(0)), F.coalesce("__r", F.lit(0))))
    fit = counts.where(F.col("__m").eqNullSafe(F.col("__r")) | told.cast("boolean")).select(group)
    gone = messages.join(dropped.select(group, "id").distinct(), [group, "id"], "left_semi").select(group, "ordinal")

    def left(side: DataFrame) -> DataFrame:
        kept = side.join(fit, group).join(gone, [group, "ordinal"], "left_anti")
        return ordinals(kept.withColumnRenamed("ordinal", "__was"), group, ["__was"]).drop("__was").select(*side.columns)

    return left(messages), left(results)

