"""Evidence that names a place in a transcript, rebuilt from the transcript and held against what was recorded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import first_reason
from ..functions.hashing import derived_id

#: Rows before an action without which it is no evidence.
LEAST_CONTEXT = 2
PROBLEMS = ("unknown transcript", "no such place", "no action", "too little context", "id not derived", "context differs", "action differs", "rest differs")


def chained(rows: DataFrame, group: str, ordinal: str, digest: str, name: str = "prefix") -> DataFrame:
    """rows with the hash of all rows before them in their group: a chain, the MD5 of the hash before and the digest of the row before.

    The first row of a group has the MD5 of nothing. `digest` is a text column; null counts as empty. Rows are dealt by group and
    stream through in order, so each costs one hash, and a group may be of any length: only the last hash is held.
    """
    schema = rows.withColumn(name, F.lit("")).schema

    def fold(batches):
        last, state = None, ""
        for batch in batches:
            out = []
            for key, value in zip(batch.column(group).to_pylist(), batch.column(digest).to_pylist(), strict=True):
                if (key,) != last:
                    last, state = (key,), hashlib.md5(b"").hexdigest()
                out.append(state)
                state = hashlib.md5((state + (value or "")).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return rows.repartition(group).sortWithinPartitions(group, ordinal).mapInArrow(fold, schema)


def occurrences(messages: DataFrame, group: str) -> DataFrame:
    """(group, ordinal, n_left, role, action, prefix) of every message: its place from 0, how many come after, its content's hash and
    the chain over those before. messages: group, at (any order of places), role, name, content."""
    whole = Window.partitionBy(group)
    own = F.md5(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("content", F.lit(""))))
    rows = messages.select(group, (F.row_number().over(whole.orderBy("at")) - 1).cast("long").alias("ordinal"), F.count(F.lit(1)).over(whole).alias("n"), "role", F.md5(F.coalesce("content", F.lit(""))).alias("action"), own.alias("digest"))
    return chained(rows, group, "ordinal", "digest").select(group, "ordinal", (F.col("n") - F.col("ordinal") - 1).alias("n_left"), "role", "action", "prefix")


def evidence_id(group: Column, ordinal: Column, action: Column, prefix: Column) -> Column:
    return derived_id("evidence", group, ordinal, action, prefix)


def recorded(found: DataFrame, group: str) -> DataFrame:
    """The evidence that the actions among occurrences give: evidence_id, group, ordinal, n_left, action, prefix."""
    kept = found.where((F.col("role") == "assistant") & (F.col("ordinal") >= LEAST_CONTEXT))
    return kept.select(evidence_id(F.col(group), F.col("ordinal"), F.col("action"), F.col("prefix")).alias("evidence_id"), group, "ordinal", "n_left", "action", "prefix")


def held_against(evidence: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """evidence (evidence_id, group, ordinal, n_left, action, prefix) with `problem`, the first of PROBLEMS that holds, or null.

    The place is joined by (group, ordinal); whether the transcript is there at all is one more join on its key. `id not derived`
    looks at the record alone. Evidence with a null group or ordinal names nothing: its transcript, or its place, is unknown.
    """
    there = found.select(F.col(group), F.col("ordinal"), F.col("role").alias("__role"), F.col("n_left").alias("__left"), F.col("action").alias("__action"), F.col("prefix").alias("__prefix"))
    known = found.select(group).distinct().withColumn("__known", F.lit(True))
    rows = evidence.join(there, [group, "ordinal"], "left").join(known, group, "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    tests = (
        F.col("__known").isNull(),
        F.col("__left").isNull(),
        ~F.col("__role").eqNullSafe(F.lit("assistant")),
        F.col("ordinal") < LEAST_CONTEXT,
        ~F.col("evidence_id").eqNullSafe(evidence_id(F.col(group), F.col("ordinal"), F.col("action"), F.col("prefix"))),
        ~same("prefix", "__prefix"),
        ~same("action", "__action"),
        ~same("n_left", "__left"),
    )
    return rows.withColumn("problem", first_reason(*zip(tests, PROBLEMS, strict=True))).select(*evidence.columns, "problem")
