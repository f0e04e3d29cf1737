"""Documents that include others, merged field by field in the order of their includes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import relative_path
from .stages import cut

#: Stands behind every include of a document: its own fields come last.
OWN = (1 << 31) - 1


def resolved(includes: DataFrame) -> DataFrame:
    """(path, ordinal, target, told): targets, relative to the folder of the document that names them, as paths from the root; target is
    null where one leads above it or is absolute."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "[^/]*$", "")).otherwise("")
    whole = F.when(~F.col("target").startswith("/"), relative_path(F.concat(folder, "target")))
    return includes.select("path", F.col("ordinal").cast("long").alias("ordinal"), whole.alias("target"), F.col("target").alias("told"))


def visits(entries: DataFrame, documents: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each entry leads: (entry, path, place), and (entry, error) of those that lead nowhere good.

    place is a list: the ordinals of the includes on the way, then OWN, so that the order of places is the order of merging: what
    is included, in listed order, and the document itself after that. Of the ways of one length to a document only the last is
    followed, as what it brings comes after what the others bring; a cycle is found on any way. One round for each level of includes.
    Errors: `cycle at <path>`, `no document <path>`, `<path> includes what is outside: <target>`.
    """
    edges = cut(resolved(includes).join(documents.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left"))
    place, trail = F.array().cast("array<long>"), F.array("path")
    front = cut(entries.select("entry", F.col("entry").alias("path")).select("entry", "path", place.alias("place"), trail.alias("trail")))
    missing = entries.join(documents.select(F.col("path").alias("entry")), "entry", "left_anti").select("entry", F.concat(F.lit("no document "), "entry").alias("error"))
    found, wrong = front.select("entry", "path", "place"), missing
    while front.limit(1).count():
        step = front.join(edges, "path")
        error = F.when(F.col("target").isNull(), F.concat("path", F.lit(" includes what is outside: "), "told")).when(F.col("there").isNull(), F.concat(F.lit("no document "), "target")).when(F.array_contains("trail", F.col("target")), F.concat(F.lit("cycle at "), "target"))
        step = cut(step.select("entry", F.col("target").alias("path"), F.concat("place", F.array("ordinal")).alias("place"), F.concat("trail", F.array("target")).alias("trail"), error.alias("error")))
        wrong = wrong.unionByName(step.where("error is not null").select("entry", "error").distinct())
        last = step.where("error is null").groupBy("entry", "path").agg(F.max(F.struct("place", "trail")).alias("m"))
        front = cut(last.select("entry", "path", "m.place", "m.trail"))
        found = found.unionByName(front.select("entry", "path", "place"))
    return found.withColumn("place", F.concat("place", F.array(F.lit(OWN).cast("long")))), wrong.groupBy("entry").agg(F.min("error").alias("error"))


def merged(entries: DataFrame, documents: DataFrame, includes: DataFrame, fields: DataFrame, defaults: DataFrame) -> DataFrame:
    """(entry, error, field, value, path): the fields of each entry, each from the last document in the order of merging that has it, or from
    the defaults (path null); entries in error have one row, with the first error in order, and no fields.

    entries: entry (a path); documents: path; includes: path, ordinal, target; fields: path, field, value (null is not there);
    defaults: field, value.
    """
    found, wrong = visits(entries, documents, includes)
    found = found.join(wrong, "entry", "left_anti")
    given = found.join(fields.where("value is not null"), "path").groupBy("entry", "field").agg(F.max(F.struct("place", "value", "path")).alias("m")).select("entry", "field", "m.value", "m.path")
    whole = entries.join(wrong, "entry", "left_anti").crossJoin(F.broadcast(defaults.select("field", F.col("value").alias("default"))))
    out = given.join(whole, ["entry", "field"], "full").select("entry", F.lit(None).cast("string").alias("error"), "field", F.coalesce("value", "default").alias("value"), "path")
    none = [F.lit(None).cast("string").alias(c) for c in ("field", "value", "path")]
    return out.unionByName(wrong.select("entry", "error", *none))
