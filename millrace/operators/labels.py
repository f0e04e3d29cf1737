"""Labels of tokens by who wrote their characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_layout(rows: DataFrame, offsets: Column, spans: Column, length: Column) -> DataFrame:
    """rows with what the ownership of their tokens comes to.

    offsets: array of (start, stop) of the tokens, spans: array of (start, stop) that the model owns, in characters of a text of
    `length`. status: `span outside`, `disordered`, `outside` (an empty token or one beyond the text), `crossing` (a token that the
    model owns in part), `gap` (characters in no token), else `labelled`; the first that holds. If labelled: n_owned and n_ignored
    tokens, first_owned (null if none), whether the owned ones are contiguous, and n_targets, the owned ones that are not the first
    token, which nothing predicts.
    """
    def overlap(t: Column, s: Column) -> Column:
        return F.greatest(F.least(t["stop"], s["stop"]) - F.greatest(t["start"], s["start"]), F.lit(0))

    owned = F.transform("__offsets", lambda t: F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + overlap(t, s).cast("long")))
    held = rows.withColumns({"__offsets": offsets, "__spans": spans, "__length": length}).withColumn("__owned", owned)
    size = lambda t: t["stop"] - t["start"]
    status = (
        F.when(F.exists("__spans", lambda s: (s["start"] < 0) | (s["stop"] <= s["start"]) | (s["stop"] > F.col("__length"))), "span outside")
        .when(F.exists(F.transform("__offsets", lambda t, i: (i > 0) & (t["start"] < F.get("__offsets", i - 1)["start"])), lambda x: x), "disordered")
        .when(F.exists("__offsets", lambda t: (t["start"] < 0) | (t["stop"] <= t["start"]) | (t["stop"] > F.col("__length"))), "outside")
        .when(F.exists(F.arrays_zip("__offsets", "__owned"), lambda z: (z["__owned"] > 0) & (z["__owned"] < size(z["__offsets"]))), "crossing")
        .when(F.aggregate("__offsets", F.lit(0), lambda end, t: F.when(t["start"] > end, F.lit(1 << 30)).otherwise(F.greatest(end, t["stop"]))) != F.col("__length"), "gap")
        .otherwise("labelled")
    )
    held = held.withColumn("status", status)
    marks = F.filter(F.transform("__owned", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    held = held.withColumn("__marks", F.when(F.col("status") == "labelled", marks))
    n = F.size("__marks")
    layout = {
        "n_owned": n.cast("long"),
        "n_ignored": (F.size("__offsets") - n).cast("long"),
        "first_owned": F.get("__marks", F.lit(0)).cast("long"),
        "contiguous": (n == 0) | (F.get("__marks", n - 1) - F.get("__marks", F.lit(0)) + 1 == n),
        "n_targets": (n - F.when(F.get("__marks", F.lit(0)) == 0, 1).otherwise(0)).cast("long"),
    }
    labelled = F.col("status") == "labelled"
    return held.withColumns({k: F.when(labelled, v) for k, v in layout.items()}).drop("__offsets", "__spans", "__length", "__owned", "__marks")
