"""Marker scans: which texts contain which marker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a marker that are looked up before the texts are compared.
ANCHOR_WORDS = 4
#: Markers up to this many are sent to all tasks, after they were counted; more are joined by shuffle, or are an error if they have
#: too few words to be joined by a hash.
SENT_MARKERS = 100_000


def containing(texts: DataFrame, text_id: str, markers: DataFrame, marker_id: str) -> DataFrame:
    """(text_id, marker_id) where the text contains the marker as a substring; both tables have a column `text`.

    A text that contains a marker has its inner words side by side. So the hash of a marker's second to fifth word is joined
    with the hashes of all four-word runs of the texts, before these are shuffled if the markers are few, and only what agrees is
    compared. Markers of fewer than six words have no such run; they are compared with every text, and more than SENT_MARKERS of
    them are an error. Null and empty markers and null texts match nothing.
    """
    words = lambda c: F.split(c, r"\s+")
    run = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(ANCHOR_WORDS)))
    m = markers.where(F.col("text").isNotNull() & (F.col("text") != "")).select(marker_id, F.col("text").alias("marker"), words("text").alias("w"))
    long = m.where(F.size("w") >= ANCHOR_WORDS + 2).select(marker_id, "marker", run(F.col("w"), F.lit(1)).alias("h"))
    if long.limit(SENT_MARKERS + 1).count() <= SENT_MARKERS:
        long = F.broadcast(long)
    t = texts.select(text_id, "text", words("text").alias("w"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - ANCHOR_WORDS, F.lit(0))), lambda i: run(F.col("w"), i)))
    hits = t.select(text_id, F.explode(runs).alias("h")).join(long, "h").select(text_id, marker_id, "marker").distinct()
    found = hits.join(texts.select(text_id, "text"), text_id).where(F.contains("text", "marker"))
    short = m.where(F.size("w") < ANCHOR_WORDS + 2).select(marker_id, "marker")
    n_short = short.limit(SENT_MARKERS + 1).count()
    if n_short > SENT_MARKERS:
        raise ValueError(f"more than {SENT_MARKERS} markers of a few words")
    if not n_short:
        return found.select(text_id, marker_id)
    named = texts.select(text_id, "text").join(F.broadcast(short), F.contains(F.col("text"), F.col("marker")))
    return found.select(text_id, marker_id).unionByName(named.select(text_id, marker_id))
