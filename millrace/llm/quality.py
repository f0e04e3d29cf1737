"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated five-word windows. The verdict is a hashed n-gram log-likelihood
ratio: one- and two-word n-grams of all documents are hashed to buckets; two multinomials over the buckets, one of the trusted
documents and one of the whole corpus, give each bucket a log ratio; a document's score is the mean of its n-grams' ratios, and
it is kept if that reaches a fixed threshold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, documents, id_text

#: THRESHOLD lies between the scores of trusted and of low-quality labels at this number; fewer draw all scores towards 0.
BUCKETS = 1 << 16
#: Added to each bucket's count.
SMOOTH = 1.0
THRESHOLD = -0.2
#: Trusted ids up to this many (16 MB) are sent to all tasks; more are joined by shuffle.
SENT_IDS = 1_000_000
WINDOW = 5


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def buckets(held: Column, n: int) -> Column:
    """The buckets of the one- and two-word n-grams."""
    ones = F.transform(held, lambda w: F.pmod(F.xxhash64(w), F.lit(n)))
    twos = F.transform(held, lambda w, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(held, i - 1), w), F.lit(n))))
    return F.concat(ones, F.slice(twos, 2, F.greatest(F.size(held), F.lit(1))))


def repeat_words(held: Column) -> Column:
    """Words inside five-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def inside(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda e, k: (e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"]))
            starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
            return _let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, inside))

    hashes = F.transform(F.sequence(F.lit(0), F.size(held) - WINDOW), lambda i: F.xxhash64(*(F.get(held, i + k) for k in range(WINDOW))))
    return F.when(F.size(held) <= WINDOW, F.lit(0)).otherwise(_let(hashes, covered)).cast("long")


def log_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> list[float]:
    """By bucket, the log of the smoothed frequency in trusted documents (ids in `trusted`) over that in all documents.

    All zeros if nothing is trusted. Only the counts of the n buckets come to the driver.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().withColumn("good", F.lit(1))
    ids = F.broadcast(ids) if trusted.count() <= SENT_IDS else ids
    held = docs.join(ids, "doc_id", "left").select(F.coalesce("good", F.lit(0)).alias("good"), words(F.col("text")).alias("w"))
    grams = held.select("good", F.explode(buckets(F.col("w"), n)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = [0] * n, [0] * n
    for r in counted:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not any(good):
        return [0.0] * n
    all_raw, all_good = sum(raw) + SMOOTH * n, sum(good) + SMOOTH * n
    return [math.log((g + SMOOTH) / all_good) - math.log((r + SMOOTH) / all_raw) for r, g in zip(raw, good, strict=True)]


def quality(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every document.

    Null text counts as empty: no words, base_failed. A document without n-grams scores 0. Repeated rows are judged each, and
    count each in the corpus. Other columns are ignored.
    """
    rows = id_text(docs)
    ratios = F.from_json(F.lit(json.dumps(log_ratios(rows, trusted, n))), "array<double>")
    text, w = F.col("text"), F.col("w")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    held = rows.select("doc_id", "text", words(text).alias("w"), lines.alias("lines"))
    total = _let(ratios, lambda table: F.aggregate(buckets(w, n), F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int"))))
    found = held.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        F.when(F.size(w) == 0, F.lit(0.0)).otherwise(total / (2 * F.size(w) - 1)).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_labels(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality(documents(spark, sf_dir), trusted_labels(labels))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
