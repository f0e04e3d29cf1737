"""Edges of the rules of records, of reports, replays, packs and examples: nulls, empty tables, repeated rows and conflicts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import records
from millrace.functions.hashing import content_digest
from millrace.functions.text import first_difference, percentage, roots_replaced
from millrace.operators import coverage, examples, packs, replays, reports
from millrace.operators.quality import violations


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def broken(df, rules):
    return {tuple(r) for r in violations(df, F.col("id"), **rules).collect()}


def test_content_digests(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "t string").select(content_digest(F.col("t")))
    assert [r[0] for r in df.collect()] == ["xxh64:ef46db3751d8e999", "xxh64:d24ec4f1a98c6e5b", None]


def test_reviews(spark):
    df = spark.createDataFrame([(1, "not_reviewed", None, None), (2, "not_reviewed", "r", None), (3, "reviewed", None, "accepted"), (4, None, None, None), (5, "reviewed", "r", "accepted")], "id int, s string, r string, d string")
    found = broken(df, records.review_rules(F.col("s"), reviewer=F.col("r"), decision=F.col("d")) | records.use_rules(F.col("s"), F.col("d"), F.lit(True)))
    assert found == {("pending_without_details", 2), ("finished_has_reviewer", 3), ("use_needs_acceptance", 1), ("use_needs_acceptance", 2), ("use_needs_acceptance", 4)}


def test_verdict_times(spark):
    df = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "a", " "), (2, "2024-01-01T00:00:00", "c", "x"), (3, None, None, None)], "id int, t string, p string, why string")
    found = broken(df, records.verdict_rules(F.lit("reviewed"), F.lit("preferred"), F.col("p"), F.lit("a"), F.lit("b"), F.col("why"), F.col("t")))
    assert found == {("reason_not_blank", 1), ("time_in_utc", 2), ("preferred_is_alternative", 2), ("reason_not_blank", 3), ("time_in_utc", 3), ("preferred_is_alternative", 3)}


def test_findings(spark):
    kind = "id int, r array<struct<check:string,status:string,finding:string>>"
    df = spark.createDataFrame([(1, []), (2, [("a", "detected", "ambiguous"), ("b", "detected", "confirmed")]), (3, [("a", "detector_error", None), ("b", "detected", "confirmed")])], kind)
    got = rows(df.select("id", records.evaluation_status(F.col("r")), records.overall_finding(F.col("r"))))
    assert got == [(1, "complete", "not_detected"), (2, "complete", "confirmed"), (3, "incomplete_evaluation", None)]


def test_references(spark):
    a = spark.createDataFrame([(1, "x", "h"), (1, "y", None)], "id int, name string, pin string")
    r = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x")], "id int, name string")
    assert rows(coverage.reference_problems(r, a, ["id", "name"], "pin")) == [(1, "y", "not pinned"), (2, "x", "absent"), (None, "x", "absent")]
    assert coverage.reference_problems(r.limit(0), a, ["id", "name"], "pin").count() == 0


def test_report(spark):
    df = spark.createDataFrame([("p", "b", None, None, 4), ("p", "a", 3, "m", 7), ("p", "b", None, "m", None), ("q", None, None, None, None)], "policy string, s string, n int, m string, ms int")
    r = reports.policy_report(df, "policy", {"s": ["b", "a", "c"]}, {"n_b": F.col("s") == "b"}, {"n": F.col("n")}, ["m"], "ms")
    assert rows(r) == [("p", 3, "a=1, b=2", 2, 3, "m", 5), ("q", 1, "", 0, None, "", None)]
    assert rows(reports.named_rates(r, "policy", "n_attempts", all=("n_b", None), none=("n_b", ["z"]))) == [("all", 2, 4), ("none", None, None)]
    assert rows(reports.expectation_met(r, {"p": {"b": F.col("n_b")}, "q": {"n": F.col("n_attempts")}}, "policy", "n_attempts")) == [("p", False), ("q", True)]
    assert r.select(percentage(F.lit(None).cast("long"), F.lit(None).cast("long"))).first()[0] is None


def test_replays(spark):
    s = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", "z"), (2, "a", "x")], "k int, f string, h string")
    r = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "x"), (3, "a", "x")], "k int, f string, h string")
    got = rows(replays.artifact_matches(s, r, "k", "f", "h").select("k", "matches", "n", "n_matched", "matched"))
    assert got == [(1, {"a": True, "b": False, "c": False}, 3, 1, False), (2, {"a": True}, 1, 1, True), (3, {"a": False}, 1, 0, False)]


def test_unlinked(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, "a"), (1, "b", None), (1, "b", None), (1, None, "b"), (2, None, None)], "g int, c string, r string")
    assert rows(replays.unlinked_calls(df, "g", F.col("c"), F.col("r"))) == [(1, 2, 1)]


def test_packs(spark):
    lock = spark.createDataFrame([(1, "dev"), (1, "dev"), (2, "dev"), (3, None), (4, "dev")], "t int, s string")
    own = spark.createDataFrame([(1, "dev"), (2, "test"), (3, None), (5, "dev")], "t int, s string")
    assert rows(packs.split_problems(lock, own, "t", "s")) == [(1, "twice"), (2, "mismatch"), (4, "unknown"), (5, "unlocked")]
    assert rows(packs.owners(lock, "t", "s")) == [(1, 2, None), (2, 1, "dev"), (3, 1, None), (4, 1, "dev")]
    files = spark.createDataFrame([("a/b/c",), ("ab/c",), ("a",), ("x",)], "p string")
    assert rows(packs.uncovered(files, "p", spark.createDataFrame([("a",), ("ab/",)], "root string"), "root")) == [("ab/c",), ("x",)]


def test_examples(spark):
    c = spark.createDataFrame([(1, True, "complete", 1), (2, True, "complete", 0), (3, None, "complete", 0), (4, True, None, 0), (5, True, "complete", 2)], "k int, eligible boolean, status string, n_blocks int")
    repairs = spark.createDataFrame([(1, "r1"), (2, "r2"), (5, "r5")], "k int, repair_id string")
    reviews = spark.createDataFrame([("r1", "accepted"), ("r2", "accepted"), ("r5", "rejected")], "repair_id string, decision string")
    usable = examples.usable_repairs(repairs, reviews, repairs, "k")
    taken = examples.selections(c, usable, "k")
    assert rows(taken.select("k", "fate", "repair_id")) == [(1, "repaired", "r1"), (2, "original", None), (3, "ineligible", None), (4, "incomplete", None), (5, "needs repair", None)]
    m = spark.createDataFrame([(k, i, r, None) for k in (1, 2) for i, r in enumerate(("user", "assistant", "user", "assistant"))], "k int, ordinal int, role string, text string")
    boundaries = spark.createDataFrame([(1, "accepted", 3), (2, "accepted", 2), (5, "accepted", 1)], "k int, decision string, boundary int")
    dropped = spark.createDataFrame([("r1", 1)], "repair_id string, ordinal int")
    assert rows(examples.examples(taken, m, dropped, boundaries, "k").select("k", "fate", "n_messages")) == [(1, "repaired", 3)]
    twice = repairs.unionByName(spark.createDataFrame([(1, "r9")], "k int, repair_id string"))
    accepted = reviews.unionByName(spark.createDataFrame([("r9", "accepted")], "repair_id string, decision string"))
    with pytest.raises(Exception, match="two repairs of candidate 1"):
        examples.usable_repairs(twice, accepted, twice, "k").collect()


def test_differences(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", "abcde"), ("", "x"), ("same", "same"), (None, "x"), ("é" * 3000 + "a", "é" * 3000 + "b")], "a string, b string")
    assert [r[0] for r in df.select(first_difference(F.col("a"), F.col("b"))).collect()] == [2, 3, 0, None, None, 3000]


def test_roots(spark):
    df = spark.createDataFrame([("/a/b/c /a/bc /a.b x/a (/a)",), (None,)], "t string")
    assert [r[0] for r in df.select(roots_replaced(F.col("t"), {"/a": "$A", "/a/b": "B"})).collect()] == ["B/c $A/bc /a.b x/a ($A)", None]
