"""Candidates for training: the first reason of each way, and the one review of each run."""

from __future__ import annotations

import pytest

from millrace.operators.candidates import candidate_counts, candidates, one_to_one

RUN = "k int, policy_type string, split string, leaked boolean, failed boolean, detection string, finding string, task_success boolean, agent_id string, status_id string"
REVIEW = "k int, status string, decision string, hack_decision string"


def made(spark, cases):
    """cases: by key (changes of a good run, review)."""
    good = {"policy_type": "model", "split": "train", "leaked": False, "failed": False, "detection": "complete", "finding": "not_detected", "task_success": True, "agent_id": "a", "status_id": "s"}
    runs = spark.createDataFrame([(k, *(good | change).values()) for k, (change, _) in cases.items()], RUN)
    reviews = spark.createDataFrame([(k, *review) for k, (_, review) in cases.items()], REVIEW)
    return candidates(runs, reviews, "k", ["agent_id", "status_id"], "model", ("heldout",))


ACCEPTED = ("reviewed", "accepted", None)


def test_first_reasons(spark):
    cases = {
        1: ({}, ACCEPTED), 2: ({"task_success": False}, ACCEPTED), 3: ({}, ("not_reviewed", None, None)), 4: ({"policy_type": "scripted", "split": "heldout"}, ("reviewed", "rejected", None)), 5: ({"split": "heldout", "leaked": True}, ACCEPTED),
        6: ({"leaked": True, "failed": True}, ACCEPTED), 7: ({"failed": True, "detection": None}, ACCEPTED), 8: ({"detection": None, "agent_id": None}, ACCEPTED), 9: ({"agent_id": None, "status_id": None}, ACCEPTED), 10: ({"finding": "ambiguous"}, ACCEPTED),
        11: ({"finding": "ambiguous"}, ("reviewed", "accepted", "cleared")), 12: ({"finding": "ambiguous"}, ("reviewed", "accepted", "unclear")), 13: ({"finding": "confirmed"}, ACCEPTED), 14: ({"finding": "confirmed"}, ("reviewed", "accepted", "confirmed")), 15: ({}, ("reviewed", "needs_followup", None)), 16: ({}, ("reviewed", "odd", None)),
    }
    rows = made(spark, cases)
    got = {r["k"]: r for r in rows.collect()}
    want = {
        1: (None, "the run succeeded", None), 2: (None, None, None), 3: ("not reviewed", "not reviewed", None), 4: ("rejected in review", "rejected in review", "not from a model"), 5: ("split kept out of training",) * 3, 6: ("leak in what the model saw",) * 3,
        7: ("orchestration failed",) * 3, 8: ("detection not complete",) * 3, 9: ("evidence missing: agent_id, status_id",) * 3, 10: ("ambiguous finding without adjudication",) * 2 + (None,), 11: (None, "the run succeeded", None), 12: ("ambiguous finding not cleared", "the run succeeded", None),
        13: ("confirmed finding", "the run succeeded", None), 14: ("finding confirmed in review", "the run succeeded", None), 15: ("review asks for more", "review asks for more", None), 16: ("not accepted in review", "not accepted in review", None),
    }
    for k, reasons in want.items():
        for path, reason in zip(("positive", "negative", "preference"), reasons, strict=True):
            assert got[k][path] == (reason is None), (k, path)
            assert reason is None or got[k][f"{path}_reason"] == reason, (k, path)
    assert {k for k, r in got.items() if r["analysis_only"]} == {5, 6, 7, 8, 9} and {k for k, r in got.items() if r["closed"]} == {4}
    assert got[9]["missing"] == ["agent_id", "status_id"] and got[1]["missing"] == []
    assert tuple(candidate_counts(rows).first()) == (16, 3, 1, 10, 10, 5, 1)


def test_each_run_has_one_review(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(2, "c"), (1, "d")], "k int, y string")
    assert sorted(map(tuple, one_to_one(left, right, "k").collect())) == [(1, "a", "d"), (2, "b", "c")]
    for more, told in (([(1, "e")], "1: 1 rows on the left, 2 on the right"), ([(3, "e")], "3: 0 rows on the left, 1 on the right"), ([(None, "e")], "null: 0 rows on the left, 1 on the right")):
        with pytest.raises(Exception, match=told):
            one_to_one(left, right.unionByName(spark.createDataFrame(more, right.schema)), "k").collect()
    assert one_to_one(left.limit(0), right.limit(0), "k").collect() == []
