"""Statuses of graded attempts: what follows from an agent's and a scorer's summary, and the rules that statuses must keep.

An attempt has a scorer summary (attempt_status, public_status, hidden_status) or none, and an agent summary (agent_status,
loop_status) or none; what is absent is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The check statuses (public, hidden) that go with each attempt status; a timeout may have any of three.
CHECKS = {
    "PASS": [("PASS", "PASS")],
    "PATCH_APPLY_ERROR": [("NOT_RUN", "NOT_RUN")],
    "PUBLIC_TEST_FAIL": [("FAIL", "NOT_RUN")],
    "HIDDEN_TEST_FAIL": [("PASS", "FAIL")],
    "INVALID_SHORTCUT": [("NOT_RUN", "NOT_RUN")],
    "HIDDEN_VALIDATOR_ACCESS_ATTEMPT": [("NOT_RUN", "NOT_RUN")],
    "ORCHESTRATOR_ERROR": [("NOT_RUN", "NOT_RUN")],
    "TIMEOUT": [("NOT_RUN", "NOT_RUN"), ("FAIL", "NOT_RUN"), ("PASS", "FAIL")],
}


def _is(column: Column, value: str) -> Column:
    return column.eqNullSafe(F.lit(value))


def task_success(agent: Column, loop: Column, attempt: Column, public: Column, hidden: Column) -> Column:
    """All three scorer statuses pass and the agent, if there was one, was scored after a completed loop."""
    scorer = _is(attempt, "PASS") & _is(public, "PASS") & _is(hidden, "PASS")
    return scorer & (agent.isNull() | (_is(agent, "scored") & _is(loop, "completed")))


def grade_state(success: Column, attempt: Column) -> Column:
    return F.when(success, "scored_pass").when(attempt.isNull(), "cannot_grade").otherwise("scored_fail")


def validator_success(status: Column) -> Column:
    """Null where the validator has no status."""
    return F.when(status.isNotNull(), status == "PASS")


def output_format_valid(agent: Column, loop: Column) -> Column:
    return F.when(agent.isNotNull() & loop.isNotNull(), loop != "invalid_model_output")


def tool_usage_valid(agent: Column, loop: Column) -> Column:
    """Null for loops that ended in another way than those that tell."""
    known = F.when(loop == "terminal_tool_error", False).when(loop.isin("completed", "max_turns_exceeded"), True)
    return F.when(agent.isNotNull(), known)


def orchestration_failure(agent: Column, attempt: Column) -> Column:
    return _is(agent, "orchestrator_error") | _is(attempt, "ORCHESTRATOR_ERROR")


def checks_agree(attempt: Column, public: Column, hidden: Column) -> Column:
    """Whether the check statuses are ones that go with the attempt status; null statuses never do."""
    allowed = [_is(attempt, a) & _is(public, p) & _is(hidden, h) for a, pairs in CHECKS.items() for p, h in pairs]
    out = allowed[0]
    for one in allowed[1:]:
        out = out | one
    return out


def status_rules(agent: Column, loop: Column, attempt: Column, public: Column, hidden: Column, grade: Column, success: Column) -> dict[str, Column]:
    """By name, the rules that the statuses of an attempt must keep; true where kept."""
    absent = attempt.isNull()
    return {
        "loop_needs_agent": agent.isNotNull() | loop.isNull(),
        "scored_completed": ~_is(agent, "scored") | _is(loop, "completed"),
        "failed_loop_has_status": ~_is(agent, "agent_loop_failed") | loop.isNotNull(),
        "failed_loop_not_completed": ~_is(agent, "agent_loop_failed") | ~_is(loop, "completed"),
        "checks_need_attempt": ~absent | (public.isNull() & hidden.isNull()),
        "attempt_needs_checks": absent | (public.isNotNull() & hidden.isNotNull()),
        "checks_agree": absent | public.isNull() | hidden.isNull() | checks_agree(attempt, public, hidden),
        "cannot_grade_no_success": ~_is(grade, "cannot_grade") | ~success,
        "success_is_scored_pass": ~success | _is(grade, "scored_pass"),
        "scored_pass_is_success": ~_is(grade, "scored_pass") | success,
        "scored_pass_all_pass": ~_is(grade, "scored_pass") | (_is(attempt, "PASS") & _is(public, "PASS") & _is(hidden, "PASS")),
        "scored_fail_no_success": ~_is(grade, "scored_fail") | ~success,
        "scored_fail_has_attempt": ~_is(grade, "scored_fail") | ~absent,
    }


def training_block(policy_type: Column, split: Column, leaked: Column, failed: Column, detection: Column, evidence: dict[str, Column], model_type: str, barred_splits: tuple[str, ...]) -> Column:
    """Why an attempt is no training data, the first reason in a fixed order; null if it is. evidence: by name, what must be there."""
    missing = F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in evidence.items())), lambda x: x.isNotNull())
    return (
        F.when(~policy_type.eqNullSafe(F.lit(model_type)), "not from a model")
        .when(split.isin(*barred_splits), "split kept out of training")
        .when(leaked, "leak in what the model saw")
        .when(failed, "orchestration failed")
        .when(~detection.eqNullSafe(F.lit("complete")), "detection not complete")
        .when(F.size(missing) > 0, F.concat(F.lit("evidence missing: "), F.array_join(missing, ", ")))
    )
