"""Rules that single records must keep, by kind of record: name of the rule to a column that is true where it is kept.

Every function takes the record's fields as columns. Rules are meant for `operators.quality.violations`, which makes rows of those
that are broken; a rule whose result is null is broken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(column: Column, *values: str) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


def _none(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNull() for c in columns))


def _unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def review_rules(status: Column, notes: Column | None = None, **details: Column) -> dict[str, Column]:
    """A pending review has no details and no notes, a finished one has all details."""
    finished = _is(status, "reviewed")
    rules = {"pending_without_details": finished | _none(*details.values(), *([] if notes is None else [notes]))}
    return rules | {f"finished_has_{name}": ~finished | c.isNotNull() for name, c in details.items()}


def acceptance_rules(status: Column, decision: Column, hack_status: Column) -> dict[str, Column]:
    """Who accepts an attempt has finished the review of a suspected exploit, if there is one (hack_status not null)."""
    accepted = _is(status, "reviewed") & _is(decision, "accepted")
    return {"accepted_after_hack_review": ~accepted | hack_status.isNull() | _is(hack_status, "reviewed")}


def use_rules(status: Column, decision: Column, usable: Column) -> dict[str, Column]:
    return {"use_needs_acceptance": ~usable | (_is(status, "reviewed") & _is(decision, "accepted"))}


def verdict_rules(status: Column, decision: Column, preferred: Column, left: Column, right: Column, reason: Column, time: Column) -> dict[str, Column]:
    """time: ISO 8601 text, of which the offset must be zero."""
    finished, picks = _is(status, "reviewed"), _is(decision, "preferred")
    return {
        "reason_not_blank": ~finished | F.coalesce(F.trim(reason) != "", F.lit(False)),
        "time_in_utc": ~finished | F.coalesce(time.rlike(r"(Z|[+-]00:00)$"), F.lit(False)),
        "preferred_is_alternative": ~(finished & picks) | F.coalesce((preferred == left) | (preferred == right), F.lit(False)),
        "others_prefer_none": ~finished | picks | preferred.isNull(),
    }


def block_rules(blocks: Column, tests: str) -> dict[str, Column]:
    """blocks: array of (baseline, redundant, n, tool, check); only the tool `tests` has a check, and it always has."""
    every = lambda rule: F.forall(blocks, rule)
    ids = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(b["baseline"]), b["redundant"])))
    return {
        "redundant_not_empty": every(lambda b: F.size(b["redundant"]) > 0),
        "redundant_unique": every(lambda b: _unique(b["redundant"])),
        "baseline_not_redundant": every(lambda b: ~F.array_contains(b["redundant"], b["baseline"])),
        "count_agrees": every(lambda b: b["n"] == F.size(b["redundant"])),
        "check_with_tests_only": every(lambda b: (b["tool"] == tests) == b["check"].isNotNull()),
        "ids_in_one_place": _unique(ids),
    }


def assessment_rules(status: Column, blocks: Column, error: Column) -> dict[str, Column]:
    complete = _is(status, "complete")
    return {"error_if_incomplete": complete == error.isNull(), "no_blocks_if_incomplete": complete | (F.size(blocks) == 0)}


def check_rules(status: Column, finding: Column, evidence: Column, error_class: Column, error_text: Column) -> dict[str, Column]:
    """One check for an exploit. evidence: array of artifact names."""
    detected, failed = _is(status, "detected"), _is(status, "detector_error")
    return {
        "finding_if_detected": detected == finding.isNotNull(),
        "evidence_if_detected": detected == (F.size(evidence) > 0),
        "evidence_unique": _unique(evidence),
        "failed_has_error": ~failed | (error_class.isNotNull() & error_text.isNotNull()),
        "error_only_if_failed": failed | _none(error_class, error_text),
    }


def evaluation_status(results: Column) -> Column:
    """Of an array of (check, status, finding): incomplete if a detector failed."""
    return F.when(F.exists(results, lambda r: _is(r["status"], "detector_error")), "incomplete_evaluation").otherwise("complete")


def overall_finding(results: Column) -> Column:
    """Confirmed before ambiguous before not_detected; null for an incomplete evaluation."""
    found = lambda kind: F.exists(results, lambda r: _is(r["status"], "detected") & _is(r["finding"], kind))
    return F.when(evaluation_status(results) == "complete", F.when(found("confirmed"), "confirmed").when(found("ambiguous"), "ambiguous").otherwise("not_detected"))


def detection_rules(results: Column, evaluation: Column, finding: Column) -> dict[str, Column]:
    return {
        "checks_unique": _unique(F.transform(results, lambda r: r["check"])),
        "evaluation_follows": evaluation.eqNullSafe(evaluation_status(results)),
        "finding_follows": finding.eqNullSafe(overall_finding(results)),
    }


def message_rules(role: Column, name: Column, call: Column) -> dict[str, Column]:
    tool = _is(role, "tool")
    return {"tool_has_name": ~tool | name.isNotNull(), "tool_has_call": ~tool | call.isNotNull(), "call_from_model_or_tool": ~_is(role, "system", "user") | call.isNull()}


def response_rules(reason: Column, prompt: Column, completion: Column, total: Column, error_class: Column, error_text: Column) -> dict[str, Column]:
    """The total is checked where both parts are known."""
    failed = _is(reason, "timeout", "error")
    return {
        "total_is_sum": _none(prompt) | _none(completion) | total.eqNullSafe(prompt + completion),
        "failed_has_error": ~failed | error_class.isNotNull(),
        "error_only_if_failed": failed | _none(error_class, error_text),
    }


def tool_result_rules(status: Column, output: Column, error_class: Column, error_text: Column) -> dict[str, Column]:
    ok = _is(status, "ok")
    return {"output_if_ok": ok == output.isNotNull(), "ok_without_error": ~ok | _none(error_class, error_text), "failed_has_error": ok | error_class.isNotNull()}


def loop_rules(status: Column, n_messages: Column, n_ids: Column, error_class: Column, error_text: Column) -> dict[str, Column]:
    """n_messages and n_ids: messages of the loop and their distinct ids."""
    done = _is(status, "completed")
    return {"message_ids_unique": n_messages == n_ids, "completed_without_error": ~done | _none(error_class, error_text), "stopped_has_error": done | error_class.isNotNull()}


def family_rules(kind: Column, family: Column, fields: dict[str, Column], families: dict[str, str], required: dict[str, list[str]]) -> dict[str, Column]:
    """Kinds of trace events, each with the family of provenance that it must have and the fields that must be there.

    families: kind to family; required: kind to names in `fields`. An unknown kind breaks `kind_known` and no other rule.
    """
    known = _is(kind, *families)
    own = reduce(lambda a, b: a | b, (_is(kind, k) & _is(family, f) for k, f in families.items()))
    names = sorted({n for needed in required.values() for n in needed})
    return {"kind_known": known, "family_of_kind": ~known | own} | {f"has_{n}": ~_is(kind, *(k for k, needed in required.items() if n in needed)) | fields[n].isNotNull() for n in names}


def trajectory_rules(ids: dict[str, Column], statuses: dict[str, Column], patch: Column, agent_artifacts: list[Column], claimed: dict[str, Column], derived: dict[str, Column]) -> dict[str, Column]:
    """Across the sections of an attempt's record.

    ids: task, source_task, policy, policy_record, agent, scorer; statuses: agent, attempt, grade; claimed and derived: the reward
    components that the record holds and those that follow from its statuses, by the same names.
    """
    rules = {
        "one_task": ids["task"].eqNullSafe(ids["source_task"]),
        "one_policy": ids["policy"].eqNullSafe(ids["policy_record"]),
        "agent_status_has_id": statuses["agent"].isNull() | ids["agent"].isNotNull(),
        "scored_has_patch": ~_is(statuses["agent"], "scored") | patch.isNotNull(),
        "agent_artifacts_have_id": ids["agent"].isNotNull() | _none(*agent_artifacts),
        "attempt_status_has_id": statuses["attempt"].isNull() | ids["scorer"].isNotNull(),
        "graded_has_id": _is(statuses["grade"], "cannot_grade") | ids["scorer"].isNotNull(),
    }
    return rules | {f"{name}_follows": claimed[name].eqNullSafe(c) for name, c in derived.items()}


def flake_group_rules(status: Column, reference: Column, drifted: Column, detailed: Column, repeats: Column) -> dict[str, Column]:
    """drifted, detailed: arrays of repeat numbers, those that drifted and those that have details; repeat 0 is what others are held to."""
    return {
        "reference_is_first": reference == 0,
        "details_of_drifted": F.array_sort(F.array_distinct(drifted)).eqNullSafe(F.array_sort(F.array_distinct(detailed))),
        "reference_not_drifted": ~F.array_contains(drifted, reference),
        "stable_without_drift": ~_is(status, "stable") | (F.size(drifted) == 0),
        "drifted_has_repeats": ~_is(status, "drifted") | (F.size(drifted) > 0),
        "repeats_in_range": (reference < repeats) & F.forall(drifted, lambda r: r < repeats),
    }


def flake_status(n_drifted: Column, repeats: Column, non_idempotent: Column, inconclusive: Column) -> Column:
    """Drifted before inconclusive before stable; a single repeat tells nothing."""
    return F.when((n_drifted > 0) | non_idempotent, "drifted").when((repeats < 2) | inconclusive, "inconclusive").otherwise("stable")


def comparison_rules(context: Column, left: Column, right: Column, comparison_id: Column, left_evidence: Column, right_evidence: Column) -> dict[str, Column]:
    """An unlabelled pair of actions: the lesser one is left, the id follows from the content, no evidence stands for both or twice."""
    return {
        "lesser_is_left": left < right,
        "id_follows": comparison_id == F.concat(F.lit("comparison_"), F.md5(F.concat_ws("\x1f", context, left, right))),
        "evidence_apart": ~F.arrays_overlap(left_evidence, right_evidence),
        "evidence_unique": _unique(left_evidence) & _unique(right_evidence),
    }


def policy_run_rules(n_attempts: Column, n_tasks: Column, per_task: Column, n_primary: Column) -> dict[str, Column]:
    """n_primary: attempts with a status in the layer that a policy of this type always has."""
    return {"attempts_cover_tasks": n_attempts == n_tasks * per_task, "primary_layer_complete": n_primary == n_attempts}
