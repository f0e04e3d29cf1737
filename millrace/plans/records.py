"""Queries for the rules of single records and the report over policies; records are made from events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records, statuses
from ..functions.text import percentage
from ..operators.coverage import reference_problems
from ..operators.quality import violations
from ..operators.reports import expectation_met, named_rates, policy_report
from .attempts import _A, AGENT, ATTEMPT, CHECK, LOOP, attempts
from .preferences import _P, _pairs, _user
from .reviews import read
from .transforms import chosen

C = F.col
MODEL_POLICIES = ("1-URGENT", "2-HIGH")
FAMILIES = {"click": "attempt", "view": "attempt", "purchase": "eval", "signup": "replay"}
REQUIRED = {"click": ["task"], "purchase": ["task", "policy"], "signup": ["source"]}


def _k():
    return F.col("event_id")


def _tally(rows, rules):
    """How many records break each rule, and the least and the greatest of their ids."""
    return violations(rows, C("id"), **rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_id"), F.max("key").alias("last_id"))


def _events(spark, d, **columns):
    return read(spark, d, "events").select(_k().alias("id"), *(c.alias(name) for name, c in columns.items()))


def _by(n):
    return F.floor(_k() / n)


def _every(n, value):
    """The value for every n-th event, else null."""
    return F.when(_k() % n == 0, value)


def _but(n, value):
    return F.when(_k() % n != 0, value)


def review_violations(spark, d):
    r = _events(spark, d, status=chosen(_k(), "reviewed", "not_reviewed", "reviewed"), review=_but(5, _k()), reviewer=_but(7, "r"), decision=chosen(_by(2), "accepted", "rejected", None), notes=_every(11, "n"), hack=chosen(_by(6), "reviewed", "not_reviewed", None), usable=_k() % 4 == 0)
    rules = records.review_rules(C("status"), C("notes"), review=C("review"), reviewer=C("reviewer"), decision=C("decision"))
    return _tally(r, rules | records.acceptance_rules(C("status"), C("decision"), C("hack")) | records.use_rules(C("status"), C("decision"), C("usable")))


def verdict_violations(spark, d):
    r = _events(
        spark, d, status=chosen(_k(), "reviewed", "not_reviewed", "reviewed"), decision=chosen(_by(2), "preferred", "tie"), preferred=chosen(_by(4), "a", "c", None), reason=chosen(_by(3), "because", " ", None),
        time=chosen(_by(5), "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00+00:00", None),
    )
    return _tally(r, records.verdict_rules(C("status"), C("decision"), C("preferred"), F.lit("a"), F.lit("b"), C("reason"), C("time")))


def _lists(number, *lists):
    return F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists)), (F.pmod(number, F.lit(len(lists))) + 1).cast("int"))


def block_violations(spark, d):
    block = lambda baseline, redundant, n, tool, check: F.struct(F.lit(baseline).alias("baseline"), redundant.alias("redundant"), n.alias("n"), tool.alias("tool"), check.alias("check"))
    first = block("a", _lists(_k(), ["b"], ["b", "b"], ["a", "b"], []), F.when(_k() % 5 == 0, 2).otherwise(1), chosen(_by(4), "run_tests", "read_file"), F.when(_by(8) % 2 == 0, 0))
    second = block("d", _lists(_k(), ["b"], ["e"], ["e"], ["e"], ["e"], ["e"]), F.lit(1), F.lit("read_file"), F.lit(None).cast("int"))
    both = F.array(first, second)
    r = _events(spark, d, blocks=F.when(_k() % 9 == 0, F.slice(both, 1, 0)).otherwise(both), status=chosen(_by(3), "complete", "incomplete"), error=_every(7, "E"))
    return _tally(r, records.block_rules(C("blocks"), "run_tests") | records.assessment_rules(C("status"), C("blocks"), C("error")))


def check_violations(spark, d):
    r = _events(spark, d, status=chosen(_k(), "detected", "not_detected", "detector_error"), finding=chosen(_by(3), "confirmed", "ambiguous", None), evidence=_lists(_by(9), [], ["p"], ["p", "p"]), error=_every(2, "E"), text=_but(5, "t"))
    return _tally(r, records.check_rules(C("status"), C("finding"), C("evidence"), C("error"), C("text")))


def detection_violations(spark, d):
    result = lambda check, status, finding: F.struct(check.alias("check"), status.alias("status"), finding.alias("finding"))
    first = result(F.lit("c1"), chosen(_k(), "detected", "not_detected", "detector_error"), chosen(_by(3), "confirmed", "ambiguous", None))
    second = result(F.when(_k() % 8 == 0, "c1").otherwise("c2"), chosen(_by(2), "not_detected", "detected"), F.lit("ambiguous"))
    r = _events(spark, d, results=F.array(first, second), evaluation=chosen(_by(4), "complete", "incomplete_evaluation"), finding=chosen(_by(8), "confirmed", "ambiguous", "not_detected", None))
    return _tally(r, records.detection_rules(C("results"), C("evaluation"), C("finding")))


def message_violations(spark, d):
    v = C("conv_id")
    r = read(spark, d, "conversations").select(v.alias("id"), F.when(C("turn") % 3 == 2, "tool").otherwise(C("role")).alias("role"), F.when((v + C("turn")) % 2 == 0, "n").alias("name"), F.when(v % 3 != 0, "c").alias("call"))
    return _tally(r, records.message_rules(C("role"), C("name"), C("call")))


def response_violations(spark, d):
    r = _events(spark, d, reason=chosen(_k(), "stop", "length", "timeout", "error"), prompt=_but(3, _k()), completion=_but(5, 10), total=_but(11, F.when(_k() % 7 == 0, _k()).otherwise(_k() + 10)), error=_every(2, "E"), text=_every(13, "t"))
    return _tally(r, records.response_rules(C("reason"), C("prompt"), C("completion"), C("total"), C("error"), C("text")))


def tool_result_violations(spark, d):
    r = _events(spark, d, status=F.when(C("event_type") == "error", "error").otherwise("ok"), output=_but(3, "o"), error=_every(2, "E"), text=_every(5, "t"))
    return _tally(r, records.tool_result_rules(C("status"), C("output"), C("error"), C("text")))


def loop_violations(spark, d):
    """Conversations as loops; in some the second message has the id of the first."""
    v = C("conv_id")
    number = C("turn") - F.when((v % 4 == 0) & (C("turn") == 1), 1).otherwise(0)
    loops = read(spark, d, "conversations").groupBy(v.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("n_ids"))
    i = C("id")
    return _tally(loops, records.loop_rules(chosen(i, "completed", "max_turns"), C("n"), C("n_ids"), F.when(i % 3 == 0, "E"), F.lit(None)))


def trace_violations(spark, d):
    r = _events(spark, d, kind=C("event_type"), family=chosen(_k(), "attempt", "eval", "replay"), task=_but(5, "t"), policy=_but(4, "p"), source=_but(3, "s"))
    return _tally(r, records.family_rules(C("kind"), C("family"), {n: C(n) for n in ("task", "policy", "source")}, FAMILIES, REQUIRED))


def trajectory_violations(spark, d):
    """Attempts against ids, artifacts and reward components that are claimed for them."""
    k = C("id")
    a = attempts(spark, d).withColumn("grade", statuses.grade_state(C("success"), C("attempt")))
    ids = {"task": k % 100, "source_task": F.when(k % 17 == 0, -1).otherwise(k % 100), "policy": F.lit("p"), "policy_record": F.when(k % 19 != 0, "p"), "agent": F.when(k % 3 != 0, k), "scorer": F.when(k % 4 != 0, k)}
    derived = {"public_ok": statuses.validator_success(C("public")), "tools_ok": statuses.tool_usage_valid(C("agent"), C("loop")), "failed": statuses.orchestration_failure(C("agent"), C("attempt"))}
    claimed = {"public_ok": k % 2 == 0, "tools_ok": F.when(k % 5 != 0, k % 5 < 3), "failed": k % 3 == 0}
    return _tally(a, records.trajectory_rules(ids, {"agent": C("agent"), "attempt": C("attempt"), "grade": C("grade")}, F.when(k % 2 == 0, k), [F.when(k % 5 == 0, k), F.when(k % 7 == 0, k)], claimed, derived))


def evidence_problems(spark, d):
    """Labels refer to three artifacts of their document; some are not there and some have no hash."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    held = F.array(*(F.struct(F.lit(n).alias("name"), c.alias("pin")) for n, c in (("text", F.md5("text")), ("source", F.when(C("lang") == "en", F.md5("source"))), ("trace", F.md5("lang")))))
    artifacts = docs.select("doc_id", "n_chars", F.inline(held)).where("name <> 'trace' or n_chars > 1000")
    refs = read(spark, d, "labels").select("doc_id", F.explode(F.array(*map(F.lit, ("text", "source", "trace")))).alias("name"))
    return reference_problems(refs, artifacts, ["doc_id", "name"], "pin").groupBy("name", "problem").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def comparison_violations(spark, d):
    """Comparisons of which some are turned, some have another id, and some share their evidence."""
    u = _user()
    turned, twice = u % 3 == 0, C("id") % 7 == 0
    p = _pairs(spark, d).select(u.alias("id"), "context", F.when(turned, C("right")).otherwise(C("left")).alias("l"), F.when(turned, C("left")).otherwise(C("right")).alias("r"), F.when(u % 5 == 0, "comparison_x").otherwise(C("comparison_id")).alias("comparison_id"))
    left = F.when(twice, F.array(F.lit("e1"), F.lit("e1"))).otherwise(F.array(F.lit("e1"), F.lit("e2")))
    right = F.when(~twice & (C("id") % 4 == 0), F.array(F.lit("e2"))).otherwise(F.array(F.lit("e3")))
    return _tally(p, records.comparison_rules(C("context"), C("l"), C("r"), C("comparison_id"), left, right))


def policy_run_violations(spark, d):
    """Priorities as policies, order statuses as their tasks; every policy's primary layer is its scorer's or its agent's."""
    a = attempts(spark, d, C("o_orderpriority"), C("o_orderstatus"))
    primary = F.when(C("o_orderpriority").isin(*MODEL_POLICIES), C("agent")).otherwise(C("attempt"))
    p = a.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderstatus").alias("n_tasks"), F.count(primary).alias("n_primary"))
    rules = records.policy_run_rules(C("n"), C("n_tasks"), F.floor(C("n") / C("n_tasks")), C("n_primary"))
    return violations(p, C("o_orderpriority"), **rules).select("rule", C("key").alias("policy"))


def flake_violations(spark, d):
    r = _events(spark, d, status=chosen(_k(), "stable", "drifted"), reference=F.when(_k() % 13 == 0, 1).otherwise(0), drifted=_lists(_by(2), [], ["1"], ["0"], ["1", "5"]).cast("array<int>"), detailed=_lists(_by(3), [], ["1"], ["5", "1"]).cast("array<int>"))
    return _tally(r, records.flake_group_rules(C("status"), C("reference"), C("drifted"), C("detailed"), F.lit(3)))


def flake_totals(spark, d):
    """The day of a user as a task: an error is a drift, a sign-up not idempotent, a view inconclusive."""
    kind = C("event_type")
    g = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("repeats"), F.count_if(kind == "error").alias("n_drifted"), F.bool_or(kind == "signup").alias("changing"), F.bool_or(kind == "view").alias("unsure"))
    status = records.flake_status(C("n_drifted"), C("repeats"), C("changing"), C("unsure"))
    return g.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_drifted").alias("n_drifted"))


def _report(spark, d):
    k = C("o_orderkey")
    a = attempts(spark, d, C("o_orderpriority").alias("policy"), F.when(k % 6 != 0, k % 500).alias("prompt"), F.when(k % 9 != 0, k % 70).alias("completion"), (k % 4).alias("patch_bytes"), chosen(F.floor(k / 2), "m1", "m2", None).alias("model"), (F.floor(k / 3) % 3).alias("max_turns"), F.when(k % 8 != 0, k % 997).alias("duration"))
    counts = {
        "n_pass": C("attempt") == "PASS",
        "n_public_only": (C("public") == "PASS") & (C("hidden") == "FAIL"),
        "n_env_failed": C("attempt").isin("PATCH_APPLY_ERROR", "TIMEOUT", "ORCHESTRATOR_ERROR"),
        "n_orchestrator_failed": C("attempt") == "ORCHESTRATOR_ERROR",
        "n_scored": C("agent") == "scored",
        "n_loop_failed": C("agent") == "agent_loop_failed",
        "n_completed": C("loop") == "completed",
        "n_agent_pass": C("agent").isNotNull() & (C("attempt") == "PASS"),
        "n_not_run": C("attempt").isNull(),
        "n_empty_patch": C("patch_bytes") == 0,
        "n_success": C("success"),
    }
    sums = {"prompt_tokens": C("prompt"), "completion_tokens": C("completion"), "total_tokens": C("prompt") + C("completion")}
    return policy_report(a, "policy", {"agent": list(AGENT), "loop": list(LOOP), "attempt": list(ATTEMPT), "public": list(CHECK), "hidden": list(CHECK)}, counts, sums, ["model", "max_turns"], "duration")


def policy_reports(spark, d):
    return _report(spark, d)


def policy_rates(spark, d):
    """Rates over all policies, over some, and over one that is not there."""
    rates = named_rates(_report(spark, d), "policy", "n_attempts", oracle=("n_pass", ["1-URGENT"]), known_bad=("n_pass", ["4-NOT SPECIFIED", "5-LOW"]), known_bad_public=("n_public_only", ["4-NOT SPECIFIED", "5-LOW"]), environment=("n_env_failed", None), orchestrator=("n_orchestrator_failed", None), absent=("n_pass", ["6-NONE"]))
    return rates.select("name", "n", "total", percentage(C("n"), C("total")).alias("rate"))


def policy_expectations(spark, d):
    expected = {"1-URGENT": {"agent": C("n_scored"), "loop": C("n_completed"), "scorer": C("n_agent_pass")}, "5-LOW": {"attempts": C("n_attempts")}}
    return expectation_met(_report(spark, d), expected, "policy", "n_attempts")


QUERIES = {
    f.__name__: f
    for f in (review_violations, verdict_violations, block_violations, check_violations, detection_violations, message_violations, response_violations, tool_result_violations, loop_violations, trace_violations, trajectory_violations, evidence_problems, comparison_violations, policy_run_violations, flake_violations, flake_totals, policy_reports, policy_rates, policy_expectations)
}


def _of(number, *texts):
    """SQL: one of the texts, by a number modulo how many there are."""
    return f"[{', '.join('NULL' if t is None else repr(t) for t in texts)}][(({number}) % {len(texts)})::INT + 1]"


def _counted(rows, broken):
    """SQL: the tally of rows r, by rule the condition under which it is broken."""
    found = " UNION ALL ".join(f"SELECT '{rule}' AS rule, id FROM r WHERE {condition}" for rule, condition in broken.items())
    return f"WITH {rows}, tally AS ({found}) SELECT rule, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM tally GROUP BY rule"


def _r(columns):
    return f"r AS (SELECT event_id AS id, {columns} FROM events)"


_REPORT = f"""{_A}, q AS (SELECT b.*, o_orderpriority AS policy, CASE WHEN id % 6 <> 0 THEN id % 500 END AS p, CASE WHEN id % 9 <> 0 THEN id % 70 END AS c FROM b JOIN orders ON o_orderkey = id),
  s AS (SELECT policy, count(*) AS n_attempts, count_if(attempt = 'PASS')::BIGINT AS n_pass, count_if(public = 'PASS' AND hidden = 'FAIL')::BIGINT AS n_public_only, count_if(attempt IN ('PATCH_APPLY_ERROR', 'TIMEOUT', 'ORCHESTRATOR_ERROR'))::BIGINT AS n_env_failed,
    count_if(attempt = 'ORCHESTRATOR_ERROR')::BIGINT AS n_orchestrator_failed, count_if(agent = 'scored')::BIGINT AS n_scored, count_if(agent = 'agent_loop_failed')::BIGINT AS n_loop_failed, count_if(loop = 'completed')::BIGINT AS n_completed, count_if(agent IS NOT NULL AND attempt = 'PASS')::BIGINT AS n_agent_pass,
    count_if(attempt IS NULL)::BIGINT AS n_not_run, count_if(id % 4 = 0)::BIGINT AS n_empty_patch, count_if(success)::BIGINT AS n_success, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens,
    string_agg(DISTINCT CASE id // 2 % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END, ', ' ORDER BY CASE id // 2 % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END) AS model_values, string_agg(DISTINCT (id // 3 % 3)::VARCHAR, ', ' ORDER BY (id // 3 % 3)::VARCHAR) AS max_turns_values,
    floor(median(CASE WHEN id % 8 <> 0 THEN id % 997 END))::BIGINT AS median_duration FROM q GROUP BY policy)"""
_LAYERS = ("agent", "loop", "attempt", "public", "hidden")
_COUNTS = ", ".join(f"{x}_t AS (SELECT policy, string_agg(v || '=' || n, ', ' ORDER BY v) AS {x}_counts FROM (SELECT policy, {x} AS v, count(*) AS n FROM q WHERE {x} IS NOT NULL GROUP BY ALL) GROUP BY policy)" for x in _LAYERS)
_STATUS = _of("event_id", "reviewed", "not_reviewed", "reviewed")
SQL = {
    "review_violations": _counted(
        _r(f"{_STATUS} = 'reviewed' AS done, event_id % 5 <> 0 AS review, event_id % 7 <> 0 AS reviewer, {_of('event_id // 2', 'accepted', 'rejected', None)} AS decision, event_id % 11 = 0 AS notes, {_of('event_id // 6', 'reviewed', 'not_reviewed', None)} AS hack"),
        {
            "pending_without_details": "NOT done AND (review OR reviewer OR decision IS NOT NULL OR notes)", "finished_has_review": "done AND NOT review", "finished_has_reviewer": "done AND NOT reviewer", "finished_has_decision": "done AND decision IS NULL",
            "accepted_after_hack_review": "done AND decision = 'accepted' AND hack = 'not_reviewed'", "use_needs_acceptance": "id % 4 = 0 AND NOT (done AND coalesce(decision = 'accepted', false))",
        },
    ),
    "verdict_violations": _counted(
        _r(f"{_STATUS} = 'reviewed' AS done, event_id // 2 % 2 = 0 AS picks, event_id // 4 % 3 AS choice, event_id // 3 % 3 AS reason, event_id // 5 % 4 AS time"),
        {"reason_not_blank": "done AND reason > 0", "time_in_utc": "done AND time IN (1, 3)", "preferred_is_alternative": "done AND picks AND choice > 0", "others_prefer_none": "done AND NOT picks AND choice < 2"},
    ),
    "block_violations": _counted(
        _r("event_id % 9 = 0 AS none, [['b'], ['b', 'b'], ['a', 'b'], []][(event_id % 4)::INT + 1] AS again, CASE WHEN event_id % 6 = 0 THEN 'b' ELSE 'e' END AS other, event_id // 3 % 2 = 0 AS complete, event_id % 7 <> 0 AS clean"),
        {
            "redundant_not_empty": "NOT none AND len(again) = 0", "redundant_unique": "NOT none AND id % 4 = 1", "baseline_not_redundant": "NOT none AND list_contains(again, 'a')", "count_agrees": "NOT none AND len(again) <> CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END",
            "check_with_tests_only": "NOT none AND (id // 4 % 2 = 0) <> (id // 8 % 2 = 0)", "ids_in_one_place": "NOT none AND (id % 4 IN (1, 2) OR list_contains(again, other))", "error_if_incomplete": "complete <> clean", "no_blocks_if_incomplete": "NOT complete AND NOT none",
        },
    ),
    "check_violations": _counted(
        _r("event_id % 3 = 0 AS hit, event_id % 3 = 2 AS failed, event_id // 3 % 3 < 2 AS finding, event_id // 9 % 3 AS evidence, event_id % 2 = 0 AS error, event_id % 5 <> 0 AS txt"),
        {"finding_if_detected": "hit <> finding", "evidence_if_detected": "hit <> (evidence > 0)", "evidence_unique": "evidence = 2", "failed_has_error": "failed AND NOT (error AND txt)", "error_only_if_failed": "NOT failed AND (error OR txt)"},
    ),
    "detection_violations": _counted(
        _r("event_id % 3 AS s, event_id // 3 % 3 AS f, event_id // 2 % 2 = 1 AS other, event_id // 4 % 2 AS evaluation, event_id // 8 % 4 AS finding"),
        {"checks_unique": "id % 8 = 0", "evaluation_follows": "evaluation <> CASE s WHEN 2 THEN 1 ELSE 0 END", "finding_follows": "finding <> CASE WHEN s = 2 THEN 3 WHEN s = 0 AND f = 0 THEN 0 WHEN (s = 0 AND f = 1) OR other THEN 1 ELSE 2 END"},
    ),
    "message_violations": _counted(
        "r AS (SELECT conv_id AS id, turn, turn % 3 = 2 AS tool, role FROM conversations)",
        {"tool_has_name": "tool AND (id + turn) % 2 = 1", "tool_has_call": "tool AND id % 3 = 0", "call_from_model_or_tool": "NOT tool AND role IN ('system', 'user') AND id % 3 <> 0"},
    ),
    "response_violations": _counted(
        _r("event_id % 4 >= 2 AS failed, event_id % 2 = 0 AS error, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN event_id ELSE event_id + 10 END END AS total"),
        {"total_is_sum": "id % 3 <> 0 AND id % 5 <> 0 AND total IS DISTINCT FROM id + 10", "failed_has_error": "failed AND NOT error", "error_only_if_failed": "NOT failed AND (error OR id % 13 = 0)"},
    ),
    "tool_result_violations": _counted(
        _r("event_type IS DISTINCT FROM 'error' AS ok, event_id % 3 <> 0 AS output, event_id % 2 = 0 AS error"), {"output_if_ok": "ok <> output", "ok_without_error": "ok AND (error OR id % 5 = 0)", "failed_has_error": "NOT ok AND NOT error"}
    ),
    "loop_violations": _counted(
        "r AS (SELECT conv_id AS id, count(*) AS n, count(DISTINCT CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 0 ELSE turn END) AS ids FROM conversations GROUP BY conv_id)",
        {"message_ids_unique": "n <> ids", "completed_without_error": "id % 2 = 0 AND id % 3 = 0", "stopped_has_error": "id % 2 = 1 AND id % 3 <> 0"},
    ),
    "trace_violations": _counted(
        _r(f"event_type AS kind, {_of('event_id', 'attempt', 'eval', 'replay')} AS family"),
        {
            "kind_known": "kind = 'error' OR kind IS NULL", "family_of_kind": "family <> CASE kind WHEN 'click' THEN 'attempt' WHEN 'view' THEN 'attempt' WHEN 'purchase' THEN 'eval' WHEN 'signup' THEN 'replay' END",
            "has_task": "kind IN ('click', 'purchase') AND id % 5 = 0", "has_policy": "kind = 'purchase' AND id % 4 = 0", "has_source": "kind = 'signup' AND id % 3 = 0",
        },
    ),
    "trajectory_violations": _counted(
        f"""{_A}, r AS (SELECT *, CASE WHEN agent IS NOT NULL THEN CASE loop WHEN 'terminal_tool_error' THEN false WHEN 'completed' THEN true WHEN 'max_turns_exceeded' THEN true END END AS tools FROM b)""",
        {
            "one_task": "id % 17 = 0", "one_policy": "id % 19 = 0", "agent_status_has_id": "agent IS NOT NULL AND id % 3 = 0", "scored_has_patch": "agent = 'scored' AND id % 2 = 1", "agent_artifacts_have_id": "id % 3 = 0 AND (id % 5 = 0 OR id % 7 = 0)",
            "attempt_status_has_id": "attempt IS NOT NULL AND id % 4 = 0", "graded_has_id": "(success OR attempt IS NOT NULL) AND id % 4 = 0", "public_ok_follows": "(public = 'PASS') IS DISTINCT FROM (id % 2 = 0)",
            "tools_ok_follows": "tools IS DISTINCT FROM CASE WHEN id % 5 <> 0 THEN id % 5 < 3 END", "failed_follows": "(coalesce(agent = 'orchestrator_error', false) OR coalesce(attempt = 'ORCHESTRATOR_ERROR', false)) <> (id % 3 = 0)",
        },
    ),
    "evidence_problems": """WITH f AS (SELECT l.doc_id, unnest(['text', 'source', 'trace']) AS name, d.text, d.lang, d.source, d.n_chars, d.doc_id IS NOT NULL AS there FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id),
        p AS (SELECT name, doc_id, CASE WHEN NOT there OR (name = 'trace' AND NOT coalesce(n_chars > 1000, false)) THEN 'absent' WHEN (name = 'text' AND text IS NULL) OR (name = 'trace' AND lang IS NULL) OR (name = 'source' AND (lang IS DISTINCT FROM 'en' OR source IS NULL)) THEN 'not pinned' END AS problem FROM f)
        SELECT name, problem, count(*) AS n, min(doc_id) AS first_id FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
    "comparison_violations": _counted(f"{_P}, r AS (SELECT u AS id FROM p)", {"lesser_is_left": "id % 3 = 0", "id_follows": "id % 3 = 0 OR id % 5 = 0", "evidence_apart": "id % 7 <> 0 AND id % 4 = 0", "evidence_unique": "id % 7 = 0"}),
    "policy_run_violations": f"""WITH {_A}, g AS (SELECT o_orderpriority AS policy, count(*) AS n, count(DISTINCT o_orderstatus) AS t, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN agent ELSE attempt END) AS m FROM b JOIN orders ON o_orderkey = id GROUP BY 1)
        SELECT 'attempts_cover_tasks' AS rule, policy FROM g WHERE n % t <> 0 UNION ALL SELECT 'primary_layer_complete', policy FROM g WHERE m <> n""",
    "flake_violations": _counted(
        _r("event_id % 2 = 0 AS stable, [[], [1], [0], [1, 5]][(event_id // 2 % 4)::INT + 1]::INT[] AS drifted, [[], [1], [1, 5]][(event_id // 3 % 3)::INT + 1]::INT[] AS detailed, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS ref"),
        {"reference_is_first": "ref = 1", "details_of_drifted": "drifted <> detailed", "reference_not_drifted": "list_contains(drifted, ref)", "stable_without_drift": "stable AND len(drifted) > 0", "drifted_has_repeats": "NOT stable AND len(drifted) = 0", "repeats_in_range": "list_contains(drifted, 5)"},
    ),
    "flake_totals": """WITH g AS (SELECT user_id, ts::DATE AS day, count(*) AS n, count_if(event_type = 'error')::BIGINT AS x, coalesce(bool_or(event_type = 'signup'), false) AS c, coalesce(bool_or(event_type = 'view'), false) AS u FROM events GROUP BY 1, 2)
        SELECT CASE WHEN x > 0 OR c THEN 'drifted' WHEN n < 2 OR u THEN 'inconclusive' ELSE 'stable' END AS status, count(*) AS n_groups, sum(x)::BIGINT AS n_drifted FROM g GROUP BY 1""",
    "policy_reports": f"WITH {_REPORT}, {_COUNTS} SELECT s.*, {', '.join(f'{x}_counts' for x in _LAYERS)} FROM s {' '.join(f'LEFT JOIN {x}_t USING (policy)' for x in _LAYERS)}",
    "policy_rates": f"""WITH {_REPORT}, t AS (SELECT 'oracle' AS name, sum(n_pass)::BIGINT AS n, sum(n_attempts)::BIGINT AS total FROM s WHERE policy = '1-URGENT' UNION ALL SELECT 'known_bad', sum(n_pass)::BIGINT, sum(n_attempts)::BIGINT FROM s WHERE policy IN ('4-NOT SPECIFIED', '5-LOW')
          UNION ALL SELECT 'known_bad_public', sum(n_public_only)::BIGINT, sum(n_attempts)::BIGINT FROM s WHERE policy IN ('4-NOT SPECIFIED', '5-LOW') UNION ALL SELECT 'environment', sum(n_env_failed)::BIGINT, sum(n_attempts)::BIGINT FROM s
          UNION ALL SELECT 'orchestrator', sum(n_orchestrator_failed)::BIGINT, sum(n_attempts)::BIGINT FROM s UNION ALL SELECT 'absent', NULL, NULL)
        SELECT name, n, total, CASE WHEN n IS NOT NULL THEN n || '/' || total || ' (' || round(100 * n::DECIMAL(18,0) / total, 1)::DECIMAL(10,1) || '%)' END AS rate FROM t""",
    "policy_expectations": f"WITH {_REPORT} SELECT policy, CASE WHEN policy = '5-LOW' THEN true ELSE n_scored = n_attempts AND n_completed = n_attempts AND n_agent_pass = n_attempts END AS met FROM s WHERE policy IN ('1-URGENT', '5-LOW')",
}
