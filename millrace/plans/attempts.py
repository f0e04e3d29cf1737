"""Queries over graded attempts, tool calls and token labels, made from orders, events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import statuses
from ..functions.markers import canary_hash, field_markers, path_markers, redacted_ref, touched
from ..operators.labels import label_layout
from ..operators.quality import violations
from ..operators.runs import repeated_calls, without
from .reviews import read
from .transforms import chosen

ATTEMPT = ("PASS", "PATCH_APPLY_ERROR", "PUBLIC_TEST_FAIL", "HIDDEN_TEST_FAIL", "INVALID_SHORTCUT", "HIDDEN_VALIDATOR_ACCESS_ATTEMPT", "ORCHESTRATOR_ERROR", "TIMEOUT")
CHECK = ("PASS", "FAIL", "NOT_RUN")
AGENT = ("scored", "agent_loop_failed", "orchestrator_error")
LOOP = ("completed", "max_turns_exceeded", "invalid_model_output", "terminal_tool_error")


def attempts(spark, d, *more):
    """An attempt per order, with and without agent and scorer, in all mixtures of statuses; more: columns of orders."""
    k = F.col("o_orderkey")
    scorer, agent = k % 11 != 0, k % 7 != 0
    rows = read(spark, d, "orders").select(
        k.alias("id"),
        F.when(agent, chosen(F.floor(k / 5), *AGENT)).alias("agent"),
        F.when(agent & (F.floor(k / 3) % 5 < 4), chosen(F.floor(k / 3) % 5, *LOOP)).alias("loop"),
        F.when(scorer, chosen(k, *ATTEMPT)).alias("attempt"),
        F.when(scorer | (k % 22 == 0), chosen(F.floor(k / 8), *CHECK)).alias("public"),
        F.when(scorer & (k % 13 != 0), chosen(F.floor(k / 24), *CHECK)).alias("hidden"),
        *more,
    )
    names = [F.col(c) for c in ("agent", "loop", "attempt", "public", "hidden")]
    return rows.withColumn("success", statuses.task_success(*names))


def attempt_grades(spark, d):
    a = attempts(spark, d).withColumn("grade", statuses.grade_state(F.col("success"), F.col("attempt")))
    return a.groupBy("agent", "loop", "grade").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"))


def attempt_components(spark, d):
    """The tri-state components of an attempt, and how often each combination is there."""
    agent, loop, attempt = F.col("agent"), F.col("loop"), F.col("attempt")
    a = attempts(spark, d).select(
        statuses.validator_success(F.col("public")).alias("public_ok"),
        statuses.validator_success(F.col("hidden")).alias("hidden_ok"),
        statuses.output_format_valid(agent, loop).alias("format_ok"),
        statuses.tool_usage_valid(agent, loop).alias("tools_ok"),
        statuses.orchestration_failure(agent, attempt).alias("failed"),
    )
    return a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("n"))


def attempt_violations(spark, d):
    """Rules of statuses that attempts break, against a grade and a success that are claimed for them."""
    k = F.col("id")
    a = attempts(spark, d).withColumns({"claimed": chosen(k, "scored_pass", "scored_fail", "cannot_grade"), "claimed_success": F.floor(k / 3) % 2 == 0})
    rules = statuses.status_rules(*(F.col(c) for c in ("agent", "loop", "attempt", "public", "hidden", "claimed", "claimed_success")))
    return violations(a, k, **rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_id"), F.max("key").alias("last_id"))


def training_blocks(spark, d):
    """Why attempts are no training data, by the first reason in order; competing reasons are there."""
    k = F.col("id")
    a = attempts(spark, d).withColumn("failed", statuses.orchestration_failure(F.col("agent"), F.col("attempt")))
    evidence = {"loop": F.col("loop"), "diff": F.when(k % 4 != 0, k), "trace": F.when(k % 5 != 0, k)}
    reason = statuses.training_block(chosen(k, "model", "model", "control", "model"), chosen(F.floor(k / 2), "practice", "dev", "heldout"), k % 9 == 0, F.col("failed"), F.when(k % 6 != 0, "complete"), evidence, "model", ("heldout",))
    return a.select(F.coalesce(reason, F.lit("none")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _calls(spark, d):
    """Each user's events as tool calls; the workspace changes with every call of the first kind."""
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changes = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0))
    return e.select("user_id", "event_id", "ts", "event_type", (F.col("event_id") % 2).alias("arguments"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), changes.over(w).alias("after"), F.coalesce(changes.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.col("event_id") % 3 == 0).cast("int").alias("observation"), F.row_number().over(w).alias("ordinal"))


def redundant_calls(spark, d):
    """Blocks of successful calls that repeat the one before them without changing or seeing anything new."""
    blocks = repeated_calls(_calls(spark, d), "user_id", "ordinal", ["event_type", "arguments"], "status", "before", "after", "observation")
    return blocks.select("user_id", "baseline", "n_redundant", "event_type")


def calls_left(spark, d):
    """Each user's calls without the redundant ones, numbered anew."""
    left = without(_calls(spark, d), "user_id", "ordinal", ["event_type", "arguments"], "status", "before", "after", "observation")
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").cast("long").alias("ordinals"), F.max("call_id").alias("last_call"))


def idempotency(spark, d):
    """Checks (an event type of a user) that were run twice or more: whether workspace or results drift, some runs being failures."""
    runs = read(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 40 == 0).alias("failed"), F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 2).otherwise(0).alias("before"), F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 5).otherwise(0).alias("result"))
    state = F.greatest(F.max("before"), F.lit(0)) != F.least(F.min("before"), F.lit(0))
    result = F.when(~F.col("failed"), F.col("result"))
    g = runs.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("runs"), state.alias("state"), F.coalesce(F.min(result) != F.max(result), F.lit(False)).alias("drift"), F.bool_or("failed").alias("failed")).where("runs >= 2")
    reasons = F.array_join(F.filter(F.array(F.when(F.col("state"), "workspace"), F.when(F.col("drift"), "result")), lambda x: x.isNotNull()), "+")
    status = F.when(F.col("state") | F.col("drift"), "NON_IDEMPOTENT").when(F.col("failed"), "INCONCLUSIVE").otherwise("IDEMPOTENT")
    return g.groupBy(status.alias("status"), reasons.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def leakage_scan(spark, d):
    """Each conversation against its own canary and private markers: turns that hold the canary, turns that hold a marker, all refs."""
    c = F.col("conv_id").cast("string")
    t = read(spark, d, "conversations")
    canary = F.concat(F.lit("canary-"), c, F.lit("-end"))
    hit = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" "), canary)).when(F.col("turn") % 4 == 2, F.concat(F.lit(" see checks/set_"), c)).when(F.col("turn") % 4 == 3, F.lit(" 'private_note'")).otherwise(F.lit(" private_note"))
    t = t.select("conv_id", canary.alias("canary"), F.concat(F.lit("turn/"), canary, F.lit("/"), F.col("turn").cast("string")).alias("ref"), F.concat("text", hit).alias("text"), F.array_distinct(F.concat(path_markers(F.concat(F.lit("checks/set_"), c, F.lit("/test_a.py"))), field_markers("private_note"))).alias("markers"))
    found = t.select("conv_id", "canary", redacted_ref(F.col("ref"), F.col("canary")).alias("ref"), F.contains("text", "canary").alias("canary_hit"), touched(F.col("text"), F.col("markers")).alias("marker_hit"))
    refs = lambda hit: F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("ref")))), ",")
    return found.groupBy("conv_id").agg(F.max(canary_hash(F.col("canary"))).alias("canary_hash"), refs(F.col("canary_hit")).alias("canary_refs"), refs(F.col("marker_hit")).alias("marker_refs"), F.count("ref").alias("n_scanned"))


def token_labels(spark, d):
    """Documents cut into tokens of five characters; the model owns all from a place on, which is inside a token in some."""
    n = F.length(F.coalesce("text", F.lit("")))
    rows = read(spark, d, "documents").where("length(text) > 0").select("doc_id", n.alias("n"), (F.floor(n / 15) * 5 + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).cast("int").alias("owned"))
    size = (F.ceil(F.col("n") / 5)).cast("int")
    offsets = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct((i * 5).alias("start"), F.least(i * 5 + 5, F.col("n")).alias("stop")))
    spans = F.array(F.struct(F.col("owned").alias("start"), F.col("n").alias("stop")))
    return label_layout(rows, offsets, spans, F.col("n")).select("doc_id", "status", "n_owned", "n_ignored", "first_owned", "contiguous", "n_targets")


QUERIES = {f.__name__: f for f in (attempt_grades, attempt_components, attempt_violations, training_blocks, redundant_calls, calls_left, idempotency, leakage_scan, token_labels)}

_A = """a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN ['scored', 'agent_loop_failed', 'orchestrator_error'][(o_orderkey // 5 % 3)::INT + 1] END AS agent,
    CASE WHEN o_orderkey % 7 <> 0 THEN ['completed', 'max_turns_exceeded', 'invalid_model_output', 'terminal_tool_error', NULL][(o_orderkey // 3 % 5)::INT + 1] END AS loop,
    CASE WHEN o_orderkey % 11 <> 0 THEN ['PASS', 'PATCH_APPLY_ERROR', 'PUBLIC_TEST_FAIL', 'HIDDEN_TEST_FAIL', 'INVALID_SHORTCUT', 'HIDDEN_VALIDATOR_ACCESS_ATTEMPT', 'ORCHESTRATOR_ERROR', 'TIMEOUT'][(o_orderkey % 8)::INT + 1] END AS attempt,
    CASE WHEN o_orderkey % 11 <> 0 OR o_orderkey % 22 = 0 THEN ['PASS', 'FAIL', 'NOT_RUN'][(o_orderkey // 8 % 3)::INT + 1] END AS public,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN ['PASS', 'FAIL', 'NOT_RUN'][(o_orderkey // 24 % 3)::INT + 1] END AS hidden FROM orders),
  b AS (SELECT *, coalesce(attempt = 'PASS' AND public = 'PASS' AND hidden = 'PASS', false) AND coalesce(agent IS NULL OR (agent = 'scored' AND loop = 'completed'), false) AS success FROM a)"""
_CALLS = """c AS (SELECT *, event_id % 2 AS arguments, event_type = 'error' AS bad, event_id % 3 = 0 AS seen, row_number() OVER w AS ordinal, sum((event_type = 'signup')::INT) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  p AS (SELECT *, coalesce(NOT bad AND NOT lag(bad) OVER w AND event_type = lag(event_type) OVER w AND arguments = lag(arguments) OVER w AND event_type <> 'signup' AND seen = lag(seen) OVER w, false) AS again FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ordinal))"""
SQL = {
    "attempt_grades": f"WITH {_A} SELECT agent, loop, CASE WHEN success THEN 'scored_pass' WHEN attempt IS NULL THEN 'cannot_grade' ELSE 'scored_fail' END AS grade, count(*) AS n, count_if(success)::BIGINT AS n_success FROM b GROUP BY 1, 2, 3",
    "attempt_components": f"""WITH {_A} SELECT public = 'PASS' AS public_ok, hidden = 'PASS' AS hidden_ok, loop <> 'invalid_model_output' AS format_ok,
        CASE loop WHEN 'terminal_tool_error' THEN false WHEN 'completed' THEN true WHEN 'max_turns_exceeded' THEN true END AS tools_ok, agent IS NOT DISTINCT FROM 'orchestrator_error' OR attempt IS NOT DISTINCT FROM 'ORCHESTRATOR_ERROR' AS failed, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5""",
    "attempt_violations": f"""WITH {_A}, c AS (SELECT *, ['scored_pass', 'scored_fail', 'cannot_grade'][(id % 3)::INT + 1] AS g, id // 3 % 2 = 0 AS s FROM b), v AS (
          SELECT 'scored_completed' AS rule, id FROM c WHERE agent = 'scored' AND loop IS DISTINCT FROM 'completed'
          UNION ALL SELECT 'failed_loop_has_status', id FROM c WHERE agent = 'agent_loop_failed' AND loop IS NULL UNION ALL SELECT 'failed_loop_not_completed', id FROM c WHERE agent = 'agent_loop_failed' AND loop = 'completed'
          UNION ALL SELECT 'loop_needs_agent', id FROM c WHERE agent IS NULL AND loop IS NOT NULL
          UNION ALL SELECT 'checks_need_attempt', id FROM c WHERE attempt IS NULL AND coalesce(public, hidden) IS NOT NULL UNION ALL SELECT 'attempt_needs_checks', id FROM c WHERE attempt IS NOT NULL AND (public IS NULL OR hidden IS NULL)
          UNION ALL SELECT 'checks_agree', id FROM c WHERE NOT CASE attempt WHEN 'PASS' THEN public || hidden = 'PASSPASS' WHEN 'PUBLIC_TEST_FAIL' THEN public || hidden = 'FAILNOT_RUN' WHEN 'HIDDEN_TEST_FAIL' THEN public || hidden = 'PASSFAIL'
            WHEN 'TIMEOUT' THEN public || hidden IN ('NOT_RUNNOT_RUN', 'FAILNOT_RUN', 'PASSFAIL') ELSE public || hidden = 'NOT_RUNNOT_RUN' END AND attempt IS NOT NULL
          UNION ALL SELECT 'cannot_grade_no_success', id FROM c WHERE g = 'cannot_grade' AND s UNION ALL SELECT 'success_is_scored_pass', id FROM c WHERE s AND g <> 'scored_pass' UNION ALL SELECT 'scored_pass_is_success', id FROM c WHERE g = 'scored_pass' AND NOT s
          UNION ALL SELECT 'scored_pass_all_pass', id FROM c WHERE g = 'scored_pass' AND coalesce(attempt || public || hidden, '') <> 'PASSPASSPASS' UNION ALL SELECT 'scored_fail_no_success', id FROM c WHERE g = 'scored_fail' AND s
          UNION ALL SELECT 'scored_fail_has_attempt', id FROM c WHERE g = 'scored_fail' AND attempt IS NULL)
        SELECT rule, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM v GROUP BY rule""",
    "training_blocks": f"""WITH {_A}, m AS (SELECT *, concat_ws(', ', CASE WHEN loop IS NULL THEN 'loop' END, CASE WHEN id % 4 = 0 THEN 'diff' END, CASE WHEN id % 5 = 0 THEN 'trace' END) AS missing FROM b)
        SELECT CASE WHEN id % 4 = 2 THEN 'not from a model' WHEN id // 2 % 3 = 2 THEN 'split kept out of training' WHEN id % 9 = 0 THEN 'leak in what the model saw' WHEN coalesce(agent = 'orchestrator_error', false) OR coalesce(attempt = 'ORCHESTRATOR_ERROR', false) THEN 'orchestration failed'
          WHEN id % 6 = 0 THEN 'detection not complete' WHEN missing <> '' THEN 'evidence missing: ' || missing ELSE 'none' END AS reason, count(*) AS n FROM m GROUP BY 1""",
    "redundant_calls": f"""WITH {_CALLS}, g AS (SELECT *, ordinal - sum(again::INT) OVER (PARTITION BY user_id ORDER BY ordinal) AS block FROM p)
        SELECT user_id, min(ordinal)::INT AS baseline, count(*) - 1 AS n_redundant, any_value(event_type) AS event_type FROM g GROUP BY user_id, block HAVING count(*) > 1""",
    "calls_left": f"""WITH {_CALLS} SELECT user_id, count(*) AS n, sum(ordinal)::BIGINT AS ordinals, 'tool_call_' || lpad(count(*)::VARCHAR, 4, '0') AS last_call FROM p WHERE NOT again GROUP BY user_id""",
    "idempotency": """WITH r AS (SELECT user_id, event_type, event_id % 40 = 0 AS failed, CASE WHEN user_id % 4 = 0 THEN event_id % 2 ELSE 0 END AS b, CASE WHEN user_id % 3 = 0 THEN event_id % 5 ELSE 0 END AS res FROM events),
        g AS (SELECT user_id, event_type, len(list_distinct(list_append(list(b), 0))) > 1 AS w, count(DISTINCT CASE WHEN NOT failed THEN res END) > 1 AS d, bool_or(failed) AS f FROM r GROUP BY ALL HAVING count(*) >= 2)
        SELECT CASE WHEN w OR d THEN 'NON_IDEMPOTENT' WHEN f THEN 'INCONCLUSIVE' ELSE 'IDEMPOTENT' END AS status, concat_ws('+', CASE WHEN w THEN 'workspace' END, CASE WHEN d THEN 'result' END) AS reasons, count(*) AS n FROM g GROUP BY 1, 2""",
    "leakage_scan": """WITH t AS (SELECT conv_id, turn, 'turn/[hidden]/' || turn AS ref, 'canary-' || conv_id || '-end' AS canary FROM conversations)
        SELECT conv_id, max(md5(canary)) AS canary_hash, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (turn % 4 = 1), '') AS canary_refs, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (turn % 4 IN (2, 3)), '') AS marker_refs, count(*) AS n_scanned FROM t GROUP BY conv_id""",
    "token_labels": """WITH d AS (SELECT doc_id, length(text) AS n, length(text) // 15 AS k, (length(text) + 4) // 5 AS size, doc_id % 4 = 0 AS shifted FROM documents WHERE length(text) > 0),
        s AS (SELECT *, CASE WHEN shifted AND n <= k * 5 + 1 THEN 'span outside' WHEN shifted THEN 'crossing' ELSE 'labelled' END AS status FROM d)
        SELECT doc_id, status, CASE WHEN status = 'labelled' THEN size - k END AS n_owned, CASE WHEN status = 'labelled' THEN k END AS n_ignored, CASE WHEN status = 'labelled' THEN k END AS first_owned, CASE WHEN status = 'labelled' THEN true END AS contiguous,
          CASE WHEN status = 'labelled' THEN size - greatest(k, 1) END AS n_targets FROM s""",
}
