"""Queries for preference data: users are contexts, kinds of events the actions in them, events the evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.preferences import alternatives, comparisons, coverage, oriented, response_span, shared_prompt, spans_in_order
from ..operators.summaries import count_true
from .reviews import read


def _alternatives(spark, d):
    e = read(spark, d, "events").withColumn("context", F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    return alternatives(e, "context", "event_type", "event_id")


def _pairs(spark, d):
    return comparisons(_alternatives(spark, d), "context", "event_type")


def _user():
    return F.substring("context", 6, 20).cast("long")


def _verdicts(spark, d):
    """A verdict for most comparisons: preferred, tie or unsure."""
    u = _user()
    p = _pairs(spark, d).where("left <> 'click'")
    outcome = F.when(u % 4 == 0, "tie").when(u % 9 == 0, "unsure").otherwise("preferred")
    return p.select("comparison_id", outcome.alias("outcome"), F.when(outcome == "preferred", F.when(u % 2 == 0, F.col("left")).otherwise(F.col("right"))).alias("preferred"))


def context_alternatives(spark, d):
    return _alternatives(spark, d)


def preference_comparisons(spark, d):
    return _pairs(spark, d).select("context", "left", "right", "comparison_id")


def verdict_counts(spark, d):
    """How many comparisons have each outcome, and how many have none yet."""
    j = _pairs(spark, d).join(_verdicts(spark, d), "comparison_id", "left")
    return j.groupBy(F.coalesce("outcome", F.lit("pending")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("context").alias("n_contexts"))


def verdict_coverage(spark, d):
    """Verdicts against comparisons: some are missing, some are of no comparison, some are there twice."""
    v = _verdicts(spark, d).select("comparison_id")
    more = v.where("comparison_id < 'comparison_1'")
    strange = read(spark, d, "region").select(F.concat(F.lit("comparison_z"), F.col("r_regionkey").cast("string")).alias("comparison_id"))
    found = coverage(_pairs(spark, d).select("comparison_id"), v.unionByName(more).unionByName(strange), "comparison_id")
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def preference_pairs(spark, d):
    return oriented(_pairs(spark, d), _verdicts(spark, d)).select("context", "chosen", "rejected", "pair_id")


def pair_summary(spark, d):
    """By chosen action: pairs, contexts, and how often the lesser name was chosen."""
    p = oriented(_pairs(spark, d), _verdicts(spark, d))
    return p.groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("context").alias("n_contexts"), count_true(F.col("chosen") < F.col("rejected")).alias("n_lesser"))


def prompt_checks(spark, d):
    """Consecutive turns of a conversation as word arrays: whether they share their first word, and whether spans made from their
    lengths are in order and hold one response."""
    c = read(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.split("text", " ").alias("w"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    n, m = F.size("w"), F.size("next")
    span = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    spans = F.array(span(F.lit(0), n), span(n - F.when(F.col("turn") % 3 == 0, 1).otherwise(0), n + m))
    j = a.join(b, ["conv_id", "turn"])
    return j.select("conv_id", "turn", shared_prompt(F.col("w"), F.col("next"), F.lit(1)).alias("shared"), spans_in_order(spans, n + m).alias("in_order"), response_span(spans, n)["stop"].cast("long").alias("response_end"))


QUERIES = {f.__name__: f for f in (context_alternatives, preference_comparisons, verdict_counts, verdict_coverage, preference_pairs, pair_summary, prompt_checks)}

_P = """a AS (SELECT 'user_' || user_id AS context, user_id AS u, event_type, min(event_id) AS evidence, count(DISTINCT event_id) AS n_evidence FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
  p AS (SELECT x.context, x.u, x.event_type AS l, y.event_type AS r, 'comparison_' || md5(x.context || chr(31) || x.event_type || chr(31) || y.event_type) AS id FROM a x JOIN a y ON x.u = y.u AND x.event_type < y.event_type),
  v AS (SELECT id, CASE WHEN u % 4 = 0 THEN 'tie' WHEN u % 9 = 0 THEN 'unsure' ELSE 'preferred' END AS outcome FROM p WHERE l <> 'click'),
  o AS (SELECT p.*, CASE WHEN u % 2 = 0 THEN l ELSE r END AS chosen, CASE WHEN u % 2 = 0 THEN r ELSE l END AS rejected FROM p JOIN v ON v.id = p.id WHERE outcome = 'preferred')"""
SQL = {
    "context_alternatives": f"WITH {_P} SELECT context, event_type, evidence, n_evidence FROM a",
    "preference_comparisons": f'WITH {_P} SELECT context, l AS "left", r AS "right", id AS comparison_id FROM p',
    "verdict_counts": f"WITH {_P} SELECT coalesce(outcome, 'pending') AS outcome, count(*) AS n, count(DISTINCT context) AS n_contexts FROM p LEFT JOIN v ON v.id = p.id GROUP BY 1",
    "verdict_coverage": f"""WITH {_P} SELECT 'missing' AS problem, count(*) AS n FROM p WHERE l = 'click' HAVING count(*) > 0 UNION ALL SELECT 'unknown', count(*) FROM region HAVING count(*) > 0 UNION ALL SELECT 'repeated', count(*) FROM v WHERE id < 'comparison_1' HAVING count(*) > 0""",
    "preference_pairs": f"WITH {_P} SELECT context, chosen, rejected, 'pair_' || md5(id || chr(31) || chosen || chr(31) || rejected) AS pair_id FROM o",
    "pair_summary": f"WITH {_P} SELECT chosen, count(*) AS n, count(DISTINCT context) AS n_contexts, count_if(chosen < rejected)::BIGINT AS n_lesser FROM o GROUP BY chosen",
    "prompt_checks": """WITH a AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), j AS (SELECT x.conv_id, x.turn, x.w AS w, y.w AS v FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
        SELECT conv_id, turn, w[1] = v[1] AS shared, turn % 3 <> 0 AS in_order, CASE WHEN turn % 3 <> 0 THEN len(w) + len(v) END AS response_end FROM j""",
}
