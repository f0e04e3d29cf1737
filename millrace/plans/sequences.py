"""Queries over ordered rows: conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.gates import worst
from ..functions.hashing import canonical_json, ordered_hash
from ..functions.text import counts_text, utc_text
from ..operators import sequences as seq
from ..operators.summaries import count_true, first_seen, median_int
from .reviews import read

E_ORDER = ["ts", "event_id"]


def turn_contiguity(spark, d):
    return seq.contiguous(read(spark, d, "conversations"), "conv_id", "turn", 0)


def event_islands(spark, d):
    found = seq.islands(read(spark, d, "events"), "user_id", E_ORDER, ["event_type"])
    return found.select("user_id", F.col("run").cast("long").alias("run"), "event_type", "length", F.col("__first.event_id").alias("first_event"))


def running_state(spark, d):
    e = read(spark, d, "events")
    state = seq.running_state(e, "user_id", E_ORDER, F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase")
    return state.select("event_id", "last_purchase")


def boundary_slice(spark, d):
    c = seq.up_to_last(read(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "assistant")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def call_adjacency(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w))
    return c.where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_calls"), count_true(F.col("next_role") == "assistant").alias("n_answered"))


def renumbered_turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").where("NOT (role = 'user' AND length(text) < 60)")
    return c.withColumn("n", F.row_number().over(w)).select("conv_id", "turn", F.format_string("tool_call_%04d", F.col("n")).alias("call_id"))


def role_spans(spark, d):
    c = read(spark, d, "conversations")
    own = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    return c.groupBy("conv_id").agg(F.sum(own).cast("long").alias("n_owned"), F.sum(F.length("text") - own).cast("long").alias("n_context"))


def conversation_hashes(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(ordered_hash(F.col("turn"), F.md5(F.concat_ws("|", "role", "text"))).alias("conversation_md5"))


def message_chunks(spark, d):
    c = seq.chunks(read(spark, d, "conversations"), "conv_id", ["turn"], 3)
    return c.groupBy("conv_id", "chunk").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))


def event_type_summary(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), median_int(F.col("value")).alias("median_value"), count_true(F.col("value") > 50).alias("n_high"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(38,4)").alias("total"))


def first_seen_types(spark, d):
    e = read(spark, d, "events")
    return first_seen(e, "user_id", E_ORDER, "event_type").select("user_id", F.array_join("values", ",").alias("types"))


def repeat_drift(spark, d):
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy(*E_ORDER)
    key = F.md5("props")
    r = e.withColumn("first_hash", F.first(key).over(w)).withColumn("same", F.col("first_hash") == key)
    g = r.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("same"))
    status = F.when(F.col("n") < 2, "inconclusive").when(F.col("same"), "stable").otherwise("drifted")
    return g.withColumn("status", status).groupBy("user_id").agg(worst(F.col("status"), "drifted", "inconclusive", "stable").alias("status"), F.count(F.lit(1)).alias("n_groups"))


def next_action_pairs(spark, d):
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(*E_ORDER)
    e = e.withColumn("context", F.lag("event_type").over(w)).where("context IS NOT NULL")
    return seq.unordered_pairs(e, ["user_id", "context"], "event_type")


def merged_intervals(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, d, "events").select("user_id", us.alias("start_us"), (us + 6 * 3600 * 1000000).alias("end_us"))
    return seq.merged_intervals(e, "user_id", "start_us", "end_us")


def canonical_props(spark, d):
    p = F.from_json("props", "struct<k:int>")
    return read(spark, d, "events").select("event_id", F.md5(canonical_json(p)).alias("props_md5"), utc_text(F.col("ts")).alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def type_counts_text(spark, d):
    g = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(counts_text(F.col("event_type"), F.col("n")).alias("counts"))


_P = "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
QUERIES = {f.__name__: f for f in (turn_contiguity, event_islands, running_state, boundary_slice, call_adjacency, renumbered_turns, role_spans, conversation_hashes, message_chunks, event_type_summary, first_seen_types, repeat_drift, next_action_pairs, merged_intervals, canonical_props, type_counts_text)}
SQL = {
    "turn_contiguity": "SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS ok FROM conversations GROUP BY conv_id",
    "event_islands": f"""WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM {_P} THEN 0 ELSE 1 END AS fresh FROM events),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
        SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length, arg_min(event_id, (ts, event_id)) AS first_event FROM r GROUP BY user_id, run, event_type HAVING count(*) >= 2""",
    "running_state": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events",
    "boundary_slice": "SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn <= last GROUP BY conv_id",
    "call_adjacency": "SELECT conv_id, count(*) AS n_calls, count_if(coalesce(nr = 'assistant', false))::BIGINT AS n_answered FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM conversations) WHERE role = 'user' GROUP BY conv_id",
    "renumbered_turns": "SELECT conv_id, turn, printf('tool_call_%04d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS call_id FROM conversations WHERE NOT (role = 'user' AND length(text) < 60)",
    "role_spans": "SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS n_owned, coalesce(sum(length(text)) FILTER (role <> 'assistant'), 0)::BIGINT AS n_context FROM conversations GROUP BY conv_id",
    "conversation_hashes": "SELECT conv_id, md5(string_agg(md5(role || '|' || text), chr(10) ORDER BY turn)) AS conversation_md5 FROM conversations GROUP BY conv_id",
    "message_chunks": "SELECT conv_id, chunk, min(turn) AS first_turn, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations) GROUP BY conv_id, chunk",
    "event_type_summary": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, floor(median(value))::BIGINT AS median_value, count_if(value > 50)::BIGINT AS n_high, sum(value::DECIMAL(18,4))::DECIMAL(38,4) AS total FROM events GROUP BY event_type",
    "first_seen_types": "SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS types FROM (SELECT user_id, event_type, min((ts, event_id)) AS o FROM events GROUP BY ALL) GROUP BY user_id",
    "repeat_drift": """WITH r AS (SELECT user_id, event_type, md5(props) = first_value(md5(props)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS same FROM events),
        g AS (SELECT user_id, CASE WHEN count(*) < 2 THEN 1 WHEN bool_and(same) THEN 2 ELSE 0 END AS s FROM r GROUP BY user_id, event_type)
        SELECT user_id, CASE min(s) WHEN 0 THEN 'drifted' WHEN 1 THEN 'inconclusive' ELSE 'stable' END AS status, count(*) AS n_groups FROM g GROUP BY user_id""",
    "next_action_pairs": f"""WITH a AS (SELECT DISTINCT user_id, context, event_type FROM (SELECT *, {_P} AS context FROM events) WHERE context IS NOT NULL)
        SELECT x.user_id, x.context, x.event_type AS a, y.event_type AS b FROM a x JOIN a y ON x.user_id = y.user_id AND x.context = y.context AND x.event_type < y.event_type""",
    "merged_intervals": """WITH e AS (SELECT user_id, epoch_us(ts) AS start_us, epoch_us(ts) + 21600000000 AS end_us FROM events),
        m AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e),
        r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us FROM r GROUP BY user_id, run""",
    "canonical_props": "SELECT event_id, md5('{\"k\":' || coalesce((props::JSON->>'k'), 'null') || '}') AS props_md5, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, (props::JSON->>'k')::INT AS k FROM events",
    "type_counts_text": "SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY event_type || '=' || n) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id",
}
