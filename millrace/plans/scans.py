"""Queries over records as they are found: typed scans, links between calls and results, evidence, JSON of any schema; made from orders,
lineitem and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions.hashing import derived_id
from ..operators import evidence, linkage
from ..operators.stages import fresh_folder
from ..sources.typed import Field, accepted, rejected, scan
from ..sources.unions import decoded_action, observation
from .reviews import read

C = F.col
FIELDS = [
    Field("o_orderkey", "integer", rules=(("negative", lambda v: v >= 0),), as_type="bigint"),
    Field("o_custkey", "integer", as_type="bigint"),
    Field("o_orderstatus", "string", rules=(("unknown", lambda v: v.isin("O", "F", "P")),)),
    Field("o_totalprice", "number", rules=(("not positive", lambda v: v > 0),)),
    Field("o_orderpriority", "string", required=False, nullable=True),
]
ORDERS_IN_A_FILE = 4000


def _order_files(spark, d) -> str:
    """Orders as JSONL, by key, in files of 4000; those in progress, very dear ones and those of the first customers have faults."""
    key, price = C("o_orderkey").cast("string"), C("o_totalprice").cast("string")
    in_progress = lambda n: (C("o_orderstatus") == "P") & C("o_orderpriority").startswith(n)
    customer = F.when(C("o_custkey") < 20, "null").otherwise(C("o_custkey").cast("string"))
    price = F.when(C("o_totalprice") > 480_000, F.concat(F.lit('"'), price, F.lit('"'))).when(C("o_totalprice") < 5_000, F.concat(F.lit("-"), price)).otherwise(price)
    status = F.when(in_progress("4"), "").otherwise(F.concat(F.lit('"o_orderstatus": "'), "o_orderstatus", F.lit('", ')))
    note = F.when(in_progress("5") & (C("o_totalprice") > 250_000), ', "note": null, "extra": 1').otherwise("")
    whole = F.concat(F.lit('{"o_orderkey": '), key, F.lit(', "o_custkey": '), customer, F.lit(", "), status, F.lit('"o_totalprice": '), price, F.lit(', "o_orderpriority": "'), "o_orderpriority", F.lit('"'), note, F.lit("}"))
    line = F.when(in_progress("1"), F.substr(whole, F.lit(1), F.lit(30))).when(in_progress("2"), " ").when(in_progress("3"), F.concat(F.lit("["), key, F.lit("]"))).otherwise(whole)
    path = fresh_folder(spark, "order-lines")
    rows = read(spark, d, "orders").select(F.floor(C("o_orderkey") / ORDERS_IN_A_FILE).alias("part"), "o_orderkey", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    return path


def _part():
    return F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")


def typed_order_rejects(spark, d):
    return rejected(scan(spark, _order_files(spark, d), FIELDS)).select(_part(), "line", "reason")


def typed_trace_rejects(spark, d):
    """The same lines as a log in which a blank line is an error, and further fields are not."""
    return rejected(scan(spark, _order_files(spark, d), FIELDS, blank="error", closed=False)).select(_part(), "line", "reason")


def typed_order_totals(spark, d):
    rows = accepted(scan(spark, _order_files(spark, d), FIELDS))
    return rows.groupBy(_part()).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"), F.sum(C("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark, d):
    return read(spark, d, "lineitem").withColumn("id", F.concat(F.lit("call_"), C("l_linenumber").cast("string")))


def order_links(spark, d):
    """Lines of orders as calls, answered by those with a low tax; results of large quantities come first, those of 13 are not there,
    and some others are too many."""
    lines = _lines(spark, d)
    at = C("l_linenumber").cast("long")
    calls = lines.where("l_quantity <> 31").select("l_orderkey", "id", at.alias("at"), (~((C("l_returnflag") == "R") & (C("l_quantity") < 3))).alias("is_tool"), C("l_returnflag").alias("name"), C("l_partkey").alias("arguments"))
    answered = linkage.ordinals(lines.where("l_tax < 0.075"), "l_orderkey", LINE_ORDER)
    messages = answered.select("l_orderkey", "ordinal", F.when(C("l_discount") < 0.095, C("id")).alias("id"), F.when(C("l_quantity") == 50, at - 1).otherwise(at + 1).alias("at"), C("l_returnflag").alias("name"), C("l_suppkey").alias("content"))
    given = lines.where("l_tax < 0.075 and l_quantity <> 13 or l_tax >= 0.075 and l_quantity = 7").withColumn("late", C("l_quantity") < 45)
    given = linkage.ordinals(given, "l_orderkey", ["late", *LINE_ORDER])
    results = given.select("l_orderkey", "ordinal", "id", F.when(C("l_extendedprice") > 90_000, "?").otherwise(C("l_returnflag")).alias("name"), (C("l_suppkey") + F.when(C("l_quantity") == 20, 1).otherwise(0)).alias("content"), (C("l_partkey") + F.when(C("l_quantity") == 21, 1).otherwise(0)).alias("arguments"))
    return linkage.linked_calls(calls, messages, results, "l_orderkey")


def calls_removed(spark, d):
    """Returned lines are taken out of an order's messages and, at the same places, out of its results."""
    rows = linkage.ordinals(_lines(spark, d), "l_orderkey", LINE_ORDER)
    messages = rows.select("l_orderkey", "ordinal", "id")
    results = rows.select("l_orderkey", "ordinal", C("l_partkey").alias("part"))
    dropped = rows.where("l_returnflag = 'R'").select("l_orderkey", "id")
    left_messages, left_results = linkage.without_calls(messages, results, dropped, "l_orderkey")
    return left_messages.join(left_results, ["l_orderkey", "ordinal"]).select("l_orderkey", "ordinal", "id", "part")


def _turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", C("turn").alias("at"), "role", F.lit("").alias("name"), C("text").alias("content"))


def running_prefix(spark, d):
    """Of every turn of the assistant with two turns or more before it, the chain of the hashes of those, and how many come after."""
    found = evidence.occurrences(_turns(spark, d), "conv_id")
    return evidence.recorded(found, "conv_id").select("conv_id", "ordinal", C("prefix").alias("prefix_md5"), "n_left")


def rebuilt_evidence(spark, d):
    """Recorded evidence of which some is changed, by the first digit of the action's hash, held against the conversations."""
    found = evidence.occurrences(_turns(spark, d), "conv_id")
    rows = evidence.recorded(found, "conv_id")
    digit = F.substr("action", F.lit(1), F.lit(1))
    changed = rows.select(
        F.when(digit == "3", F.lit("evidence_0")).otherwise(C("evidence_id")).alias("evidence_id"),
        F.when(digit == "0", -1 - C("conv_id")).otherwise(C("conv_id")).alias("conv_id"),
        (C("ordinal") + F.when(digit == "1", 1000).when(digit == "2", -1).when(digit == "7", -2).otherwise(0)).alias("ordinal"),
        (C("n_left") + F.when(digit == "6", 1).otherwise(0)).alias("n_left"),
        F.when(digit == "5", F.md5("action")).otherwise(C("action")).alias("action"),
        F.when(digit == "4", F.md5("prefix")).otherwise(C("prefix")).alias("prefix"),
    )
    own = evidence.evidence_id(C("conv_id"), C("ordinal"), C("action"), C("prefix"))
    changed = changed.withColumn("evidence_id", F.when(digit.isin("4", "5") | (F.md5("action") > "8"), own).otherwise(C("evidence_id")))
    return evidence.held_against(changed, found, "conv_id")


VOLATILE = ("created_at", "duration_ms")


def _order_records(spark, d):
    """Orders as nested JSON with numbers in several spellings, keys out of order, and times at all depths."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    line = lambda x: text('{ "part":', x["l_partkey"], '.0, "duration_ms": {"v": [', x["l_quantity"], ']}, "at": ["ran in ', x["l_suppkey"], '.5s", {"tax": 1', x["l_linenumber"], 'e400, "created_at": null}] }')
    lines = read(spark, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    orders = read(spark, d, "orders").join(lines, "o_orderkey", "left")
    items = F.coalesce(F.array_join(F.transform("lines", line), " , "), F.lit(""))
    whole = text('{"status":"', C("o_orderstatus"), '","id":1', C("o_orderkey"), '00000000000000000000000000000000000001, "lines" : [', items, '], "created_at": "', C("o_orderdate"), '", "a": {}}')
    return orders.select("o_orderkey", whole.alias("record"))


def _told_time(text):
    return F.regexp_replace(text, r"\bin \d+(?:\.\d+)?s\b", "in <SECONDS>")


def records_without_times(spark, d):
    return _order_records(spark, d).select("o_orderkey", jsontext.normalized_json(C("record"), dropped=VOLATILE, rule=_told_time).alias("normal"))


def records_with_placeholders(spark, d):
    return _order_records(spark, d).select("o_orderkey", jsontext.normalized_json(C("record"), replaced={k: f"<{k.upper()}>" for k in VOLATILE}, rule=_told_time).alias("normal"))


def exact_record_hashes(spark, d):
    return _order_records(spark, d).select("o_orderkey", F.md5(jsontext.exact_json(C("record"))).alias("record_md5"), jsontext.nesting(C("record")).cast("long").alias("depth"))


def _outputs(spark, d):
    """Orders as what an agent said: by priority answers, calls of a tool that lists, of one that reads, unknown actions, and others."""
    price, of = C("o_totalprice"), lambda n: C("o_orderpriority").startswith(n)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    said = (
        F.when(of("1"), text('{"action": "final_answer", "text": "', F.when(price < 100_000, "").otherwise(C("o_orderstatus")), '"}'))
        .when(of("2"), text('{"tool_name": "list_files", "action": "tool_call", "arguments": {"max_depth": ', C("o_custkey") % 30, F.when(price < 100_000, ', "path": ""').otherwise(""), "}}"))
        .when(of("3"), text('{"action": "tool_call", "tool_name": "read_file"', F.when(price > 200_000, ', "arguments": {"path": "a/b"}').when(price < 50_000, ', "arguments": [1]').otherwise(""), "}"))
        .when(of("4"), text("{", F.when(price > 200_000, '"action": "think"').when(price < 50_000, '"action": 7').otherwise('"text": "?"'), "}"))
        .otherwise(text('{"action": "tool_call", "tool_name": "', F.when(price > 200_000, "rm").otherwise("run_tests"), '", "arguments": {"command": "go", "x": 1}', F.when(price < 100_000, ', "note": 1').otherwise(""), "}", F.when(price < 50_000, "}").otherwise("")))
    )
    return read(spark, d, "orders").select("o_orderkey", said.alias("said"))


def decoded_actions(spark, d):
    rows = _outputs(spark, d).select("o_orderkey", decoded_action(C("said")).alias("a"), observation(C("said")).alias("o"))
    return rows.select("o_orderkey", "a.error", "a.tag", "a.tool_name", "a.text", F.to_json("a.arguments").alias("arguments"), "a.tool.path", "a.tool.max_depth", "a.tool.max_files", "a.tool.command", C("o.error").alias("seen"))


QUERIES = {f.__name__: f for f in (decoded_actions, typed_order_rejects, typed_trace_rejects, typed_order_totals, order_links, calls_removed, running_prefix, rebuilt_evidence, records_without_times, records_with_placeholders, exact_record_hashes)}

_LINES = """ob AS (SELECT *, o_orderstatus = 'P' AS p, left(o_orderpriority, 1) AS n FROM orders),
    ol AS (SELECT o_orderkey // 4000 AS part, o_orderkey, '{"o_orderkey": ' || o_orderkey || ', "o_custkey": ' || CASE WHEN o_custkey < 20 THEN 'null' ELSE o_custkey::VARCHAR END || ', ' || CASE WHEN p AND n = '4' THEN '' ELSE '"o_orderstatus": "' || o_orderstatus || '", ' END
        || '"o_totalprice": ' || CASE WHEN o_totalprice > 480000 THEN '"' || o_totalprice || '"' WHEN o_totalprice < 5000 THEN '-' || o_totalprice ELSE o_totalprice::VARCHAR END || ', "o_orderpriority": "' || o_orderpriority || '"' || CASE WHEN p AND n = '5' AND o_totalprice > 250000 THEN ', "note": null, "extra": 1' ELSE '' END || '}' AS w, p, n FROM ob),
    l AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY o_orderkey) AS line, CASE WHEN p AND n = '1' THEN left(w, 30) WHEN p AND n = '2' THEN ' ' WHEN p AND n = '3' THEN '[' || o_orderkey || ']' ELSE w END AS v FROM ol),
    j AS (SELECT part, line, v, trim(v) = '' AS blank, json_valid(v) AS valid, CASE WHEN json_valid(v) THEN v ELSE '{}' END::JSON AS o FROM l),
    r AS (SELECT *, CASE WHEN blank THEN 'blank line' WHEN NOT valid THEN 'no JSON' WHEN json_type(o) <> 'OBJECT' THEN 'no object' END AS shape, CASE WHEN json_exists(o, '$.extra') THEN 'unknown field extra' END AS strange,
        CASE WHEN json_type(o, '$.o_custkey') = 'NULL' THEN 'o_custkey: null' WHEN NOT json_exists(o, '$.o_orderstatus') THEN 'o_orderstatus: missing' WHEN json_type(o, '$.o_totalprice') = 'VARCHAR' THEN 'o_totalprice: no number' WHEN (o->>'o_totalprice')::DOUBLE <= 0 THEN 'o_totalprice: not positive' END AS field FROM j)"""
_L = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_CHAIN = """t AS (SELECT conv_id, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY conv_id) AS n, role, md5(text) AS action, md5(role || chr(31) || chr(31) || text) AS digest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    chain AS (SELECT conv_id, ordinal, md5('') AS prefix, digest FROM t WHERE ordinal = 0 UNION ALL SELECT t.conv_id, t.ordinal, md5(chain.prefix || chain.digest), t.digest FROM chain JOIN t ON t.conv_id = chain.conv_id AND t.ordinal = chain.ordinal + 1),
    occ AS (SELECT conv_id, ordinal, n - ordinal - 1 AS n_left, role, action, prefix FROM t JOIN chain USING (conv_id, ordinal)),
    rec AS (SELECT 'evidence_' || md5(concat_ws(chr(31), conv_id, ordinal, action, prefix)) AS evidence_id, conv_id, ordinal, n_left, action, prefix FROM occ WHERE role = 'assistant' AND ordinal >= 2)"""


def _records(told, made, took, own):
    line = """'{"at":["ran """ + told + """",{""" + made + """"tax":1' || l_linenumber || 'e400}],""" + took + """"part":' || l_partkey || '.0}'"""
    return f"""WITH li AS (SELECT l_orderkey AS o_orderkey, string_agg({line}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS items FROM lineitem GROUP BY 1),
        rec AS (SELECT o_orderkey, '{{"a":{{}},{own}"id":1' || o_orderkey || '00000000000000000000000000000000000001,"lines":[' || coalesce(items, '') || '],"status":"' || o_orderstatus || '"}}' AS normal FROM orders LEFT JOIN li USING (o_orderkey))"""


SQL = {
    "typed_order_rejects": f"WITH {_LINES} SELECT part, line, coalesce(shape, strange, field) AS reason FROM r WHERE NOT blank AND coalesce(shape, strange, field) IS NOT NULL",
    "typed_trace_rejects": f"WITH {_LINES} SELECT part, line, coalesce(shape, field) AS reason FROM r WHERE coalesce(shape, field) IS NOT NULL",
    "typed_order_totals": f"WITH {_LINES} SELECT part, count(*) AS n, sum((o->>'o_custkey')::BIGINT)::BIGINT AS customers, sum((o->>'o_totalprice')::DECIMAL(18,2))::DECIMAL(38,2) AS total, min(line) AS first_line, max(line) AS last_line FROM r WHERE coalesce(shape, strange, field) IS NULL GROUP BY part",
    "order_links": f"""WITH li AS (SELECT *, 'call_' || l_linenumber AS id FROM lineitem),
        c AS (SELECT l_orderkey, id, count(*) AS n, min((l_linenumber, NOT (l_returnflag = 'R' AND l_quantity < 3), l_returnflag, l_partkey)) AS k FROM li WHERE l_quantity <> 31 GROUP BY ALL),
        m AS (SELECT l_orderkey, row_number() OVER ({_L}) - 1 AS ordinal, CASE WHEN l_discount < 0.095 THEN id END AS id, CASE WHEN l_quantity = 50 THEN l_linenumber - 1 ELSE l_linenumber + 1 END AS at, l_returnflag AS name, l_suppkey AS content FROM li WHERE l_tax < 0.075),
        g AS (SELECT *, l_quantity < 45 AS late FROM li WHERE (l_tax < 0.075 AND l_quantity <> 13) OR (l_tax >= 0.075 AND l_quantity = 7)),
        r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY late, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal, id, CASE WHEN l_extendedprice > 90000 THEN '?' ELSE l_returnflag END AS name,
            l_suppkey + CASE WHEN l_quantity = 20 THEN 1 ELSE 0 END AS content, l_partkey + CASE WHEN l_quantity = 21 THEN 1 ELSE 0 END AS arguments FROM g)
        SELECT l_orderkey, ordinal, coalesce(m.id, r.id) AS id, CASE
            WHEN m.name IS NOT NULL AND m.id IS NULL THEN 'message without id'
            WHEN (SELECT count(*) FROM m x WHERE x.l_orderkey = m.l_orderkey AND x.id = m.id) > 1 THEN 'id answered twice'
            WHEN c.n > 1 THEN 'id called twice'
            WHEN m.name IS NOT NULL AND c.n IS NULL THEN 'no call'
            WHEN m.name IS NOT NULL AND NOT c.k[2] THEN 'call is no tool call'
            WHEN m.name IS NOT NULL AND c.k[1] >= m.at THEN 'call comes later'
            WHEN m.name IS NOT NULL AND (r.name IS NULL OR NOT EXISTS (SELECT 1 FROM r y WHERE y.l_orderkey = m.l_orderkey AND y.id = m.id)) THEN 'result missing'
            WHEN r.name IS NOT NULL AND (m.name IS NULL OR NOT EXISTS (SELECT 1 FROM m y WHERE y.l_orderkey = r.l_orderkey AND y.id = r.id)) THEN 'result surplus'
            WHEN m.id <> r.id THEN 'result swapped'
            WHEN m.name <> r.name OR c.k[3] <> r.name THEN 'name differs'
            WHEN m.content <> r.content THEN 'content differs'
            WHEN c.k[4] <> r.arguments THEN 'arguments differ' END AS problem
        FROM m FULL JOIN r USING (l_orderkey, ordinal) LEFT JOIN c ON c.l_orderkey = m.l_orderkey AND c.id = m.id""",
    "calls_removed": f"""WITH li AS (SELECT l_orderkey, 'call_' || l_linenumber AS id, l_partkey AS part, row_number() OVER ({_L}) AS pos, l_returnflag FROM lineitem)
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) - 1 AS ordinal, id, part FROM li WHERE NOT EXISTS (SELECT 1 FROM li x WHERE x.l_orderkey = li.l_orderkey AND x.id = li.id AND x.l_returnflag = 'R')""",
    "running_prefix": f"WITH RECURSIVE {_CHAIN} SELECT conv_id, ordinal, prefix AS prefix_md5, n_left FROM rec",
    "rebuilt_evidence": f"""WITH RECURSIVE {_CHAIN},
        d AS (SELECT *, left(action, 1) AS d FROM rec),
        ch AS (SELECT CASE WHEN d = '3' THEN 'evidence_0' ELSE evidence_id END AS own, CASE WHEN d = '0' THEN -1 - conv_id ELSE conv_id END AS conv_id, ordinal + CASE d WHEN '1' THEN 1000 WHEN '2' THEN -1 WHEN '7' THEN -2 ELSE 0 END AS ordinal,
            n_left + (d = '6')::INT AS n_left, CASE WHEN d = '5' THEN md5(action) ELSE action END AS action, CASE WHEN d = '4' THEN md5(prefix) ELSE prefix END AS prefix FROM d),
        derived AS (SELECT *, 'evidence_' || md5(concat_ws(chr(31), conv_id, ordinal, action, prefix)) AS derived FROM ch),
        ev AS (SELECT CASE WHEN left(action, 1) IN ('4', '5') OR md5(action) > '8' THEN derived ELSE own END AS evidence_id, * EXCLUDE (own) FROM derived)
        SELECT evidence_id, ev.conv_id, ev.ordinal, ev.n_left, ev.action, ev.prefix, CASE
            WHEN ev.conv_id NOT IN (SELECT conv_id FROM occ) THEN 'unknown transcript' WHEN occ.role IS NULL THEN 'no such place' WHEN occ.role <> 'assistant' THEN 'no action' WHEN ev.ordinal < 2 THEN 'too little context'
            WHEN evidence_id <> derived THEN 'id not derived' WHEN ev.prefix <> occ.prefix THEN 'context differs' WHEN ev.action <> occ.action THEN 'action differs' WHEN ev.n_left <> occ.n_left THEN 'rest differs' END AS problem
        FROM ev LEFT JOIN occ ON occ.conv_id = ev.conv_id AND occ.ordinal = ev.ordinal""",
    "records_without_times": _records("in <SECONDS>", "", "", "") + " SELECT o_orderkey, normal FROM rec",
    "records_with_placeholders": _records("in <SECONDS>", '"created_at":"<CREATED_AT>",', '"duration_ms":"<DURATION_MS>",', '"created_at":"<CREATED_AT>",') + " SELECT o_orderkey, normal FROM rec",
    "exact_record_hashes": _records("in ' || l_suppkey || '.5s", '"created_at":null,', """"duration_ms":{"v":[' || l_quantity || ']},""", """"created_at":"' || o_orderdate || '",""") + """ SELECT o_orderkey, md5(normal) AS record_md5, CASE WHEN normal LIKE '%"lines":[]%' THEN 2 ELSE 5 END AS depth FROM rec""",
    "decoded_actions": """WITH o AS (SELECT o_orderkey, left(o_orderpriority, 1) AS n, o_totalprice AS p, o_orderstatus AS s, o_custkey % 30 AS k FROM orders),
        e AS (SELECT *, CASE n WHEN '1' THEN CASE WHEN p < 100000 THEN 'text: empty' END WHEN '2' THEN CASE WHEN p < 100000 THEN 'arguments.path: empty' WHEN k > 20 THEN 'arguments.max_depth: not between 0 and 20' END
            WHEN '3' THEN CASE WHEN p > 200000 THEN NULL WHEN p < 50000 THEN 'arguments: no object' ELSE 'arguments.path: missing' END WHEN '4' THEN CASE WHEN p > 200000 THEN 'action: unknown think' WHEN p < 50000 THEN 'action: unknown 7' ELSE 'action: missing' END
            ELSE CASE WHEN p < 50000 THEN 'no JSON' WHEN p < 100000 THEN 'unknown field note' WHEN p > 200000 THEN 'arguments.tool_name: unknown rm' ELSE 'arguments.unknown field x' END END AS error FROM o),
        f AS (SELECT *, error IS NULL OR (error LIKE 'arguments.%') AS action FROM e)
        SELECT o_orderkey, error, CASE WHEN action THEN CASE n WHEN '1' THEN 'final_answer' ELSE 'tool_call' END END AS tag, CASE WHEN action THEN CASE n WHEN '2' THEN 'list_files' WHEN '3' THEN 'read_file' WHEN '5' THEN CASE WHEN p > 200000 THEN 'rm' ELSE 'run_tests' END END END AS tool_name,
            CASE WHEN action AND n = '1' THEN s END AS text, CASE WHEN action THEN CASE n WHEN '2' THEN '{"max_depth":' || k || CASE WHEN p < 100000 THEN ',"path":""' ELSE '' END || '}' WHEN '3' THEN CASE WHEN p > 200000 THEN '{"path":"a/b"}' ELSE '{}' END WHEN '5' THEN '{"command":"go","x":1}' END END AS arguments,
            CASE WHEN error IS NULL THEN CASE n WHEN '2' THEN '.' WHEN '3' THEN 'a/b' END END AS path, CASE WHEN error IS NULL AND n = '2' THEN k END AS max_depth, CASE WHEN error IS NULL AND n = '2' THEN 200 END AS max_files, NULL AS command,
            CASE WHEN error = 'no JSON' THEN 'observation is no JSON' END AS seen FROM f""",
}
