"""Queries over replays, controls, packs of tasks and training examples, made from lineitem, orders, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_difference, percentage, roots_replaced
from ..operators.examples import examples, selections, usable_repairs
from ..operators.packs import owners, split_problems, uncovered
from ..operators.replays import artifact_matches, control_match, expectation_rows, unlinked_calls
from .attempts import _A, attempts
from .reviews import read
from .transforms import chosen

C = F.col


def _replays(spark, d):
    """Lines of orders as artifacts: the source has no lines that were accepted, the replay none that were returned."""
    lines = read(spark, d, "lineitem")
    side = lambda flag: lines.where(C("l_returnflag") != flag).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("digest"))
    replay = side("R").withColumn("digest", F.when((C("l_orderkey") + C("l_linenumber")) % 5 == 0, -1).otherwise(C("digest")))
    return artifact_matches(side("A"), replay, "l_orderkey", "l_linenumber", "digest")


def replay_matches(spark, d):
    same = F.array_join(F.transform(F.map_entries("matches"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return _replays(spark, d).select("l_orderkey", same.alias("matches"), "n", "n_matched", "matched")


def replay_rate(spark, d):
    r = _replays(spark, d).agg(F.count(F.lit(1)).alias("n_replays"), F.count_if("matched").alias("n_equal"), F.sum("n_matched").alias("n_matched"), F.sum("n").alias("n_artifacts"))
    return r.select("*", percentage(C("n_matched"), C("n_artifacts")).alias("match_rate"), percentage(C("n_equal"), C("n_replays")).alias("equal_rate"))


def audit_comparisons(spark, d):
    """Attempts against expectations, of which the agent's are declared for some."""
    k = C("id")
    rows = expectation_rows(attempts(spark, d), "id", agent=(F.when(k % 2 == 0, "scored"), C("agent")), loop=(F.when(k % 3 == 0, "completed"), C("loop")), attempt=(chosen(k, "PASS", "TIMEOUT"), C("attempt")))
    return rows.groupBy("field", "expected", "matched").agg(F.count(F.lit(1)).alias("n"), F.count("actual").alias("n_known"))


def control_matches(spark, d):
    """Conversations as controls: the roles of the turns are the steps; some have no expectation."""
    i = C("conv_id")
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("steps"))
    expected = F.when(i % 4 != 0, F.array(F.lit("user"), F.lit("assistant")))
    return c.select("conv_id", control_match(F.when(i % 3 != 0, "completed"), chosen(F.floor(i / 2), "completed", "failed"), expected, C("steps")).alias("matched"))


def call_links(spark, d):
    """A turn of the assistant calls by its number, a user's turn answers the turn before it."""
    t = C("turn")
    return unlinked_calls(read(spark, d, "conversations"), "conv_id", F.when(C("role") == "assistant", t), F.when(C("role") == "user", F.when(t > 0, t - 1)))


def split_lock(spark, d):
    """Documents locked to their language as split, those of one source a second time, against labels as manifests."""
    docs = read(spark, d, "documents").select("doc_id", C("lang").alias("split"), "source")
    lock = docs.drop("source").unionByName(docs.where("source = 'src0'").select("doc_id", F.lit("heldout").alias("split")))
    manifests = read(spark, d, "labels").select("doc_id", F.when(C("quality") == 1, "en").otherwise("de").alias("split"))
    return split_problems(lock, manifests, "doc_id", "split").groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def task_owners(spark, d):
    """Parts as manifests that claim a name and a brand."""
    p = read(spark, d, "part").select(F.concat_ws("/", "p_name", "p_brand", C("p_size").cast("string")).alias("task"), "p_partkey")
    return owners(p, "task", "p_partkey")


def extra_files(spark, d):
    """Addresses of pages as paths; hosts reached safely, and some folders, are required."""
    path = F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^https?://", "")
    p = read(spark, d, "pages").select("page_id", path.alias("path"), F.startswith("url", F.lit("https")).alias("safe"))
    required = p.where("safe").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).unionByName(p.where("not safe and path like '%/en/%'").select(C("path").alias("root")))
    return uncovered(p, "path", required, "root").select("page_id", "path")


def turn_differences(spark, d):
    """Where a turn first differs from the next one."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    following = c.select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("next"))
    pairs = c.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", first_difference(C("text"), C("next")).cast("long").alias("place"), first_difference(C("text"), F.concat("text", F.lit("x"))).cast("long").alias("length"), first_difference(C("text"), C("text")).isNull().alias("same"))


def page_roots(spark, d):
    """Addresses in a line of output, with folders replaced, the longer ones first, where they end as names do."""
    line = F.concat(F.lit("at /tmp/run/"), C("page_id").cast("string"), F.lit(", /tmp, /tmp/runner, /tmp/run and x/tmp/run in /tmp/run.py, /tmp."))
    return read(spark, d, "pages").select("page_id", roots_replaced(line, {"/tmp": "<tmp>", "/tmp/run": "<run>"}).alias("line"))


def _selected(spark, d):
    """Conversations as candidates; some have redundant blocks, and repairs, of which half are accepted."""
    i = C("conv_id")
    conv = read(spark, d, "conversations").select("conv_id").distinct()
    candidates = conv.select("conv_id", (i % 5 != 0).alias("eligible"), F.when(i % 7 == 0, "incomplete").otherwise("complete").alias("status"), F.when(i % 3 == 0, 1).otherwise(0).alias("n_blocks"))
    repairs = conv.select("conv_id", F.concat(F.lit("repair_"), i.cast("string")).alias("repair_id"))
    reviews = repairs.select("repair_id", chosen(F.floor(i / 3), "accepted", "rejected").alias("decision"))
    return selections(candidates, usable_repairs(repairs, reviews, repairs.select("repair_id"), "conv_id"), "conv_id")


def example_selections(spark, d):
    return _selected(spark, d).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.count("repair_id").alias("n_repairs"), F.min("conv_id").alias("first_id"))


def training_examples(spark, d):
    """Conversations up to turn 1 or 3; repairs drop turn 0."""
    i = C("conv_id")
    m = read(spark, d, "conversations").select("conv_id", C("turn").alias("ordinal"), "role", "text")
    s = _selected(spark, d)
    dropped = s.where("repair_id is not null").select("repair_id", F.lit(0).cast("long").alias("ordinal"))
    reviews = m.select("conv_id").distinct().select("conv_id", F.when(i % 4 == 0, "pending").otherwise("accepted").alias("decision"), F.when(i % 2 == 0, 1).otherwise(3).alias("boundary"))
    return examples(s, m, dropped, reviews, "conv_id")


QUERIES = {f.__name__: f for f in (replay_matches, replay_rate, audit_comparisons, control_matches, call_links, split_lock, task_owners, extra_files, turn_differences, page_roots, example_selections, training_examples)}

_M = """s AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS x FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2), t AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN -1 ELSE max(l_partkey) END AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
  m AS (SELECT l_orderkey, l_linenumber, coalesce(x = y, false) AS same FROM s FULL JOIN t USING (l_orderkey, l_linenumber)),
  g AS (SELECT l_orderkey, string_agg(l_linenumber || '=' || same, ',' ORDER BY l_linenumber) AS matches, count(*) AS n, count_if(same)::BIGINT AS n_matched, bool_and(same) AS matched FROM m GROUP BY 1)"""
_S = """c AS (SELECT DISTINCT conv_id AS i FROM conversations), f AS (SELECT i AS conv_id, CASE WHEN i % 5 = 0 THEN 'ineligible' WHEN i % 7 = 0 THEN 'incomplete' WHEN i % 3 <> 0 THEN 'original' WHEN i // 3 % 2 = 0 THEN 'repaired' ELSE 'needs repair' END AS fate FROM c)"""
SQL = {
    "replay_matches": f"WITH {_M} SELECT * FROM g",
    "replay_rate": f"""WITH {_M}, a AS (SELECT count(*) AS n_replays, count_if(matched)::BIGINT AS n_equal, sum(n_matched)::BIGINT AS n_matched, sum(n)::BIGINT AS n_artifacts FROM g)
        SELECT *, n_matched || '/' || n_artifacts || ' (' || round(100 * n_matched::DECIMAL(18,0) / n_artifacts, 1)::DECIMAL(10,1) || '%)' AS match_rate, n_equal || '/' || n_replays || ' (' || round(100 * n_equal::DECIMAL(18,0) / n_replays, 1)::DECIMAL(10,1) || '%)' AS equal_rate FROM a""",
    "audit_comparisons": f"""WITH {_A}, x AS (SELECT 'agent' AS field, 'scored' AS expected, agent AS actual FROM b WHERE id % 2 = 0 UNION ALL SELECT 'loop', 'completed', loop FROM b WHERE id % 3 = 0 UNION ALL SELECT 'attempt', CASE WHEN id % 2 = 0 THEN 'PASS' ELSE 'TIMEOUT' END, attempt FROM b)
        SELECT field, expected, expected IS NOT DISTINCT FROM actual AS matched, count(*) AS n, count(actual) AS n_known FROM x GROUP BY ALL""",
    "control_matches": "SELECT conv_id, (conv_id % 3 = 0 OR conv_id // 2 % 2 = 0) AND (conv_id % 4 = 0 OR string_agg(role, ',' ORDER BY turn) = 'user,assistant') AS matched FROM conversations GROUP BY conv_id",
    "call_links": """WITH x AS (SELECT conv_id, turn AS id, 1 AS a, 0 AS b FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn - 1, 0, 1 FROM conversations WHERE role = 'user' AND turn > 0), y AS (SELECT conv_id, id, sum(a) <> sum(b) AS odd FROM x GROUP BY 1, 2)
        SELECT conv_id, count(*) AS n_ids, count_if(odd)::BIGINT AS n_unlinked FROM y GROUP BY conv_id""",
    "split_lock": """WITH l AS (SELECT doc_id, lang AS s FROM documents UNION ALL SELECT doc_id, 'heldout' FROM documents WHERE source = 'src0'), k AS (SELECT doc_id, count(*) AS n, min(s) AS s FROM l GROUP BY 1), m AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'en' ELSE 'de' END AS s FROM labels),
        p AS (SELECT doc_id, 'twice' AS problem FROM k WHERE n > 1 UNION ALL SELECT doc_id, 'unlocked' FROM m WHERE doc_id NOT IN (SELECT doc_id FROM k) UNION ALL SELECT doc_id, 'unknown' FROM k WHERE n = 1 AND doc_id NOT IN (SELECT doc_id FROM m)
          UNION ALL SELECT k.doc_id, 'mismatch' FROM k JOIN m ON k.doc_id = m.doc_id AND n = 1 AND k.s IS DISTINCT FROM m.s)
        SELECT problem, count(*) AS n, min(doc_id) AS first_id FROM p GROUP BY problem""",
    "task_owners": "SELECT concat_ws('/', p_name, p_brand, p_size) AS task, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part GROUP BY 1",
    "extra_files": """WITH p AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://', '') AS path, url LIKE 'https%' AS safe FROM pages), r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p WHERE safe UNION SELECT path FROM p WHERE NOT safe AND path LIKE '%/en/%'),
        q AS (SELECT DISTINCT path FROM p) SELECT page_id, path FROM p WHERE path NOT IN (SELECT path FROM q, r WHERE path = root OR starts_with(path, root || '/'))""",
    "turn_differences": """WITH j AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
        SELECT conv_id, turn, CASE WHEN x <> y THEN coalesce(list_position(list_transform(range(least(length(x), length(y))), lambda i: x[i + 1] <> y[i + 1]), true) - 1, least(length(x), length(y))) END::BIGINT AS place, length(x)::BIGINT AS length, true AS same FROM j""",
    "page_roots": "SELECT page_id, 'at <run>/' || page_id || ', <tmp>, <tmp>/runner, <run> and x/tmp/run in <tmp>/run.py, <tmp>.' AS line FROM pages",
    "example_selections": f"WITH {_S} SELECT fate, count(*) AS n, count_if(fate = 'repaired')::BIGINT AS n_repairs, min(conv_id) AS first_id FROM f GROUP BY fate",
    "training_examples": f"""WITH {_S}, k AS (SELECT m.conv_id, m.turn, m.role, m.text, f.fate, CASE WHEN m.conv_id % 2 = 0 THEN 1 ELSE 3 END AS stop FROM conversations m JOIN f USING (conv_id) WHERE fate IN ('original', 'repaired') AND m.conv_id % 4 <> 0)
        SELECT conv_id, fate, count(*) AS n_messages, md5(string_agg(role || chr(31) || md5(coalesce(text, '')), chr(10) ORDER BY turn)) AS messages_hash FROM k WHERE turn <= stop AND NOT (fate = 'repaired' AND turn = 0)
        GROUP BY ALL HAVING count_if(turn = stop) = 1 AND max(CASE WHEN turn = stop THEN role END) = 'assistant'""",
}
