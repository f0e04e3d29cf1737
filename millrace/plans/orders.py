"""Queries over orders, line items and their dimensions: status layers, comparisons, coverage, rules and task transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import scope_matches, version_key
from ..operators import tasks
from ..operators.quality import violations
from ..operators.sequences import contiguous
from ..operators.stages import tasks_for
from ..operators.summaries import count_true, layered_counts, rolled_up
from .reviews import read


def _orders(spark, d):
    return read(spark, d, "orders").withColumn("year", F.year("o_orderdate"))


def layered_status_counts(spark, d):
    return layered_counts(_orders(spark, d), "year", status="o_orderstatus", priority="o_orderpriority")


def layered_status_rollup(spark, d):
    return rolled_up(layered_status_counts(spark, d), "year")


def derived_order_status(spark, d):
    """What the order says against what its lines say; only orders with lines are compared."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    actual = F.when((F.col("lo") == "F") & (F.col("hi") == "F"), "F").when((F.col("lo") == "O") & (F.col("hi") == "O"), "O").otherwise("P")
    j = _orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.withColumn("actual", actual).groupBy("o_orderstatus", "actual").agg(F.count(F.lit(1)).alias("n"), count_true(F.col("o_orderstatus") == F.col("actual")).alias("n_matched"))


LINES_A_TASK = 1_000_000


def pair_sources(spark, d):
    """Five-way join by keys, aggregated to nation and brand."""
    o, c, n = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "nation")
    li, p = read(spark, d, "lineitem"), read(spark, d, "part")
    # An order's lines are counted where they are joined with it, so what a task holds goes by the lines that it is dealt.
    tasks = tasks_for(li, LINES_A_TASK)
    of_order = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "n_name").repartition(tasks, "o_orderkey")
    of_line = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_extendedprice", "p_brand").repartition(tasks, "l_orderkey")
    j = of_line.join(of_order, of_line.l_orderkey == of_order.o_orderkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    return j.groupBy("n_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_orders"), F.sum(cents).cast("decimal(38,0)").alias("cents"))


def line_coverage(spark, d):
    return contiguous(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 1)


def policy_summary(spark, d):
    j = _orders(spark, d)
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), count_true(F.col("o_orderstatus") == "F").alias("n_final"), count_true(F.col("o_totalprice") > 200000).alias("n_large"), F.countDistinct("o_custkey").alias("n_customers"), F.greatest(F.lit(5000) - F.count(F.lit(1)), F.lit(0)).cast("long").alias("n_missing"))


def first_completed(spark, d):
    """The first 100 completed orders in key order: the limit is what is asked for."""
    return read(spark, d, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey")


def bounded_listing(spark, d):
    """Each customer's first five orders, and whether there were more: six rows of each are read at most."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = read(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 6")
    keys = F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.col("o_orderkey"))))
    return first.groupBy("o_custkey").agg(F.array_join(keys.cast("array<string>"), ",").alias("listed"), (F.max("place") > 5).alias("truncated"))


def key_set_operations(spark, d):
    c, o = read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    idle, both, either = c.join(o, "k", "left_anti"), c.intersect(o), c.union(o).distinct()
    return idle.withColumn("part", F.lit("idle")).union(both.withColumn("part", F.lit("both"))).union(either.withColumn("part", F.lit("either"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("key_sum"))


def order_violations(spark, d):
    o = read(spark, d, "orders")
    li = read(spark, d, "lineitem")
    a = violations(o, F.col("o_orderkey"), positive_total=F.col("o_totalprice") > 20000, known_status=F.col("o_orderstatus").isin("F", "O"), has_customer=F.col("o_custkey").isNotNull())
    b = violations(li, F.col("l_orderkey"), small_discount=F.col("l_discount") <= 0.09, status_pair=~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")), quantity_range=F.col("l_quantity").between(1, 49))
    return a.unionByName(b).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"), F.min("key").alias("first_key"))


def signed_rollup(spark, d):
    e = read(spark, d, "events")
    twice = e.unionByName(e.where("event_id % 5 = 0"))
    amount = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value")).otherwise(0.0)
    since = e.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz")).scalar()
    until = e.agg((F.date_trunc("month", F.min("ts")) + F.expr("interval 5 years")).cast("timestamp_ntz")).scalar()
    return tasks.signed_rollup(twice, "user_id", "event_id", "ts", F.round(amount, 2), since, until)


def first_latest_orders(spark, d):
    o = read(spark, d, "orders")
    first = tasks.pick(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = tasks.pick(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("latest_order"))
    return first.join(last, "o_custkey")


def stock_allocation(spark, d):
    stock = read(spark, d, "part").where("p_size <> 1")
    got = tasks.allocation(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", stock, "p_partkey", "p_size")
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_short").cast("long").alias("n_short"))


def place_closure(spark, d):
    r, n, s = read(spark, d, "region"), read(spark, d, "nation"), read(spark, d, "supplier")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = r.select(name("region", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    edges = edges.unionByName(n.select(name("nation", "n_nationkey").alias("child"), name("region", "n_regionkey").alias("parent")))
    edges = edges.unionByName(s.select(name("supplier", "s_suppkey").alias("child"), name("nation", "s_nationkey").alias("parent")))
    return tasks.closure(edges)


def half_even_prices(spark, d):
    """Eleven decimal digits: halves exactly, and just above them."""
    k = F.col("p_partkey").cast("decimal(20,0)")
    units = k * F.when(F.col("p_partkey") % 2 == 0, F.lit(12500000000)).otherwise(F.lit(12500000001)).cast("decimal(12,0)")
    exact = units.cast("decimal(20,0)") * F.lit("0.00000000001").cast("decimal(11,11)")
    return read(spark, d, "part").select("p_partkey", tasks.half_even(exact, 2).cast("decimal(20,2)").alias("rounded"))


def scope_verdicts(spark, d):
    rules = spark.createDataFrame([("allow", "*", "view"), ("allow", "users:1", "*"), ("deny", "users:11", "purchase"), ("deny", "*", "error"), ("allow", "users", "signup")], "effect string, scope string, action string")
    u = F.concat(F.lit("users:"), F.substring(F.col("user_id").cast("string"), 1, 2), F.lit(":"), F.col("user_id").cast("string"))
    e = read(spark, d, "events").select("event_id", u.alias("subject"), "event_type")
    got = tasks.decided(e, rules, scope_matches(F.col("scope"), F.col("subject")) & scope_matches(F.col("action"), F.col("event_type")), "event_id")
    return got.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("long").alias("id_sum"))


def version_order(spark, d):
    k = F.col("p_partkey")
    v = F.concat_ws(".", (k % 3).cast("string"), (k % 12).cast("string"), (k % 30).cast("string"))
    pre = F.element_at(F.array(*(F.lit(x) for x in ("-alpha", "-alpha.2", "-alpha.10", "-beta", "-1", ""))), (k % 6 + 1).cast("int"))
    p = read(spark, d, "part").select("p_brand", F.concat(v, pre).alias("v"))
    return p.groupBy("p_brand").agg(F.max_by("v", version_key(F.col("v"))).alias("newest"), F.min_by("v", version_key(F.col("v"))).alias("oldest"))


def retry_delays(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", F.array_join(tasks.backoff(F.col("s_suppkey") % 5 + 1, 3, 100, 80).cast("array<string>"), ",").alias("delays"))


def layered_settings(spark, d):
    c = read(spark, d, "customer")
    env = F.when(F.col("c_custkey") % 7 == 0, "env")
    file = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    return c.select("c_custkey", tasks.overlaid(env, file, F.lit("default")).alias("setting"))


QUERIES = {f.__name__: f for f in (layered_status_counts, layered_status_rollup, derived_order_status, pair_sources, line_coverage, policy_summary, first_completed, bounded_listing, key_set_operations, order_violations, signed_rollup, first_latest_orders, stock_allocation, place_closure, half_even_prices, scope_verdicts, version_order, retry_delays, layered_settings)}

_LAYERED = """SELECT year(o_orderdate)::INT AS year, u.layer, u.status, count(*) AS n FROM orders, LATERAL (SELECT 'status' AS layer, o_orderstatus AS status UNION ALL SELECT 'priority', o_orderpriority) u
    WHERE u.status IS NOT NULL GROUP BY ALL"""
SQL = {
    "layered_status_counts": _LAYERED,
    "layered_status_rollup": f"SELECT layer, status, sum(n)::BIGINT AS n FROM ({_LAYERED}) GROUP BY ALL",
    "derived_order_status": """WITH l AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS actual FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderstatus, actual, count(*) AS n, count_if(o_orderstatus = actual)::BIGINT AS n_matched FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY ALL""",
    "pair_sources": """SELECT n_name, p_brand, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders, sum(round(l_extendedprice * 100)::DECIMAL(20,0))::DECIMAL(38,0) AS cents
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "line_coverage": "SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS ok FROM lineitem GROUP BY l_orderkey",
    "policy_summary": "SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS n_final, count_if(o_totalprice > 200000)::BIGINT AS n_large, count(DISTINCT o_custkey) AS n_customers, greatest(5000 - count(*), 0) AS n_missing FROM orders GROUP BY ALL",
    "first_completed": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100",
    "bounded_listing": "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS listed, count(*) > 5 AS truncated FROM orders GROUP BY o_custkey",
    "key_set_operations": """WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders), p AS (
          SELECT 'idle' AS part, k FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'both', k FROM c WHERE k IN (SELECT k FROM o) UNION ALL SELECT 'either', k FROM (SELECT k FROM c UNION SELECT k FROM o))
        SELECT part, count(*) AS n, sum(k)::BIGINT AS key_sum FROM p GROUP BY part""",
    "order_violations": """WITH v AS (SELECT 'positive_total' AS rule, o_orderkey AS key FROM orders WHERE NOT coalesce(o_totalprice > 20000, false) UNION ALL SELECT 'known_status', o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)
          UNION ALL SELECT 'has_customer', o_orderkey FROM orders WHERE o_custkey IS NULL UNION ALL SELECT 'small_discount', l_orderkey FROM lineitem WHERE NOT coalesce(l_discount <= 0.09, false)
          UNION ALL SELECT 'status_pair', l_orderkey FROM lineitem WHERE coalesce(l_linestatus = 'O' AND l_returnflag = 'R', true) UNION ALL SELECT 'quantity_range', l_orderkey FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 1 AND 49, false))
        SELECT rule, count(*) AS n, count(DISTINCT key) AS n_keys, min(key) AS first_key FROM v GROUP BY rule""",
    "signed_rollup": """WITH b AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('month', min(ts)) + INTERVAL 5 YEAR AS hi FROM events)
        SELECT user_id, count(*) AS n, sum(CASE event_type WHEN 'purchase' THEN round(value, 2) WHEN 'error' THEN -round(value, 2) ELSE 0 END::DECIMAL(38,2))::DECIMAL(38,2) AS balance FROM events, b WHERE ts >= lo AND ts < hi GROUP BY user_id""",
    "first_latest_orders": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order FROM orders GROUP BY o_custkey",
    "stock_allocation": """WITH n AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS wanted FROM lineitem GROUP BY ALL), j AS (SELECT l_orderkey, count_if(p_partkey IS NULL) AS u, count_if(p_size < wanted) AS s
          FROM n LEFT JOIN (SELECT * FROM part WHERE p_size <> 1) ON l_partkey = p_partkey GROUP BY l_orderkey)
        SELECT CASE WHEN u > 0 THEN 'unknown item' WHEN s > 0 THEN 'shortfall' ELSE 'allocated' END AS status, count(*) AS n, sum(s)::BIGINT AS n_short FROM j GROUP BY 1""",
    "place_closure": """WITH RECURSIVE e AS (SELECT 'region:' || r_regionkey AS child, 'world' AS parent FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
        c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child) SELECT child, ancestor, depth FROM c""",
    "half_even_prices": """WITH v AS (SELECT p_partkey, p_partkey::HUGEINT * CASE WHEN p_partkey % 2 = 0 THEN 12500000000 ELSE 12500000001 END AS u FROM part), q AS (SELECT p_partkey, u // 1000000000 AS q, u % 1000000000 AS r FROM v)
        SELECT p_partkey, ((q + CASE WHEN r > 500000000 OR (r = 500000000 AND q % 2 = 1) THEN 1 ELSE 0 END)::DECIMAL(20,0) * 0.01::DECIMAL(3,2))::DECIMAL(20,2) AS rounded FROM q""",
    "scope_verdicts": """WITH r(effect, scope, action) AS (VALUES ('allow', '*', 'view'), ('allow', 'users:1', '*'), ('deny', 'users:11', 'purchase'), ('deny', '*', 'error'), ('allow', 'users', 'signup')),
        e AS (SELECT event_id, 'users:' || substr(user_id::VARCHAR, 1, 2) || ':' || user_id AS s, event_type AS a FROM events),
        j AS (SELECT event_id, count_if(effect = 'deny') AS d, count_if(effect = 'allow') AS al FROM e LEFT JOIN r ON (scope = '*' OR scope = s OR starts_with(s, scope || ':')) AND (action = '*' OR action = a OR starts_with(a, action || ':')) GROUP BY event_id)
        SELECT CASE WHEN d > 0 THEN 'deny' WHEN al > 0 THEN 'allow' ELSE 'deny' END AS verdict, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM j GROUP BY 1""",
    "version_order": """WITH p AS (SELECT p_brand, (p_partkey % 3) || '.' || (p_partkey % 12) || '.' || (p_partkey % 30) || ['-alpha', '-alpha.2', '-alpha.10', '-beta', '-1', ''][(p_partkey % 6)::INT + 1] AS v,
          (p_partkey % 3) * 1000000 + (p_partkey % 12) * 10000 + (p_partkey % 30) * 100 + [1, 2, 3, 4, 0, 5][(p_partkey % 6)::INT + 1] AS place FROM part) SELECT p_brand, arg_max(v, place) AS newest, arg_min(v, place) AS oldest FROM p GROUP BY p_brand""",
    "retry_delays": "SELECT s_suppkey, array_to_string(list_transform(range(80), lambda i: CASE WHEN i > 5 THEN 100 ELSE least((s_suppkey % 5 + 1) * [1, 3, 9, 27, 81, 243][i + 1], 100) END), ',') AS delays FROM supplier",
    "layered_settings": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'env' END, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, 'default') AS setting FROM customer",
}
