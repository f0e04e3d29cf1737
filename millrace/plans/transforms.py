"""Queries for the small text formats, over values made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import tasks
from ..operators.stages import fresh_folder
from ..sources.delimited import scan_delimited
from .reviews import read


def chosen(number, *texts):
    """One of the texts, by a number modulo how many there are."""
    return F.element_at(F.array(*(F.lit(t) for t in texts)), (F.pmod(number, F.lit(len(texts))) + 1).cast("int"))


def durations(spark, d):
    k = F.col("p_partkey")
    text = F.concat((k % 50).cast("string"), F.when(k % 3 == 0, ".5").otherwise(""), chosen(k, "ms", "s", "m", "h", "d", ""))
    return read(spark, d, "part").select("p_partkey", F.round(values.duration_seconds(text), 6).alias("seconds"))


def pointed_values(spark, d):
    c = read(spark, d, "customer")
    document = F.to_json(F.struct(F.struct(F.col("c_name").alias("a/b"), F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long")).alias("list")).alias("m~n"), F.col("c_mktsegment").alias("plain")))
    pointer = chosen(F.col("c_custkey"), "/m~0n/a~1b", "/m~0n/list/1", "/plain", "/nowhere", "/m~0n/list/7")
    return c.select("c_custkey", values.pointed(document, pointer).alias("value"))


def query_strings(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", values.query_text(F.create_map(F.lit("z y"), F.col("p_name"), F.lit("a*~"), F.col("p_brand"), F.lit("m"), F.concat(F.lit("é&="), F.col("p_size").cast("string")))).alias("query"))


def relative_paths(spark, d):
    k = F.col("o_orderkey")
    path = F.concat_ws("/", chosen(k, "a", ".", "b", "..", ""), chosen(k / 5, "c", "..", "d", "."), chosen(k / 20, "..", "e", ""), chosen(k / 60, "f", "..", "..", "g"))
    o = read(spark, d, "orders").select(values.relative_path(path).alias("path"))
    return o.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def expanded_templates(spark, d):
    s = read(spark, d, "supplier")
    template = chosen(F.col("s_suppkey"), "${name} owes $$${owed}", "$${name} is ${name}", "no names $", "${missing}!", "${owed}${name}")
    known = F.create_map(F.lit("name"), F.concat(F.col("s_name"), F.lit("${owed}")), F.lit("owed"), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", values.expanded(template, known).alias("text"))


def env_assignments(spark, d):
    k = F.col("s_suppkey")
    lines = [F.lit("# settings"), F.concat(F.lit("NAME=\""), F.col("s_name"), F.lit(" \\\"x\\\"\"")), F.lit(""), F.concat(F.lit("  KEY_"), (k % 3).cast("string"), F.lit("="), k.cast("string")), chosen(k, "LAST=", "KEY_1=again", "broken", "OTHER=two words", "Z=1")]
    found = read(spark, d, "supplier").select("s_suppkey", values.assignments(F.concat_ws("\n", *lines)).alias("pairs"))
    return found.select("s_suppkey", F.array_join(F.transform("pairs", lambda p: F.concat(p["key"], F.lit(":"), p["value"])), ",").alias("pairs"))


def header_merges(spark, d):
    c = read(spark, d, "customer")
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    defaults = F.array(pair(F.lit("Accept"), F.lit("*/*")), pair(F.lit("Host"), F.col("c_mktsegment")))
    overrides = F.array(pair(chosen(F.col("c_custkey"), "host", "ACCEPT", "X-Other"), F.col("c_name")), pair(F.lit("Last"), F.lit("1")))
    merged = values.merged_headers(defaults, overrides)
    return c.select("c_custkey", F.array_join(F.transform(merged, lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("headers"))


def order_ratios(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(20,2)")).alias("q"), F.count(F.lit(1)).alias("n"))
    return li.select("l_orderkey", F.round(values.ratio(F.col("q"), F.col("n")), 6).alias("ratio"))


def csv_projection(spark, d):
    """Two columns of a CSV line, in the order asked for."""
    schema = "key bigint, name string, price double"
    line = F.to_csv(F.struct("p_partkey", F.concat(F.lit('say "'), F.col("p_name"), F.lit('", ok')).alias("name"), F.col("p_size").alias("price")))
    row = F.from_csv(line, F.lit(schema), {"mode": "FAILFAST"})
    return read(spark, d, "part").select(row.alias("r")).select(F.col("r.name").alias("name"), F.col("r.key").alias("key"))


def json_status_counts(spark, d):
    """Counts by status over JSON lines with ids that are there once; lines that are no record of (id, status) count as `invalid`."""
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(k.cast("string").alias("id"), F.when(k % 10 != 4, F.col("o_orderstatus")).alias("status"))))
    rows = read(spark, d, "orders").select(F.from_json(line, "id string, status string").alias("r"))
    return rows.groupBy(F.coalesce("r.status", F.lit("invalid")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r.id").alias("n_ids"))


def utf8_batch_sizes(spark, d):
    """The turns of each conversation in batches of three turns and 600 bytes; longer turns are cut first."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 150).alias("t"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("turns"))
    numbers = g.select("conv_id", F.posexplode(values.utf8_batches(F.transform("turns", lambda x: x["t"]), 3, 600)).alias("pos", "batch"))
    return numbers.groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def stable_orders(spark, d):
    """For each nation a small graph of the same shape but for one edge that some have."""
    n = read(spark, d, "nation")
    node = lambda x: F.lit(x)
    edge = lambda a, b: F.struct(node(a).alias("node"), node(b).alias("needed"))
    more = F.when(F.col("n_nationkey") % 3 == 0, F.array(edge("b", "d"))).when(F.col("n_nationkey") % 3 == 1, F.array(edge("d", "a"))).otherwise(F.array().cast("array<struct<node:string,needed:string>>"))
    return n.select("n_nationkey", F.array_join(values.stable_order(F.array(*map(node, "abcde")), F.concat(F.array(edge("a", "c"), edge("e", "a"), edge("c", "d")), more)), "").alias("order"))


def delimited_parts(spark, d):
    """Parts as CSV in files of 500, with names in quotes; rows of size 1 lack a field, those of size 2 have an open quote."""
    quoted = F.concat(F.lit('"say ""'), "p_name", F.lit('"", ok"'))
    line = F.concat(F.when(F.col("p_size") == 2, F.concat(F.lit('"'), "p_name")).otherwise(quoted), F.when(F.col("p_size") == 1, "").otherwise(F.concat(F.lit(","), F.col("p_size").cast("string"))), F.lit(","), F.col("p_partkey").cast("string"))
    files = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 500).alias("part"), F.col("p_partkey").alias("k"), line.alias("value"))
    head = files.groupBy("part").agg(F.lit(-1).cast(files.schema["k"].dataType).alias("k"), F.max(F.when(F.col("part") == 1, "name,size,size").otherwise("name,size,key")).alias("value"))
    path = fresh_folder(spark, "parts")
    files.unionByName(head).repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(path)
    rows = scan_delimited(spark, path, ["key", "name"])
    return rows.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", "reason", "key", "name")


def latest_pages(spark, d):
    """Of the pages of a host the one with the greatest number, hosts in the order of their first address."""
    pages = read(spark, d, "pages").select("page_id", "url", F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return tasks.latest_versions(pages, "host", "page_id", ["url", "page_id"]).select("host", "page_id", "place")


def unique_status_counts(spark, d):
    return tasks.counts_by_status(read(spark, d, "orders"), "o_orderkey", "o_orderstatus")


QUERIES = {f.__name__: f for f in (durations, pointed_values, query_strings, relative_paths, expanded_templates, env_assignments, header_merges, order_ratios, csv_projection, json_status_counts, utf8_batch_sizes, stable_orders, delimited_parts, latest_pages, unique_status_counts)}

SQL = {
    "durations": """SELECT p_partkey, round(((p_partkey % 50) + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0 END)::DOUBLE * [0.001, 1, 60, 3600, NULL, NULL][(p_partkey % 6)::INT + 1]::DOUBLE, 6) AS seconds FROM part""",
    "pointed_values": "SELECT c_custkey, [c_name, c_nationkey::VARCHAR, c_mktsegment, NULL, NULL][(c_custkey % 5)::INT + 1] AS value FROM customer",
    "query_strings": "SELECT p_partkey, 'a%2A~=' || url_encode(p_brand) || '&m=%C3%A9%26%3D' || p_size || '&z%20y=' || url_encode(p_name) AS query FROM part",
    "relative_paths": """WITH p AS (SELECT [['a', '.', 'b', '..', ''][(o_orderkey % 5)::INT + 1], ['c', '..', 'd', '.'][(o_orderkey // 5 % 4)::INT + 1], ['..', 'e', ''][(o_orderkey // 20 % 3)::INT + 1], ['f', '..', '..', 'g'][(o_orderkey // 60 % 4)::INT + 1]] AS s FROM orders),
        r AS (SELECT s[1] = '' AS absolute, list_reduce(list_prepend('', list_filter(s, lambda x: x NOT IN ('', '.'))), lambda a, x: CASE WHEN a LIKE '!%' THEN a WHEN x <> '..' THEN a || '/' || x WHEN a = '' THEN '!' ELSE regexp_replace(a, '/[^/]*$', '') END) AS t FROM p)
        SELECT CASE WHEN absolute OR t LIKE '!%' THEN NULL WHEN t = '' THEN '.' ELSE substr(t, 2) END AS path, count(*) AS n FROM r GROUP BY 1""",
    "expanded_templates": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name || '${owed} owes $' || s_nationkey WHEN 1 THEN '${name} is ' || s_name || '${owed}' WHEN 2 THEN 'no names $' WHEN 3 THEN NULL ELSE s_nationkey || s_name || '${owed}' END AS text FROM supplier""",
    "env_assignments": """SELECT s_suppkey, CASE WHEN s_suppkey % 5 IN (2, 3) OR (s_suppkey % 5 = 1 AND s_suppkey % 3 = 1) THEN NULL
          ELSE 'NAME:' || s_name || ' "x",KEY_' || (s_suppkey % 3) || ':' || s_suppkey || ',' || CASE s_suppkey % 5 WHEN 0 THEN 'LAST:' WHEN 1 THEN 'KEY_1:again' ELSE 'Z:1' END END AS pairs FROM supplier""",
    "header_merges": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Accept=*/*;host=' || c_name WHEN 1 THEN 'ACCEPT=' || c_name || ';Host=' || c_mktsegment ELSE 'Accept=*/*;Host=' || c_mktsegment || ';X-Other=' || c_name END || ';Last=1' AS headers FROM customer""",
    "order_ratios": "SELECT l_orderkey, round(sum(l_quantity) / count(*), 6) AS ratio FROM lineitem GROUP BY l_orderkey",
    "csv_projection": "SELECT 'say \"' || p_name || '\", ok' AS name, p_partkey AS key FROM part",
    "json_status_counts": "SELECT CASE WHEN o_orderkey % 10 IN (3, 4) THEN 'invalid' ELSE o_orderstatus END AS status, count(*) AS n, count(DISTINCT CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey END) AS n_ids FROM orders GROUP BY 1",
    "utf8_batch_sizes": """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, octet_length(encode(substr(text, 1, 150))) AS b FROM conversations),
        w AS (SELECT conv_id, pos, 0 AS batch, 1 AS k, b AS held FROM t WHERE pos = 0
          UNION ALL SELECT t.conv_id, t.pos, CASE WHEN w.k < 3 AND w.held + t.b <= 600 THEN w.batch ELSE w.batch + 1 END, CASE WHEN w.k < 3 AND w.held + t.b <= 600 THEN w.k + 1 ELSE 1 END, CASE WHEN w.k < 3 AND w.held + t.b <= 600 THEN w.held + t.b ELSE t.b END
          FROM w JOIN t ON t.conv_id = w.conv_id AND t.pos = w.pos + 1)
        SELECT conv_id, batch::INT AS batch, count(*) AS n, min(pos)::INT AS first FROM w GROUP BY conv_id, batch""",
    "stable_orders": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'dbcae' WHEN 1 THEN NULL ELSE 'bdcae' END AS \"order\" FROM nation",
    "delimited_parts": """WITH r AS (SELECT p_partkey // 500 AS part, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 1 AS line, * FROM part),
        w AS (SELECT *, CASE WHEN part = 1 THEN 'header: twice size' WHEN p_size = 2 THEN 'open quote' WHEN p_size = 1 THEN '2 fields of 3' END AS reason FROM r)
        SELECT part, line, reason, CASE WHEN reason IS NULL THEN p_partkey::VARCHAR END AS key, CASE WHEN reason IS NULL THEN 'say "' || p_name || '", ok' END AS name FROM w""",
    "latest_pages": """WITH p AS (SELECT page_id, url, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages), f AS (SELECT host, max(page_id) AS page_id, min((url, page_id)) AS f FROM p GROUP BY host)
        SELECT host, page_id, row_number() OVER (ORDER BY f) - 1 AS place FROM f""",
    "unique_status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
}
