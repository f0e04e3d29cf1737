"""Queries over directory trees and tables in one order, made from customer, nation and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import includes as included
from ..operators import trees
from ..operators.stages import fresh_folder
from .reviews import read

C = F.col


def _written(spark, d) -> str:
    """Names of customers as lines of a file for each region, nation and segment."""
    folder = fresh_folder(spark, "tree")
    nations = read(spark, d, "nation").select(C("n_nationkey").alias("c_nationkey"), C("n_regionkey").alias("region"))
    rows = read(spark, d, "customer").join(nations, "c_nationkey").select("region", C("c_nationkey").alias("nation"), C("c_mktsegment").alias("segment"), "c_custkey", C("c_name").alias("value"))
    keys = ["region", "nation", "segment"]
    rows.repartition(*keys).sortWithinPartitions(*keys, "c_custkey").select(*keys, "value").write.partitionBy(*keys).text(folder)
    return folder


def _files(spark, d):
    """Files under the names of their folders, as Spark gives its files names of its own."""
    files, _ = trees.listed(spark, _written(spark, d), depth=9, most=1_000_000)
    return files.select(F.regexp_replace("path", "/[^/]*$", "/names.txt").alias("path"), "size", "content_md5")


def tree_digests(spark, d):
    return trees.folder_digests(_files(spark, d))


def tree_changes(spark, d):
    """One file has other content, and one is gone."""
    files = _files(spark, d)
    ends = files.agg(F.min("path").alias("first"), F.max("path").alias("last"))
    after = files.join(F.broadcast(ends)).where("path <> last").withColumn("content_md5", F.when(C("path") == C("first"), F.md5("content_md5")).otherwise(C("content_md5")))
    whole = lambda f: trees.folder_digests(f).select("path", "digest").unionByName(f.select("path", C("content_md5").alias("digest")))
    return trees.tree_changes(whole(files), whole(after))


def bounded_tree(spark, d):
    """The first 40 files, at two bounds of depth: which are listed, and whether there are more."""
    folder = _written(spark, d)
    out = None
    for depth in (3, 4):
        files, counted = trees.listed(spark, folder, depth=depth, most=40)
        files = files.agg(F.count(F.lit(1)).alias("n_listed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(F.regexp_replace("path", "/[^/]*$", "")).alias("last"))
        row = files.crossJoin(counted.select("truncated")).select(F.lit(depth).alias("depth"), "*")
        out = row if out is None else out.unionByName(row)
    return out


ORDER = ["o_totalprice", "o_orderkey"]


def zipped_orders(spark, d):
    """Orders by price against those that are not of the dearest sixth of customers' keys, place by place."""
    o = read(spark, d, "orders")
    most = o.agg(F.max("o_custkey").alias("m"))
    other = o.join(F.broadcast(most)).where("o_custkey * 6 < m * 5 or o_totalprice < 20000").drop("m")
    return trees.zipped(o, other, ORDER, ["o_orderkey"])


def first_zip_mismatch(spark, d):
    return trees.first_mismatch(zipped_orders(spark, d))


def included_settings(spark, d):
    """Customers as documents in folders of their nations. Very dear orders in progress say what a customer includes: another one with a
    higher number, or of the highest priority any; some say what is outside, or not there."""
    c = read(spark, d, "customer")
    path = F.concat(F.lit("n"), C("c_nationkey").cast("string"), F.lit("/c"), C("c_custkey").cast("string"))
    documents = c.select(path.alias("path"), "c_custkey", "c_acctbal", "c_name", "c_mktsegment")
    n = c.agg(F.max("c_custkey").alias("m"))
    o = read(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 470000").join(F.broadcast(n)).withColumn("other", C("o_orderkey") * 7 % (C("m") + 1))
    o = o.where("other > o_custkey or o_orderpriority like '1%' and other <> o_custkey").join(documents.select(C("c_custkey").alias("other"), C("path").alias("to")), "other")
    target = F.when(C("o_totalprice") > 499_000, F.concat(F.lit("../../"), "to")).when(C("o_totalprice") > 497_000, F.concat(F.lit("../x/"), "to")).otherwise(F.concat(F.lit(".././"), "to"))
    listed = o.join(documents.select(C("c_custkey").alias("o_custkey"), "path"), "o_custkey").select("path", C("o_orderkey").alias("ordinal"), target.alias("target"))
    text = lambda c: C(c).cast("string")
    fields = documents.select("path", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("name", F.when(C("c_acctbal") > 8000, text("c_name"))), ("segment", F.when(C("c_acctbal") < 5000, text("c_mktsegment"))), ("key", F.when(C("c_custkey") % 2 == 0, text("c_custkey"))))))))
    defaults = spark.createDataFrame([("name", "nobody"), ("limit", "10")], "field string, value string")
    return included.merged(documents.select(C("path").alias("entry")), documents.select("path"), listed, fields, defaults)


QUERIES = {f.__name__: f for f in (tree_digests, tree_changes, bounded_tree, zipped_orders, first_zip_mismatch, included_settings)}

_H = "md5({} || ' ' || {} || ' ' || {})"


def _level(parent, name, kind, source, digest="digest"):
    h = f"md5('{kind} ' || {name} || ' ' || {digest})"
    half = lambda at: f"sum(('0x' || substr({h}, {at}, 15))::UBIGINT)::HUGEINT"
    return f"SELECT {parent} AS path, md5(count(*) || ':' || {half(1)} || ':' || {half(16)}) AS digest, sum(n_files)::BIGINT AS n_files FROM {source} GROUP BY {parent}"


_F = "f AS (SELECT 'region=' || n_regionkey || '/nation=' || c_nationkey || '/segment=' || c_mktsegment AS folder, md5(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS digest, sum(length(c_name) + 1)::BIGINT AS bytes, 1 AS n_files FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)"


def _tree(files, p):
    up = "regexp_replace(path, '/?[^/]*$', '')"
    name = "regexp_extract(path, '([^/]*)$', 1)"
    return f"{p}4 AS ({_level('folder', chr(39) + 'names.txt' + chr(39), 'file', files)}), {p}3 AS ({_level(up, name, 'folder', p + '4')}), {p}2 AS ({_level(up, name, 'folder', p + '3')}), {p}1 AS ({_level(up, name, 'folder', p + '2')}), {p} AS (SELECT * FROM {p}1 UNION ALL SELECT * FROM {p}2 UNION ALL SELECT * FROM {p}3 UNION ALL SELECT * FROM {p}4)"


_Z = """m AS (SELECT max(o_custkey) AS m FROM orders), l AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS "at", o_orderkey FROM orders), r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS "at", o_orderkey FROM orders, m WHERE o_custkey * 6 < m * 5 OR o_totalprice < 20000),
    z AS (SELECT "at", l.o_orderkey AS o_orderkey_left, r.o_orderkey AS o_orderkey_right, CASE WHEN r."at" IS NULL THEN 'left' ELSE 'both' END AS side, coalesce(l.o_orderkey = r.o_orderkey, false) AS same FROM l LEFT JOIN r USING ("at"))"""
SQL = {
    "tree_digests": f"WITH {_F}, {_tree('f', 't')} SELECT * FROM t",
    "tree_changes": f"""WITH {_F}, g AS (SELECT folder, CASE WHEN folder = (SELECT min(folder) FROM f) THEN md5(digest) ELSE digest END AS digest, n_files FROM f WHERE folder <> (SELECT max(folder) FROM f)), {_tree('f', 't')}, {_tree('g', 'u')},
        b AS (SELECT path, digest FROM t UNION ALL SELECT folder || '/names.txt', digest FROM f), a AS (SELECT path, digest FROM u UNION ALL SELECT folder || '/names.txt', digest FROM g)
        SELECT path, CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE a.digest IS DISTINCT FROM b.digest""",
    "bounded_tree": f"""WITH {_F} SELECT 3 AS depth, 0 AS n_listed, 0 AS bytes, NULL AS last, false AS truncated
        UNION ALL SELECT 4, count(*) FILTER (r <= 40), coalesce(sum(bytes) FILTER (r <= 40), 0)::BIGINT, max(folder) FILTER (r <= 40), count(*) > 40 FROM (SELECT *, row_number() OVER (ORDER BY folder) AS r FROM f)""",
    "zipped_orders": f"WITH {_Z} SELECT * FROM z",
    "first_zip_mismatch": f"WITH {_Z} SELECT * FROM z WHERE NOT same ORDER BY \"at\" LIMIT 1",
    "included_settings": """WITH RECURSIVE d AS (SELECT 'n' || c_nationkey || '/c' || c_custkey AS path, * FROM customer), m AS (SELECT max(c_custkey) AS m FROM customer),
        o AS (SELECT *, o_orderkey * 7 % (m + 1) AS other FROM orders, m WHERE o_orderstatus = 'P' AND o_totalprice > 470000),
        e AS (SELECT a.path, o_orderkey AS ordinal, b.path AS target, CASE WHEN o_totalprice > 499000 THEN a.path || ' includes what is outside: ../../' || b.path WHEN o_totalprice > 497000 THEN 'no document x/' || b.path END AS bad
            FROM o JOIN d a ON a.c_custkey = o_custkey JOIN d b ON b.c_custkey = other WHERE other > o_custkey OR (o_orderpriority LIKE '1%' AND other <> o_custkey)),
        v AS (SELECT path AS entry, path, []::BIGINT[] AS place, [path] AS trail, NULL::VARCHAR AS error FROM d
            UNION ALL SELECT entry, e.target, list_append(place, ordinal), list_append(trail, e.target), CASE WHEN bad IS NOT NULL THEN bad WHEN list_contains(trail, e.target) THEN 'cycle at ' || e.target END FROM v JOIN e ON e.path = v.path WHERE v.error IS NULL),
        w AS (SELECT entry, min(error) AS error FROM v WHERE error IS NOT NULL GROUP BY entry),
        f AS (SELECT path, unnest(['name', 'segment', 'key']) AS field, unnest([CASE WHEN c_acctbal > 8000 THEN c_name END, CASE WHEN c_acctbal < 5000 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END]) AS value FROM d),
        g AS (SELECT entry, field, arg_max(value, list_append(place, 2147483647)) AS value, arg_max(f.path, list_append(place, 2147483647)) AS path FROM v JOIN f ON f.path = v.path WHERE value IS NOT NULL AND v.error IS NULL AND entry NOT IN (SELECT entry FROM w) GROUP BY entry, field),
        s AS (SELECT d.path AS entry, x.field, x.value FROM d, (VALUES ('name', 'nobody'), ('limit', '10')) x(field, value) WHERE d.path NOT IN (SELECT entry FROM w))
        SELECT entry, NULL AS error, field, coalesce(g.value, s.value) AS value, g.path FROM g FULL JOIN s USING (entry, field) UNION ALL SELECT entry, error, NULL, NULL, NULL FROM w""",
}
