"""Work that grows with the tables: what is computed, exchanged or held for each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import jsontext
from millrace.operators import lineage, linkage
from millrace.plans import orders, scans
from millrace.sources.typed import rejected, scan


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def of(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_shallow_members_are_not_folded(spark, monkeypatch):
    texts = ['{"b": [1.0, {"t": {"v": [1e400]}, "a": "x"}], "t": "}"}', '{"t": 1, "b": "\\" ,\\"t\\":1"}', '"x"', "[1", None]
    monkeypatch.setattr(jsontext, "_folded", lambda *_: F.raise_error(F.lit("folded")).cast("string"))
    # What is no JSON is not folded either.
    upper = lambda x: F.upper(x)
    assert of(spark, texts, lambda t: jsontext.normalized_json(t, dropped=["t"], rule=upper)) == ['{"b":[1.0,{"a":"X"}]}', '{"b":"\\" ,\\"T\\":1"}', '"X"', None, None]
    assert of(spark, texts, lambda t: jsontext.normalized_json(t, replaced={"t": "<\"T\">"}, rule=upper)) == ['{"b":[1.0,{"a":"X","t":"<\\"T\\">"}],"t":"<\\"T\\">"}', '{"b":"\\" ,\\"T\\":1","t":"<\\"T\\">"}', '"X"', None, None]


def test_deep_members_and_texts_with_the_mark_are_right(spark):
    deep = "[" * 20 + "2.50" + "]" * 20
    texts = ['{"a": 1, "t": ' + deep + ', "z": {"t": ' + deep + "}}", '{"a": "⁣", "t": 1.0}', '{"a": "\\u2063", "t": 1.0, "n": 1.0}']
    assert of(spark, texts, lambda t: jsontext.normalized_json(t, dropped=["t"])) == ['{"a":1,"z":{}}', '{"a":"⁣"}', '{"a":"⁣","n":1.0}']
    assert of(spark, texts, lambda t: jsontext.normalized_json(t, replaced={"t": "x"}))[0] == '{"a":1,"t":"x","z":{"t":"x"}}'
    assert of(spark, texts, jsontext.exact_json)[1:] == ['{"a":"⁣","t":1.0}', '{"a":"⁣","n":1.0,"t":1.0}']


def test_lines_of_orders_are_exchanged_as_columns(spark, small):
    exchanged = [x for x in plan(scans._order_records(spark, small)).splitlines() if "ObjectHashAggregate" in x and "partial_collect_list" in x]
    assert exchanged and all("duration_ms" not in x for x in exchanged)


def test_depth_is_counted_in_one_number(spark):
    texts = ["1", "[]", '{"a":[{}],"b":{"c":[["["]]}}', '"[["', "[[],[[]]]", "[" * 300 + "]" * 300, "]]][[", '["'  + "x" * 9, None]
    assert of(spark, texts, jsontext.nesting) == [0, 1, 4, 0, 3, 300, 0, 1, None]
    assert "named_struct" not in plan(spark.createDataFrame([("[]",)], "t string").select(jsontext.nesting(F.col("t"))))


def test_tasks_of_pairs_go_by_the_lines(spark, small, monkeypatch):
    """Shuffle partitions are 4: with 1,000 lines a task there are as many tasks as thousands of lines."""
    whole = sorted(map(tuple, orders.pair_sources(spark, small).collect()))
    monkeypatch.setattr(orders, "LINES_A_TASK", 1000, raising=False)
    n = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 1000)
    found = orders.pair_sources(spark, small)
    assert n > 4 and plan(found).count(f"hashpartitioning(l_orderkey") == 1 and f", {n}), REPARTITION_BY_NUM" in plan(found)
    assert sorted(map(tuple, found.collect())) == whole


def test_a_scan_parses_each_line_once_whatever_is_asked(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"o_orderkey": 1}\n\n[1]\n{"o_orderkey": 2, "o_custkey": null}\n')
    found = rejected(scan(spark, str(tmp_path), scans.FIELDS))
    assert [(r["line"], r["reason"]) for r in found.orderBy("line").collect()] == [(1, "o_custkey: missing"), (3, "no object"), (4, "o_custkey: null")]
    # The reason is made in one step of the plan, and a filter does not make it again.
    assert sum("o_custkey: missing" in x for x in plan(found.select("reason")).splitlines()) == 1


def test_links_deal_rows_by_group_alone(spark, small):
    """Each of calls, messages and results is exchanged, and nothing is exchanged by id or by place."""
    exchanged = [x for x in plan(scans.order_links(spark, small)).splitlines() if "Exchange hashpartitioning" in x]
    assert exchanged and all(x.split("hashpartitioning(")[1].split(",")[0].startswith("l_orderkey") for x in exchanged)
    assert all(", id#" not in x and ", ordinal#" not in x and "_id#" not in x for x in exchanged)


def test_links_of_no_group_are_not_paired(spark):
    calls = spark.createDataFrame([(None, "a", 0, True, "x", 1), (1, "a", 0, True, "x", 1)], "g long, id string, at long, is_tool boolean, name string, arguments int")
    messages = spark.createDataFrame([(None, 0, "a", 1, "x", 5), (1, 0, "a", 1, "x", 5)], "g long, ordinal long, id string, at long, name string, content int")
    results = spark.createDataFrame([(None, 0, "a", "x", 5, 1), (1, 0, "a", "x", 5, 1)], "g long, ordinal long, id string, name string, content int, arguments int")
    found = linkage.linked_calls(calls, messages, results, "g").collect()
    assert sorted((r["g"] or 0, r["ordinal"], r["id"], r["problem"] or "") for r in found) == [(0, 0, "a", "no call"), (0, 0, "a", "result surplus"), (1, 0, "a", "")]


def test_only_buckets_that_differ_are_compared_by_row(spark):
    stored = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") == 7, 1).otherwise(0).alias("v"))
    derived = spark.range(5001).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    digest, buckets = lineage.differing_buckets(stored, derived, ["k"])
    assert digest == lineage.multiset_digest(stored) and 1 <= len(buckets) <= 2
    found = lineage.row_differences(stored, derived, ["k"], buckets)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lineage.row_differences(stored, derived, ["k"]).collect())) == [('["5000"]', "missing"), ('["7"]', "changed")]
    empty = stored.where("k < 0")
    assert lineage.differing_buckets(empty, empty, ["k"]) == (lineage.multiset_digest(empty), [])
