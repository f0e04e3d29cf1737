"""Operators on small rows: nulls, empty tables, ties and repeated rows."""

from __future__ import annotations

import datetime as dt

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import gates, hashing, text
from millrace.operators import coverage, quality, scan, summaries, tasks
from millrace.operators import sequences as seq
from millrace.sources import jsonl


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_reason_keeps_order_and_ignores_null(spark):
    df = frame(spark, [(1, None), (2, True), (3, False)], "k int, p boolean")
    reason = gates.first_reason((F.col("p"), "first"), (F.col("k") > 1, "second"))
    assert rows(df.select("k", reason)) == [(1, None), (2, "first"), (3, "second")]
    assert rows(df.select("k", *gates.eligibility("x", reason)))[0] == (1, True, None)
    assert rows(df.select("k", gates.missing_names(k=F.col("k"), p=F.col("p"))))[0] == (1, "p")


def test_worst_status(spark):
    df = frame(spark, [(1, "PASS"), (1, "FAIL"), (2, "PASS"), (2, "INCONCLUSIVE"), (3, "PASS")], "k int, s string")
    got = df.groupBy("k").agg(gates.worst(F.col("s"), "FAIL", "INCONCLUSIVE", "PASS").alias("w"))
    assert rows(got) == [(1, "FAIL"), (2, "INCONCLUSIVE"), (3, "PASS")]


def test_null_aware_sums(spark):
    df = frame(spark, [("all", 1), ("all", 2), ("one", 1), ("one", None), ("none", None)], "g string, v int")
    got = df.groupBy("g").agg(summaries.sum_or_null(F.col("v")), summaries.sum_known(F.col("v")), summaries.median_int(F.col("v")))
    assert rows(got) == [("all", 3, 3, 1), ("none", None, None, None), ("one", None, 1, 1)]
    assert rows(df.limit(0).agg(summaries.sum_or_null(F.col("v")))) == [(None,)]


def test_zero_filled_and_layers(spark):
    df = frame(spark, [("a", "x", None), ("a", "y", "q"), ("b", None, "q")], "g string, s string, t string")
    assert rows(summaries.zero_filled(df, "g", "s", ["x", "z"])) == [("a", "x", 1), ("a", "z", 0), ("b", "x", 0), ("b", "z", 0)]
    layers = summaries.layered_counts(df, "g", one="s", two="t")
    assert rows(layers) == [("a", "one", "x", 1), ("a", "one", "y", 1), ("a", "two", "q", 1), ("b", "two", "q", 1)]
    assert ("two", "q", 2) in rows(summaries.rolled_up(layers, "g"))


def test_first_seen(spark):
    df = frame(spark, [(1, 3, "c"), (1, 1, "b"), (1, 2, "c"), (1, 4, "b")], "g int, o int, v string")
    assert rows(summaries.first_seen(df, "g", ["o"], "v")) == [(1, ["b", "c"])]


def test_coverage_and_diff(spark):
    left, right = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "k int, v string"), frame(spark, [(2, "b"), (3, None), (4, "d")], "k int, v string")
    assert rows(coverage.coverage(left, right, "k", F.col("l.v") == F.col("r.v"))) == [(1, "missing"), (2, "matched"), (3, "mismatch"), (4, "unknown")]
    assert rows(coverage.outer_diff(left, right, "k", "v")) == [(1, "removed", ""), (2, "unchanged", ""), (3, "changed", "v"), (4, "added", "")]
    assert rows(coverage.duplicate_keys(left.union(left.where("k = 2")), "k")) == [(2, 2)]


def test_islands(spark):
    calls = [(1, i, t) for i, t in enumerate(["a", "a", "a", "b", "a", None, None])]
    df = frame(spark, calls, "g int, o int, t string")
    got = seq.islands(df, "g", ["o"], ["t"]).select("run", "length", "t")
    assert rows(got) == [(1, 3, "a"), (4, 2, None)]


def test_running_state_and_boundary(spark):
    df = frame(spark, [(1, 0, "x", "user"), (1, 1, None, "assistant"), (1, 2, "y", "user"), (2, 0, None, "user")], "g int, o int, v string, role string")
    assert rows(seq.running_state(df, "g", ["o"], F.col("v"), "s").select("g", "o", "s")) == [(1, 0, None), (1, 1, "x"), (1, 2, "x"), (2, 0, None)]
    assert rows(seq.up_to_last(df, "g", "o", F.col("role") == "assistant").select("g", "o")) == [(1, 0), (1, 1)]
    assert rows(seq.contiguous(df, "g", "o", 0)) == [(1, 3, True), (2, 1, True)]
    assert rows(seq.contiguous(df.where("o <> 1"), "g", "o", 0)) == [(1, 2, False), (2, 1, True)]


def test_intervals_touch_but_do_not_join_neighbours(spark):
    df = frame(spark, [(1, 0, 4), (1, 4, 6), (1, 7, 8), (1, 1, 2), (1, 7, 8)], "g int, a int, b int")
    assert rows(seq.merged_intervals(df, "g", "a", "b")) == [(1, 0, 6), (1, 7, 8)]


def test_pairs(spark):
    df = frame(spark, [("c", "x"), ("c", "y"), ("c", "x"), ("c", "z"), ("d", "x")], "c string, a string")
    assert rows(seq.unordered_pairs(df, ["c"], "a")) == [("c", "x", "y"), ("c", "x", "z"), ("c", "y", "z")]


def test_violations_and_strict(spark):
    df = frame(spark, [(1, 5), (2, None), (3, -1)], "k int, v int")
    assert rows(quality.violations(df, F.col("k"), positive=F.col("v") > 0, small=F.coalesce("v", F.lit(0)) < 3)) == [("positive", 2), ("positive", 3), ("small", 1)]
    assert rows(quality.strict(df, F.col("k") > 0, "bad")) == rows(df)
    with pytest.raises(Exception, match="bad key"):
        quality.strict(df, F.col("k") > 1, "bad key").collect()


def test_scan(spark):
    marker = "alpha beta gamma delta epsilon zeta eta"
    texts = frame(spark, [(1, f"say xalpha beta gamma delta epsilon zeta etas"), (2, marker.replace("delta", "d")), (3, "the key"), (4, None)], "t int, text string")
    marks = frame(spark, [(7, marker), (8, "key"), (9, ""), (10, None)], "m int, text string")
    assert rows(scan.containing(texts, "t", marks, "m")) == [(1, 7), (3, 8)]


def test_text_functions(spark):
    df = frame(spark, [("<p>A\r\n12 http://x.y/z a@b.co</p>",)], "t string")
    assert rows(df.select(text.normalized_page(F.col("t")))) == [("{tag}A {n} {url} a@b.co{tag}",)]
    assert rows(df.select(text.redacted(F.col("t"), 200)))[0][0].endswith("{email}</p>")
    v = frame(spark, [("1.2.3",), ("1.2.3-beta",), ("1.2.10",)], "v string")
    assert rows(v.agg(F.max_by("v", text.version_key(F.col("v"))), F.min_by("v", text.version_key(F.col("v"))))) == [("1.2.10", "1.2.3-beta")]
    s = frame(spark, [("a:b", "a:b:c"), ("a:b", "a:bc"), ("*", "z"), ("a", "a")], "p string, x string")
    assert [r[0] for r in s.select(text.scope_matches(F.col("p"), F.col("x"))).collect()] == [True, False, True, True]


def test_hashes(spark):
    df = frame(spark, [(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "g int, o int, h string")
    got = dict(rows(df.groupBy("g").agg(hashing.ordered_hash(F.col("o"), F.col("h")))))
    assert got[1] == rows(spark.sql("SELECT md5('a\\nb')"))[0][0]
    a, b = rows(df.limit(1).select(hashing.content_hash(F.lit(None).cast("string")), hashing.content_hash(F.lit(""))))[0]
    assert a != b
    assert rows(df.limit(1).select(hashing.canonical_json(F.struct(F.lit(None).cast("int").alias("k"))))) == [('{"k":null}',)]


def test_rollup_once_per_id(spark):
    t = dt.datetime(2024, 1, 2)
    df = frame(spark, [(1, 7, t, 1.5), (1, 7, t, 1.5), (2, 7, t, -0.25), (3, 7, dt.datetime(2025, 1, 1), 9.0)], "id int, u int, ts timestamp_ntz, v double")
    got = tasks.signed_rollup(df, "u", "id", "ts", F.col("v"), "2024-01-01", "2025-01-01")
    assert [(r["u"], r["n"], str(r["balance"])) for r in got.collect()] == [(7, 2, "1.25")]


def test_allocation_closure_and_verdicts(spark):
    need = frame(spark, [(1, "a", 2), (1, "a", 2), (2, "b", 1), (3, "z", 1)], "r int, i string, n int")
    stock = frame(spark, [("a", 3), ("b", 1)], "k string, h int")
    assert rows(tasks.allocation(need, "r", "i", "n", stock, "k", "h")) == [(1, "shortfall", 1), (2, "allocated", 0), (3, "unknown item", 0)]
    chain = frame(spark, [("a", "b"), ("b", "c")], "child string, parent string")
    assert rows(tasks.closure(chain)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    with pytest.raises(ValueError):
        tasks.closure(frame(spark, [("a", "b"), ("b", "a")], "child string, parent string"))
    diamond = frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e")], "child string, parent string")
    assert rows(tasks.closure(diamond)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 1), ("b", "d", 1), ("b", "e", 2), ("c", "d", 1), ("c", "e", 2), ("d", "e", 1)]
    long = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)], "child string, parent string")
    names = frame(spark, [("n12",), ("z",)], "name string")
    assert rows(tasks.resolved(names, long, frame(spark, [("n3",), ("z",)], "name string"))) == [("n3", "n12"), ("z", "z")]
    with pytest.raises(Exception, match="no such name"):
        tasks.resolved(names, long, frame(spark, [("nowhere",)], "name string")).collect()
    rules = frame(spark, [("allow", "x"), ("deny", "y")], "effect string, p string")
    who = frame(spark, [(1, "x"), (2, "y"), (3, "q")], "k int, v string")
    assert rows(tasks.decided(who, rules, F.col("p") == F.col("v"), "k")) == [(1, "allow"), (2, "deny"), (3, "deny")]


def test_jsonl_round_trip(spark, tmp_path):
    df = frame(spark, [(2, "b", None), (1, None, [1, 2])], "k int, v string, a array<int>")
    path = f"file://{tmp_path}/t"
    jsonl.write_jsonl(df, path)
    assert sorted(r["k"] for r in jsonl.read_jsonl(spark, path, df.schema).collect()) == [1, 2]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        jsonl.write_jsonl(df, path)
    part = next((tmp_path / "t/rows").glob("part-*.json"))
    part.write_text(part.read_text() + '{"a":null,"k":5,"v":null}\n')
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="manifest"):
        jsonl.read_jsonl(spark, path, df.schema)


def test_rollup_conflicts_and_rounding_at_the_own_scale(spark):
    once = frame(spark, [(1, "u", 5, "5.00"), (1, "u", 5, "5.00"), (2, "u", 6, "0.10")], "e int, g string, t int, a string")
    assert [tuple(r) for r in tasks.signed_rollup(once, "g", "e", "t", F.col("a").cast("decimal(38,2)"), F.lit(0), F.lit(9)).collect()] == [("u", 2, Decimal("5.10"))]
    conflict = frame(spark, [(1, "u", 5, "5.00"), (1, "u", 5, "7.00")], "e int, g string, t int, a string")
    with pytest.raises(Exception, match="in conflict"):
        tasks.signed_rollup(conflict, "g", "e", "t", F.col("a").cast("decimal(38,2)"), F.lit(0), F.lit(1)).collect()
    exact = frame(spark, [("0.12500000001",), ("0.125",), ("0.135",), ("-0.125",)], "a string")
    assert [str(r[0]) for r in exact.select(tasks.half_even(F.col("a").cast("decimal(38,18)"), 2)).collect()] == ["0.13", "0.12", "0.14", "-0.12"]


def test_sorted_json_at_all_depths(spark):
    from millrace.functions.hashing import canonical_json, sorted_json

    got = frame(spark, [(1,)], "a int").select(canonical_json(F.struct(F.lit(1).alias("b"), F.lit(None).cast("int").alias("a"), F.struct(F.lit("y").alias("z"), F.lit(2).alias("c")).alias("m"))), sorted_json(F.lit('{"b": [1, {"d": 1, "c": "é"}], "a": null}'))).first()
    assert tuple(got) == ('{"a":null,"b":1,"m":{"c":2,"z":"y"}}', '{"a":null,"b":[1,{"c":"é","d":1}]}')


def test_small_formats(spark):
    from millrace.functions import values

    text = lambda c, *xs: [r[0] for r in frame(spark, [(x,) for x in xs], "t string").select(c(F.col("t"))).collect()]
    assert text(values.duration_seconds, "250ms", "1.5h", "3m", "7", "-1s", "1 s", "", None) == [0.25, 5400.0, 180.0, None, None, None, None, None]
    assert text(values.relative_path, "a/./b/../c", "../a", "a/..", "/a", "", "a//b", "a/../..") == ["a/c", None, ".", None, ".", "a/b", None]
    known = F.create_map(F.lit("a"), F.lit("$${b}"), F.lit("b"), F.lit("2"))
    assert text(lambda t: values.expanded(t, known), "${a}${b}", "$$${b}", "$a", "${c}", "", "x\ny") == ["$${b}2", "$2", "$a", None, "", "x\ny"]
    pairs = lambda t: F.transform(values.assignments(t), lambda p: F.concat(p["key"], F.lit(">"), p["value"]))
    assert text(pairs, 'A=1\n\n# x\n B="x \\"y\\""', "A=1\nA=2", "oops", "A=a b", "") == [["A>1", 'B>x "y"'], None, None, None, []]
    assert text(lambda t: values.pointed(F.lit('{"a/b": [10, {"~": "x"}], "": 1}'), t), "/a~1b/0", "/a~1b/1/~0", "/a~1b/2", "/no", "") == ["10", "x", None, None, '{"a/b": [10, {"~": "x"}], "": 1}']
    with pytest.raises(Exception, match="larger than a batch"):
        frame(spark, [(["aé", "b"],)], "t array<string>").select(values.utf8_batches(F.col("t"), 2, 2)).collect()
    assert frame(spark, [(["a", "é", "b", "c"],)], "t array<string>").select(values.utf8_batches(F.col("t"), 2, 2)).first()[0] == [0, 1, 2, 2]
    with pytest.raises(Exception, match="division by zero"):
        frame(spark, [(1, 0)], "a int, b int").select(values.ratio(F.col("a"), F.col("b"))).collect()


def test_label_layout(spark):
    from millrace.operators.labels import label_layout

    rows_ = [("whole", [(0, 2), (2, 4), (4, 5)], [(2, 5)], 5), ("crossing", [(0, 3), (3, 5)], [(2, 5)], 5), ("gap", [(0, 2), (3, 5)], [(3, 5)], 5), ("disordered", [(2, 4), (0, 2)], [(0, 2)], 4), ("empty token", [(0, 0), (0, 4)], [(0, 4)], 4), ("span", [(0, 4)], [(0, 9)], 4), ("none owned", [(0, 4)], [], 4), ("two spans", [(0, 1), (1, 2), (2, 3)], [(0, 1), (2, 3)], 3)]
    df = frame(spark, rows_, "name string, o array<struct<start:int,stop:int>>, s array<struct<start:int,stop:int>>, n int")
    got = {r["name"]: tuple(r)[4:] for r in label_layout(df, F.col("o"), F.col("s"), F.col("n")).collect()}
    nothing = (None,) * 5
    assert got == {"whole": ("labelled", 2, 1, 1, True, 2), "crossing": ("crossing", *nothing), "gap": ("gap", *nothing), "disordered": ("disordered", *nothing), "empty token": ("outside", *nothing), "span": ("span outside", *nothing), "none owned": ("labelled", 0, 1, None, True, 0), "two spans": ("labelled", 2, 1, 0, False, 1)}


def test_repeated_calls_and_preferences(spark):
    from millrace.operators.preferences import oriented
    from millrace.operators.runs import repeated_calls, without

    call = lambda o, tool, status, before, after, seen: ("u", o, tool, status, before, after, seen)
    calls = [call(1, "read", "ok", "w", "w", "x"), call(2, "read", "ok", "w", "w", "x"), call(3, "read", "ok", "w", "w", "x"), call(4, "read", "ok", "w", "w", "y"), call(5, "run", "error", "w", "w", "e"), call(6, "run", "error", "w", "w", "e"), call(7, "edit", "ok", "w", "v", "d"), call(8, "edit", "ok", "v", "v", "d"), call(9, "edit", "ok", "v", "z", "d"), call(10, "read", None, "z", "z", None)]
    df = frame(spark, calls, "g string, o int, tool string, status string, before string, after string, seen string")
    args = ("g", "o", ["tool"], "status", "before", "after", "seen")
    assert rows(repeated_calls(df, *args)) == [("u", 1, 2, "read"), ("u", 7, 1, "edit")]
    assert [(r["o"], r["call_id"]) for r in without(df, *args).orderBy("o").collect()] == [(1, "tool_call_0001"), (4, "tool_call_0002"), (5, "tool_call_0003"), (6, "tool_call_0004"), (7, "tool_call_0005"), (9, "tool_call_0006"), (10, "tool_call_0007")]
    pairs = frame(spark, [("c", "a", "b", "1")], "context string, left string, right string, comparison_id string")
    with pytest.raises(Exception, match="neither alternative"):
        oriented(pairs, frame(spark, [("1", "preferred", "z")], "comparison_id string, outcome string, preferred string")).collect()
    assert oriented(pairs, frame(spark, [("1", "tie", None)], "comparison_id string, outcome string, preferred string")).collect() == []
