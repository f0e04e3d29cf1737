"""Typed scans, links, evidence and JSON of any schema, on cases written by hand."""

from __future__ import annotations

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import jsontext
from millrace.functions.values import pointed
from millrace.operators import evidence, linkage
from millrace.sources.typed import Field, accepted, numbered_lines, rejected, scan

FIELDS = [
    Field("id", "string", rules=(("empty", lambda v: v != ""),)),
    Field("n", "integer", required=False, nullable=True),
    Field("x y'z", "number", required=False),
    Field("ok", "boolean", required=False),
    Field("who", "object", required=False),
    Field("all", "array", required=False),
]
LINES = {
    '{"id": "a"}': None,
    "": "blank line",
    " \t\r": "blank line",
    '{"id": "a", "n": 1,}': "no JSON",
    "[1]": "no object",
    "null": "no object",
    '{"id": "a", "z": 1, "y": 2}': "unknown field y",
    '{"n": 1}': "id: missing",
    '{"id": null}': "id: null",
    '{"id": 5}': "id: no string",
    '{"id": ""}': "id: empty",
    '{"id": "b", "n": null}': None,
    '{"id": "b", "n": "7"}': "n: no integer",
    '{"id": "b", "n": 7.5}': "n: no integer",
    '{"id": "b", "n": 12345678901234567890}': None,
    '{"id": "c", "x y\'z": 1}': None,
    '{"id": "c", "x y\'z": 1e3}': None,
    '{"id": "c", "x y\'z": true}': "x y'z: no number",
    '{"id": "d", "ok": 1}': "ok: no boolean",
    '{"id": "d", "who": [1]}': "who: no object",
    '{"id": "d", "who": {"a": [1]}, "all": [], "ok": false}': None,
    '{"id": "d", "all": {}}': "all: no array",
    '{"id": "e", "id": "f"}': "no JSON",
    '{"id": "e"} {"id": "f"}': "no JSON",
    '{"id": "é \\u00e9"}\r': None,
}


def test_scan_tells_every_fault_with_its_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("\n".join(LINES).encode())
    scanned = scan(spark, str(tmp_path), FIELDS, blank="error")
    assert {r["line"]: r["reason"] for r in scanned.collect()} == dict(enumerate(LINES.values(), 1))
    kept = scan(spark, str(tmp_path), FIELDS)
    assert {r["line"] for r in rejected(kept).collect()} == {i for i, v in enumerate(LINES.values(), 1) if v and v != "blank line"}
    good = {r["line"]: r for r in accepted(kept).collect()}
    assert set(good) == {i for i, v in enumerate(LINES.values(), 1) if v is None}
    assert good[15]["n"] == 12345678901234567890 and good[25]["id"] == "é é"
    assert scan(spark, str(tmp_path), FIELDS, closed=False).where("reason like 'unknown%'").count() == 0
    with pytest.raises(Exception, match=r"a\.jsonl:4: no JSON"):
        accepted(kept, fail=True).collect()


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 1), ("c", 3000)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name}{i}" + "x" * (i % 50) for i in range(1, n + 1)) + "\n")
    (tmp_path / "d.txt").write_text("")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = [(r["file"].rsplit("/", 1)[1], r["line"], r["value"].rstrip("x")) for r in rows.collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(found) == 8001
    assert all(v == f"{f[0]}{line}" for f, line, v in found)


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("")
    assert scan(spark, str(tmp_path), FIELDS).collect() == []


CALLS = "g int, id string, at int, is_tool boolean, name string, arguments string"
MESSAGES = "g int, ordinal long, id string, at int, name string, content string"
RESULTS = "g int, ordinal long, id string, name string, content string, arguments string"


def links(spark, calls, messages, results):
    rows = linkage.linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(results, RESULTS), "g")
    return {(r["g"], r["ordinal"]): r["problem"] for r in rows.collect()}


def test_each_fault_of_a_link(spark):
    call = lambda g, i, **k: (g, i, k.get("at", 2), k.get("tool", True), k.get("name", "run"), "args")
    message = lambda g, n, i, **k: (g, n, i, k.get("at", 3 + n), k.get("name", "run"), "out")
    result = lambda g, n, i, **k: (g, n, i, k.get("name", "run"), k.get("content", "out"), k.get("arguments", "args"))
    assert links(spark, [call(1, "a"), call(1, "b")], [message(1, 0, "a"), message(1, 1, "b")], [result(1, 0, "a"), result(1, 1, "b")]) == {(1, 0): None, (1, 1): None}
    got = links(
        spark,
        [call(1, "a"), call(1, "b"), call(2, "a"), call(3, "a"), call(3, "b"), call(4, "a"), call(4, "a"), call(5, "a", tool=False), call(6, "a", at=9), call(7, "a"), call(8, "a"), call(9, "a"), call(10, "a")],
        [message(1, 0, "a"), message(1, 1, "b"), message(2, 0, "a"), message(3, 0, "a"), message(4, 0, "a"), message(5, 0, "a"), message(6, 0, "a"), message(7, 0, "a"), message(8, 0, "a"), message(9, 0, "a"), message(10, 0, "a"), message(10, 1, "a"), message(11, 0, "zz"), message(11, 1, None)],
        [result(1, 0, "b"), result(1, 1, "a"), result(3, 0, "a"), result(3, 1, "b"), result(4, 0, "a"), result(5, 0, "a"), result(6, 0, "a"), result(7, 0, "a", name="x"), result(8, 0, "a", content="x"), result(9, 0, "a", arguments=None), result(10, 0, "a"), result(10, 1, "a"), result(11, 0, "zz"), result(11, 1, "y")],
    )
    assert got == {
        (1, 0): "result swapped", (1, 1): "result swapped", (2, 0): "result missing", (3, 0): None, (3, 1): "result surplus", (4, 0): "id called twice", (5, 0): "call is no tool call",
        (6, 0): "call comes later", (7, 0): "name differs", (8, 0): "content differs", (9, 0): "arguments differ", (10, 0): "id answered twice", (10, 1): "id answered twice", (11, 0): "no call", (11, 1): "message without id",
    }


def test_results_without_ids_are_taken_by_place(spark):
    calls = [(1, i, 1, True, "run", "args") for i in "ab"]
    messages = [(1, n, i, 5, "run", "out") for n, i in enumerate("ab")]
    assert links(spark, calls, messages, [(1, 0, None, "run", "out", "args")]) == {(1, 0): None, (1, 1): "result missing"}
    assert links(spark, calls, messages[:1], [(1, n, None, "run", "out", "args") for n in range(2)]) == {(1, 0): None, (1, 1): "result surplus"}


def test_calls_are_removed_in_lockstep(spark):
    messages = spark.createDataFrame([(1, n, i) for n, i in enumerate(["a", "b", None, "c"])] + [(2, 0, "a")], "g int, ordinal long, id string")
    results = spark.createDataFrame([(1, n, v) for n, v in enumerate("wxyz")] + [(2, 0, "q")], "g int, ordinal long, value string")
    dropped = spark.createDataFrame([(1, "b"), (1, "b"), (2, "zz")], "g int, id string")
    left = linkage.without_calls(messages, results, dropped, "g")
    assert sorted(map(tuple, left[0].collect()), key=str) == [(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, "a")]
    assert sorted(map(tuple, left[1].collect())) == [(1, 0, "w"), (1, 1, "y"), (1, 2, "z"), (2, 0, "q")]
    with pytest.raises(Exception, match="group 2 has 1 messages and 0 results"):
        linkage.without_calls(messages, results.where("g = 1"), dropped, "g")[0].collect()


def test_chain_is_linear_in_the_length(spark):
    """One conversation of 100,000 turns beside short ones; the chain of each place is that of a plain loop."""
    import hashlib

    rows = spark.range(100_000).select(F.lit(1).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h")).unionByName(spark.createDataFrame([(2, 0, "x"), (2, 1, None), (None, 0, "y")], "g int, id long, h string")).repartition(7)
    began = time.time()
    got = {(r["g"], r["id"]): r["prefix"] for r in evidence.chained(rows, "g", "id", "h").collect()}
    assert time.time() - began < 60
    assert len(got) == 100_003
    state = hashlib.md5(b"").hexdigest()
    for i in range(100_000):
        assert got[1, i] == state
        state = hashlib.md5((state + hashlib.md5(str(i).encode()).hexdigest()).encode()).hexdigest()
    first = hashlib.md5(b"").hexdigest()
    assert got[2, 0] == got[None, 0] == first and got[2, 1] == hashlib.md5((first + "x").encode()).hexdigest()


def test_evidence_is_rebuilt(spark):
    messages = spark.createDataFrame([(1, 10, "system", None, "s"), (1, 20, "user", None, "u"), (1, 30, "assistant", None, "do"), (1, 40, "tool", "run", "out"), (1, 50, "assistant", None, "done"), (2, 1, "assistant", None, "early")], "g int, at int, role string, name string, content string")
    found = evidence.occurrences(messages, "g")
    rows = evidence.recorded(found, "g")
    assert sorted((r["ordinal"], r["n_left"]) for r in rows.collect()) == [(2, 2), (4, 0)]
    assert {r["problem"] for r in evidence.held_against(rows, found, "g").collect()} == {None}
    again = evidence.occurrences(messages.withColumn("content", F.when(F.col("at") == 40, "other").otherwise(F.col("content"))), "g")
    assert {r["ordinal"]: r["problem"] for r in evidence.held_against(rows, again, "g").collect()} == {2: None, 4: "context differs"}
    moved = rows.withColumn("g", F.lit(2)).withColumn("ordinal", F.lit(0).cast("long"))
    assert {r["problem"] for r in evidence.held_against(moved, found, "g").collect()} == {"too little context"}
    assert {r["problem"] for r in evidence.held_against(rows.withColumn("g", F.lit(None).cast("int")), found, "g").collect()} == {"unknown transcript"}


class Number(str):
    """A number as it is written."""


leaves = st.none() | st.booleans() | st.text(max_size=6) | st.integers().map(str).map(Number) | st.floats(allow_nan=False, allow_infinity=False).map(repr).map(Number) | st.sampled_from(["1e400", "-0", "1.0", "1E+2", "12345678901234567890123456789012345678901234567890"]).map(Number)
values = st.recursive(leaves, lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4), max_leaves=12)


def plain(x, dropped=(), replaced=None, rule=lambda s: s):
    again = lambda y: plain(y, dropped, replaced, rule)
    if isinstance(x, Number):
        return str(x)
    if isinstance(x, str):
        return json.dumps(rule(x), ensure_ascii=False)
    if isinstance(x, list):
        return "[" + ",".join(map(again, x)) + "]"
    if isinstance(x, dict):
        keys = sorted((k for k in x if k not in dropped), key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + (json.dumps(replaced[k]) if k in (replaced or {}) else again(x[k])) for k in keys) + "}"
    return json.dumps(x)


def test_exact_json_and_normalizers_on_random_values(spark):
    cases = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(values)
    def gather(x):
        cases.append(x)

    gather()
    keyed = [{"id": x, "a": [{"id": 1, "b": x}], "text": "Ab"} if i % 3 == 0 else x for i, x in enumerate(cases)]
    keyed = [json.loads(plain(x), parse_int=Number, parse_float=Number) for x in keyed]
    rows = spark.createDataFrame([(i, plain(x).replace(",", " , ") if '"' not in plain(x) else plain(x)) for i, x in enumerate(keyed)], "i int, t string")
    got = {r["i"]: r["e"] for r in rows.select("i", jsontext.exact_json(F.col("t")).alias("e")).collect()}
    assert got == {i: plain(x) for i, x in enumerate(keyed)}
    got = {r["i"]: r["e"] for r in rows.select("i", jsontext.normalized_json(F.col("t"), dropped=["id"], rule=lambda s: F.concat(s, F.lit("!"))).alias("e")).collect()}
    assert got == {i: plain(x, dropped=["id"], rule=lambda s: s + "!") for i, x in enumerate(keyed)}
    got = {r["i"]: r["e"] for r in rows.select("i", jsontext.normalized_json(F.col("t"), replaced={"id": "<ID>"}).alias("e")).collect()}
    assert got == {i: plain(x, replaced={"id": "<ID>"}) for i, x in enumerate(keyed)}


def test_what_is_no_json_and_files_by_kind(spark):
    bad = ["", "1] , [2", '1} , {"k": 2', '{"a":1} x', "1, 2", "01", "[1,]", '{"a":1,"a":2}', "{'a':1}", "nul", "1 2", None]
    rows = spark.createDataFrame([(t,) for t in bad], "t string")
    assert {r["e"] for r in rows.select(jsontext.exact_json(F.col("t")).alias("e")).collect()} == {None}
    files = [("a.json", '{"z":1,"at":2}', '{"z":1}'), ("b.jsonl", '{"at":1}\n\n [2.0] \n', "{}\n[2.0]\n"), ("c.txt", '{"at": 1}', '{"AT": 1}'), ("d.json", "{", None), ("e.jsonl", "", "\n"), ("f.jsonl", "[1]\n{", None), ("g.json", None, None)]
    rows = spark.createDataFrame(files, "path string, content string, want string")
    for r in rows.withColumn("got", jsontext.normalized_file(F.col("path"), F.col("content"), dropped=["at"], rule=F.upper)).collect():
        assert r["got"] == r["want"], r["path"]


def test_deep_nesting(spark):
    deep = "[" * 300 + '{"id":1,"x":[{}]}' + "]" * 300
    rows = spark.createDataFrame([(deep,)], "t string")
    assert rows.select(jsontext.nesting(F.col("t"))).first()[0] == 303
    assert rows.select(jsontext.normalized_json(F.col("t"), dropped=["id"])).first()[0] == "[" * 300 + '{"x":[{}]}' + "]" * 300


def test_pointers(spark):
    document = '{"0":{"x":5},"a\'b":null,"l":[1.50,[2,3]],"a/b":{"~":"t"},"":{"":7}}'
    want = {"/0/x": "5", "/a'b": "null", "/l/0": "1.50", "/l/1": "[2,3]", "/l/01": None, "/l/-1": None, "/l/9": None, "/l/99999999999": None, "/zz": None, "/a~1b/~0": "t", "x": None, "/a~2": None, "/l/x": None, "/": '{"":7}', "//": "7", "/0/x/y": None}
    rows = spark.createDataFrame([(document, p) for p in want], "d string, p string")
    assert {r["p"]: r["v"] for r in rows.select("p", pointed(F.col("d"), F.col("p")).alias("v")).collect()} == want
