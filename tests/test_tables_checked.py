"""Delimited tables, versions and keys that have to be there once, and texts brought to one form."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.hashing import normalized_text
from millrace.functions.values import stable_order
from millrace.operators import tasks
from millrace.sources.delimited import fields_of, scan_delimited


def test_fields_are_those_of_the_csv_module(spark):
    rng = random.Random(2)
    rows = [["".join(rng.choice('ab,"; é') for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 5))] for _ in range(300)]
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(row)
        lines.append(out.getvalue())
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r["i"]: r["f"] for r in df.select("i", fields_of(F.col("line")).alias("f")).collect()}
    assert got == dict(enumerate(rows))
    bad = ['"a', 'a"b', '"a"b', 'x,"', '"a""']
    assert {r["f"] for r in spark.createDataFrame([(b,) for b in bad], "line string").select(fields_of(F.col("line")).alias("f")).collect()} == {None}


def test_scan_of_delimited_files(spark, tmp_path):
    files = {"a.csv": 'b,a,c\r\n1,"x, y",3\r\n\r\n1,2\n1,2,3,4\n"1,2,3\n,,\n', "b.csv": "a,b,a\n1,2,3\n", "c.csv": "a,c\n1,2\n", "d.csv": 'a,"b\n1,2\n', "e.csv": "a,b\n", "f.csv": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = {(r["file"].rsplit("/", 1)[1], r["line"]): tuple(r)[2:] for r in scan_delimited(spark, str(tmp_path), ["a", "b"]).collect()}
    assert rows == {
        ("a.csv", 2): (None, "x, y", "1"), ("a.csv", 4): ("2 fields of 3", None, None), ("a.csv", 5): ("4 fields of 3", None, None), ("a.csv", 6): ("open quote", None, None), ("a.csv", 7): (None, "", ""),
        ("b.csv", 2): ("header: twice a", None, None), ("c.csv", 2): ("header: no b", None, None), ("d.csv", 2): ("header: open quote", None, None),
    }


def test_latest_versions_and_places(spark):
    rows = spark.createDataFrame([(5, "b", 2), (1, "a", 1), (2, "b", 9), (3, "c", 1), (4, "a", 3)], "at int, k string, v int")
    got = {r["k"]: (r["v"], r["place"]) for r in tasks.latest_versions(rows, "k", "v", ["at"]).collect()}
    assert got == {"a": (3, 0), "b": (9, 1), "c": (1, 2)}
    with pytest.raises(Exception, match="there more than once: a, 1"):
        tasks.latest_versions(rows.unionByName(spark.createDataFrame([(9, "a", 1)], rows.schema)), "k", "v", ["at"]).collect()


def test_counts_need_keys_that_are_there_once(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (None, "y"), (None, "y")], "k int, s string")
    assert {tuple(r) for r in tasks.counts_by_status(rows, "k", "s").collect()} == {("x", 2), (None, 1), ("y", 2)}
    with pytest.raises(Exception, match="there more than once: 2"):
        tasks.counts_by_status(rows.unionByName(spark.createDataFrame([(2, "z")], rows.schema)), "k", "s").collect()


def test_an_order_that_is_not_there_can_be_an_error(spark):
    edge = lambda a, b: F.struct(F.lit(a).alias("node"), F.lit(b).alias("needed"))
    nodes = F.array(*map(F.lit, "abcd"))
    order = lambda *edges, **k: spark.range(1).select(stable_order(nodes, F.array(*edges), **k)).first()[0]
    assert order(edge("a", "c"), edge("b", "a"), fail=True) == ["c", "a", "b", "d"]
    assert order(edge("a", "c"), edge("c", "a")) is None
    with pytest.raises(Exception, match="no order for a, c"):
        order(edge("a", "c"), edge("c", "a"), fail=True)


def test_normalized_text(spark):
    cases = {"  A\t\nb\x0b\x1cC ": "a b c", "ﬁne　Ⅳ": "fine iv", "a\xa0b": "a b", "ÀÉ": "àé", "": "", None: None, "①²": "12", "é": "é"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["n"] for r in rows.select("t", normalized_text(F.col("t")).alias("n")).collect()} == cases
