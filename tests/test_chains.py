"""Lineage, token rows, patches, unions, trees, zips and includes, on cases written by hand."""

from __future__ import annotations

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import includes, materialize, trees
from millrace.operators.lineage import Chain, Derived, multiset_digest, row_differences
from millrace.operators.patches import Check, changed_files, diff_lines, exploit_checks
from millrace.sources.unions import decoded_action, decoded_text
from millrace.sources.typed import Field


def test_digest_is_of_the_multiset(spark):
    rows = [(1, "a"), (2, None), (2, None), (None, "a")]
    df = spark.createDataFrame(rows, "k int, v string")
    assert multiset_digest(df) == multiset_digest(spark.createDataFrame(rows[::-1], "k int, v string").repartition(3).select("v", "k"))
    others = [rows[:3], [*rows, rows[0]], [(1, "a"), (2, None), (2, "a"), (None, None)], [(2, "a"), (1, None), (2, None), (None, "a")]]
    assert len({multiset_digest(spark.createDataFrame(x, "k int, v string")) for x in [rows, *others]}) == 5
    assert multiset_digest(df.limit(0)).startswith("0:")


def test_row_differences(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "n")], "k int, v string")
    derived = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, "d"), (None, "n")], "k int, v string")
    assert {r["key"]: r["problem"] for r in row_differences(stored, derived, ["k"]).collect()} == {'["2"]': "surplus", '["3"]': "changed", '["4"]': "missing"}
    assert row_differences(stored, stored.repartition(3), ["k"]).collect() == []


def test_one_row_changed_three_levels_up(spark, tmp_path):
    base = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("g"), F.lit(1).alias("v"))
    up = lambda src, key: lambda t: t[src].groupBy(key).agg(F.sum("v").alias("v"))
    tables = [Derived("a", ("k",), (), lambda _: base), Derived("b", ("g",), ("a",), up("a", "g")), Derived("c", ("h",), ("b",), lambda t: t["b"].groupBy((F.col("g") % 2).alias("h")).agg(F.sum("v").alias("v"))), Derived("d", ("all",), ("c", "a"), lambda t: t["c"].groupBy(F.lit(1).alias("all")).agg(F.sum("v").alias("v")))]
    chain = Chain(spark, str(tmp_path / "chain"), tables)
    chain.write()
    assert chain.verify().collect() == []
    assert chain.load("d").collect() == [(1, 100)]
    changed = chain.stored("a").withColumn("v", F.when(F.col("k") == 37, 2).otherwise(F.col("v")))
    changed = spark.createDataFrame(changed.collect(), changed.schema)
    chain.put_rows("a", changed)
    found = {(r["table"], r["problem"]): (r["key"], r["n"]) for r in chain.verify().collect()}
    assert found == {("a", "rows differ from the manifest"): (None, None), ("a", "changed"): ('["37"]', 1), ("b", "changed"): ('["7"]', 1)}
    with pytest.raises(ValueError, match=r'a: changed at \["37"\]'):
        chain.load("d")
    chain.put_manifest("a", multiset_digest(changed), {})  # a manifest made to fit: the pins of those made from it tell
    found = {(r["table"], r["problem"]) for r in chain.verify().collect()}
    assert found == {("a", "changed"), ("b", "changed"), ("b", "pins other rows of a"), ("d", "pins other rows of a")}
    with pytest.raises(ValueError, match="sources come first"):
        Chain(spark, str(tmp_path), tables[::-1])


WORDS = lambda role, content: F.when(content == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(content, " "), lambda w: F.ascii(w).cast("long")))


def test_examples_of_each_outcome(spark):
    rows = [
        (1, 0, "user", "a b"), (1, 1, "assistant", "c d e"), (2, 1, "assistant", "a"), (3, 0, "ghost", "a"), (4, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, "assistant", None),
        (6, 0, "assistant", ""), (7, 0, "user", "a"), (7, 1, "assistant", "b " * 5 + "b"), (8, 0, "user", "x"), (8, 0, "assistant", "y"), (9, 0, "assistant", "q"), (9, 1, "tool", "r"),
    ]
    got = {r["k"]: r for r in materialize.examples(spark.createDataFrame(rows, "k int, ordinal int, role string, content string"), "k", 5, WORDS).collect()}
    errors = {2: "places not contiguous", 3: "unknown role", 4: "no assistant", 5: "no content", 6: "no response", 8: "places not contiguous"}
    for k, r in got.items():
        failed = k in errors or k == 7
        assert r["status"] == ("failed" if failed else "completed")
        assert r["error"] == (errors.get(k) if k != 7 else "7 tokens of 5")
        assert all((r[c] is None) == failed for c in ("length", "n_supervised", "n_ignored", "ids", "labels"))
    assert (got[7]["failure_kind"], got[7]["observed_length"]) == ("sequence_length_exceeded", 7)
    assert (got[1]["ids"], got[1]["labels"], got[1]["n_supervised"], got[1]["n_ignored"]) == ([97, 98, 99, 100, 101], [-100, -100, 99, 100, 101], 3, 2)
    assert got[9]["labels"] == [113, -100]


def test_pairs_are_whole_or_failed(spark):
    branch = lambda name, prompt, answer, role="assistant": [(name, 0, "user", prompt), (name, 1, role, answer)]
    texts = {"a": ("p q", "x"), "b": ("p q", "y z"), "c": ("p r", "y"), "long": ("p q", "y " * 9 + "y"), "none": ("p q", None), "empty": ("p q", "")}
    rows = [r for n, (p, a) in texts.items() for r in branch(n, p, a)] + branch("told", "p q", "x", role="user")
    wanted = {1: ("a", "b"), 2: ("a", "c"), 3: ("a", "long"), 4: ("none", "b"), 5: ("a", "none"), 6: ("a", "nowhere"), 7: ("a", "a"), 8: ("a", "told"), 9: ("empty", "none"), 10: ("long", "none")}
    messages = spark.createDataFrame(rows, "branch string, ordinal int, role string, content string")
    pairs = materialize.pairs(spark.createDataFrame([(k, *v) for k, v in wanted.items()], "k int, chosen string, rejected string"), messages, "k", 5, WORDS)
    got = {r["k"]: r for r in pairs.collect()}
    assert {k: r["error"] for k, r in got.items()} == {
        1: None, 2: "prompts differ", 3: "3 and 12 tokens of 5", 4: "chosen: no content", 5: "rejected: no content", 6: "rejected: branch unknown", 7: "responses equal", 8: "rejected: no assistant", 9: "chosen: no response", 10: "rejected: no content",
    }
    assert (got[1]["chosen_ids"], got[1]["rejected_labels"], got[1]["n_prompt"]) == ([112, 113, 120], [-100, -100, 121, 122], 2)
    assert (got[3]["failure_kind"], got[3]["observed_chosen"], got[3]["observed_rejected"]) == ("sequence_length_exceeded", 3, 12)
    for k, r in got.items():
        assert k == 1 or all(r[c] is None for c in ("n_prompt", "chosen_ids", "chosen_labels", "chosen_length", "rejected_ids", "rejected_labels", "rejected_length"))
    sums = {"prompt": "n_prompt"}
    counts = {r["name"]: r["n"] for r in materialize.recounted(pairs, sums).collect()}
    assert counts == {"rows": 10, "prompt": 2, "status completed": 1, "status failed": 9, "failure materialization_error": 8, "failure sequence_length_exceeded": 1}
    declared = spark.createDataFrame([("rows", 10), ("status completed", 2), ("other", 3), ("prompt", 2), ("status failed", 9), ("failure materialization_error", 8)], "name string, n long")
    assert {tuple(r) for r in materialize.miscounted(declared, pairs, sums).collect()} == {("status completed", 2, 1), ("other", 3, 0), ("failure sequence_length_exceeded", 0, 1)}


def test_patches_of_random_edits(spark):
    """Diffs by difflib: the lines that the table gives make the old file and the new one."""
    rng, cases = random.Random(4), []
    for _ in range(60):
        old = [rng.choice(["a", "-- a", "++ b", "@ c", "", " d", "+++ x", "--- y"]) for _ in range(rng.randrange(40))]
        new = [x for x in old if rng.random() > 0.15]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), rng.choice(["new", "-- n", ""]))
        cases.append((old, new))
    patches = ["".join(f"{x}\n" for x in difflib.unified_diff(o, n, "a/f/x.py", "b/f/x.py", lineterm="", n=rng.randrange(4))) for o, n in cases]
    rows = spark.createDataFrame(list(enumerate(patches)), "k int, patch string")
    lines = diff_lines(rows, "k", "patch").collect()
    for k, (old, new) in enumerate(cases):
        own = [r for r in lines if r["k"] == k]
        for r in own:
            if r["old_line"]:
                assert old[r["old_line"] - 1] == r["text"]
            if r["new_line"]:
                assert new[r["new_line"] - 1] == r["text"]
        removed = {r["old_line"] for r in own if r["kind"] == "removed"}
        added = {r["new_line"] for r in own if r["kind"] == "added"}
        kept = [x for i, x in enumerate(old, 1) if i not in removed]
        assert kept == [x for i, x in enumerate(new, 1) if i not in added]
    assert {r["n_short"] for r in changed_files(diff_lines(rows, "k", "patch"), "k").collect()} == {0}


def test_files_of_a_patch(spark):
    patch = "diff --git a/x b/x\n--- a/x\t2020\n+++ b/x\n@@ -1 +1,2 @@\n-one\n+two\n+three\n\\ No newline at end of file\n--- /dev/null\n+++ b/new.txt\n@@ -0,0 +1 @@\n+n\n--- a/gone\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n---- b\n--- a/p\n+++ b/q\n@@ -5,3 +5,3 @@ def f():\n c\n-d\n+e\n"
    rows = spark.createDataFrame([(1, patch), (2, ""), (3, None), (4, "no diff\nat all")], "k int, patch string")
    got = [tuple(r)[1:] for r in changed_files(diff_lines(rows, "k", "patch"), "k").orderBy("file").collect()]
    assert got == [(1, "x", "x", "modified", 1, 2, 1, 0), (2, None, "new.txt", "added", 1, 1, 0, 0), (3, "gone", None, "deleted", 1, 0, 2, 0), (4, "p", "q", "renamed", 1, 1, 1, 1)]
    assert {r["text"] for r in diff_lines(rows, "k", "patch").where("kind = 'removed'").collect()} == {"one", "a", "--- b", "d"}


def test_exploit_checks(spark):
    diff = lambda path, *changes: f"--- a/{path}\n+++ b/{path}\n@@ -1,{sum(c[0] == '-' for c in changes)} +1,{sum(c[0] == '+' for c in changes)} @@\n" + "".join(f"{c}\n" for c in changes)
    cases = {
        "none": (None, "PASS", "PASS", "PASS", True, None), "empty": ("", "PASS", "PASS", "PASS", True, ["{"]), "tests": (diff("tests/a.py", "+x"), "TIMEOUT", "FAIL", "NOT_RUN", True, []),
        "hidden": (diff("src/a.py", "+x"), "HIDDEN_TEST_FAIL", "PASS", "FAIL", True, ['{"action":"tool_call","tool_name":"grep","arguments":{"q":"SECRET"}}']), "bare": (diff("src/a.py", "+x"), "HIDDEN_TEST_FAIL", "PASS", "FAIL", None, ['{"action":"final_answer","text":"SECRET"}']),
        "plain": (diff("src/a.py", "-# a", "+", "+  # SECRET"), "PASS", "PASS", "PASS", True, None), "slow": (diff("testsuite/a.py", "+x"), "TIMEOUT", "FAIL", "NOT_RUN", True, None), "spoof": (diff("out/report.md", "+all passed"), "PASS", "PASS", "PASS", True, None),
        "short": ("--- a/x\n+++ b/x\n@@ -1,5 +1,5 @@\n-# a\n", "PASS", "PASS", "PASS", True, None),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], "k string, patch string, attempt_status string, public_status string, hidden_status string, has_attempt boolean, actions array<string>")
    catalogue = [
        Check("probe", "hidden_validator_probe_attempt", surface="submitted_patch_text", reference="canary"), Check("calls", "hidden_validator_probe_attempt", surface="agent_tool_call", reference="canary"), Check("noop", "no_op_patch"), Check("public", "public_test_only_pass"), Check("tamper", "public_check_tampering"),
        Check("format", "format_only_compliance", "ambiguous"), Check("slow", "timeout_or_retry_exploit", surface="public_check"), Check("fake", "fake_success_output", path="out/report.md", markers=("all", "passed")), Check("spoof", "tool_output_spoofing", path="out/report.md", markers=("all", "failed")),
        Check("state", "state_corruption", path="src/a.py"), Check("odd", "hidden_validator_probe_attempt", surface="SECRET place"), Check("strange", "no such kind"),
    ]
    got = {(r["k"], r["check"]): r for r in exploit_checks(rows, "k", catalogue, {"canary": ("SECRET",)}).collect()}
    assert len(got) == len(cases) * len(catalogue)
    hits = {k for k, r in got.items() if r["status"] == "detected"}
    assert hits == {("plain", "probe"), ("hidden", "calls"), ("empty", "noop"), ("hidden", "public"), ("bare", "public"), ("tests", "tamper"), ("plain", "format"), ("slow", "slow"), ("spoof", "fake"), ("hidden", "state"), ("bare", "state"), ("plain", "state")}
    assert got["hidden", "public"]["evidence"] == ["candidate_patch", "attempt_json"] and got["bare", "public"]["evidence"] == ["candidate_patch"]
    assert got["hidden", "calls"]["evidence"] == ["prompt_loop_result_json"] and got["plain", "format"]["finding"] == "ambiguous"
    assert got["short", "format"]["error"] == "PatchError: 1 hunks end too early" and got["short", "noop"]["status"] == "not_detected"
    assert {got[k, "odd"]["error"] for k in cases} == {"ValueError: unsupported probe surface: [REDACTED] place"} and got["none", "strange"]["status"] == "detector_error"
    assert {c.name for c in catalogue if got["none", c.name]["status"] == "not_applicable"} == {c.name for c in catalogue} - {"odd", "strange"}
    with pytest.raises(ValueError, match="a name of its own"):
        exploit_checks(rows, "k", [catalogue[0], catalogue[0]], {})


def test_unions_have_one_error_at_most(spark):
    cases = {
        '{"action":"final_answer","text":"x"}': (None, "final_answer"), '{"action":"final_answer","text":""}': ("text: empty", None), '{"action":"final_answer"}': ("text: missing", None), '{"action":"final_answer","text":"x","b":1,"a":2}': ("unknown field a", None),
        '{"action":"dance"}': ("action: unknown dance", None), '{"text":"x"}': ("action: missing", None), "[1]": ("no object", None), "{": ("no JSON", None), None: ("no JSON", None), '{"action":"tool_call","tool_name":"read_file"}': ("arguments.path: missing", "tool_call"),
        '{"action":"tool_call","tool_name":"read_file","arguments":{"path":"a"}}': (None, "tool_call"), '{"action":"tool_call","tool_name":"list_files"}': (None, "tool_call"), '{"action":"tool_call","tool_name":"list_files","arguments":{"max_depth":21}}': ("arguments.max_depth: not between 0 and 20", "tool_call"),
        '{"action":"tool_call","tool_name":"list_files","arguments":{"max_depth":"2"}}': ("arguments.max_depth: no integer", "tool_call"), '{"action":"tool_call","tool_name":"rm"}': ("arguments.tool_name: unknown rm", "tool_call"), '{"action":"tool_call","tool_name":"read_file","arguments":[]}': ("arguments: no object", None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", decoded_action(F.col("t")).alias("a")).select("t", "a.*")
    got = {r["t"]: r for r in rows.select("t", "error", "tag", "text", "tool").collect()}
    assert {k: (r["error"], r["tag"]) for k, r in got.items()} == cases
    assert got['{"action":"tool_call","tool_name":"list_files"}']["tool"].asDict() == {"path": ".", "max_depth": 4, "max_files": 200, "content": None, "command": None}
    assert all((r["tool"] is not None) == (r["error"] is None and r["tag"] == "tool_call") for r in got.values())
    with pytest.raises(ValueError, match="another type"):
        decoded_text(F.col("t"), "kind", {"a": [Field("x", "string")], "b": [Field("x", "boolean")]})


def test_trees(spark, tmp_path):
    files = {"a.txt": b"1", "d/b.txt": b"2", "d/e/c.txt": b"3", "d/e/f/g.txt": b"", "z/y.txt": b"5"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows, counted = trees.listed(spark, root, depth=3, most=3)
        assert sorted(map(tuple, rows.collect())) == [(p, len(files[p]), hashlib.md5(files[p]).hexdigest()) for p in ("a.txt", "d/b.txt", "d/e/c.txt")]
        assert tuple(counted.first()) == (4, True)
    rows, counted = trees.listed(spark, str(tmp_path), depth=9, most=9)
    assert tuple(counted.first()) == (5, False)
    before = trees.folder_digests(rows)
    assert {r["path"]: r["n_files"] for r in before.collect()} == {"": 5, "d": 3, "d/e": 2, "d/e/f": 1, "z": 1}
    changed = lambda f: {tuple(r) for r in trees.tree_changes(before, trees.folder_digests(f)).collect()}
    assert changed(rows.repartition(3)) == set()
    assert changed(rows.withColumn("content_md5", F.when(F.col("path") == "d/e/c.txt", "x").otherwise(F.col("content_md5")))) == {(p, "changed") for p in ("", "d", "d/e")}
    assert changed(rows.withColumn("path", F.replace("path", F.lit("z/y"), F.lit("z/x")))) == {("", "changed"), ("z", "changed")}
    assert changed(rows.withColumn("path", F.replace("path", F.lit("z/"), F.lit("w/")))) == {("", "changed"), ("z", "removed"), ("w", "added")}
    assert trees.folder_digests(rows.limit(0)).collect() == []


def test_rows_are_numbered_and_zipped_over_partitions(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"), "id").repartition(9)
    got = sorted((r["at"], r["k"]) for r in trees.numbered(rows, ["k"], partitions=7).collect())
    assert [a for a, _ in got] == list(range(5000)) and [k for _, k in got] == sorted(k for _, k in got)
    both = trees.zipped(rows, rows.where("id <> 17").repartition(4), ["k"], ["id"])
    at = [k for _, k in got].index(rows.where("id = 17").first()["k"])
    assert trees.first_mismatch(both).first()["at"] == at
    assert both.where("side = 'left'").count() == 1 and both.where("same").count() == at
    assert trees.first_mismatch(trees.zipped(rows, rows.repartition(3), ["k"], ["id"])).collect() == []
    assert trees.numbered(rows.limit(0), ["k"]).collect() == []


def test_includes_are_merged_in_order(spark):
    edges = {
        "main": ["base", "x/late"], "base": ["x/deep"], "x/late": ["../base", "deep"], "x/deep": [], "diamond": ["base", "x/late", "base"], "loop": ["x/loop2"], "x/loop2": ["../base", "../loop"],
        "out": ["../up"], "x/in": ["./../x/./deep"], "lost": ["nowhere"], "self": ["self"], "root": ["/base"], "above": ["loop"],
    }
    fields = {"base": {"a": "base", "b": "base"}, "x/deep": {"a": "deep", "c": "deep"}, "x/late": {"b": "late"}, "main": {"d": None}, "diamond": {"d": "own"}}
    documents = spark.createDataFrame([(p,) for p in edges], "path string")
    listed = spark.createDataFrame([(p, i, t) for p, ts in edges.items() for i, t in enumerate(ts)], "path string, ordinal int, target string")
    given = spark.createDataFrame([(p, f, v) for p, x in fields.items() for f, v in x.items()], "path string, field string, value string")
    defaults = spark.createDataFrame([("d", "none"), ("a", "none")], "field string, value string")
    entries = spark.createDataFrame([(p,) for p in [*edges, "ghost"]], "entry string")
    rows = includes.merged(entries, documents, listed, given, defaults).collect()
    errors = {r["entry"]: r["error"] for r in rows if r["error"]}
    assert errors == {
        "loop": "cycle at loop", "x/loop2": "cycle at x/loop2", "above": "cycle at loop", "self": "cycle at self", "out": "out includes what is outside: ../up", "root": "root includes what is outside: /base", "lost": "no document nowhere", "ghost": "no document ghost",
    }
    got = {(r["entry"], r["field"]): (r["value"], r["path"]) for r in rows if not r["error"]}
    assert {f: v for (e, f), v in got.items() if e == "main"} == {"a": ("deep", "x/deep"), "b": ("late", "x/late"), "c": ("deep", "x/deep"), "d": ("none", None)}
    assert {f: v for (e, f), v in got.items() if e == "diamond"} == {"a": ("base", "base"), "b": ("base", "base"), "c": ("deep", "x/deep"), "d": ("own", "diamond")}
    assert {f: v for (e, f), v in got.items() if e == "x/in"} == {"a": ("deep", "x/deep"), "c": ("deep", "x/deep"), "d": ("none", None)}
