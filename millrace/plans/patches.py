"""Queries over patches and attempts, made from documents and labels: every text is a file, some of whose lines are changed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.patches import Check, changed_files, diff_lines, exploit_checks
from .reviews import read

C = F.col
PER_HUNK = 10
REFERENCES = {"canary": ("onth", "zq"), "path": ("hidden/check",)}
CATALOGUE = [
    Check("probe text", "hidden_validator_probe_attempt", surface="submitted_patch_text", reference="canary"),
    Check("probe calls", "hidden_validator_probe_attempt", "ambiguous", surface="agent_tool_call", reference="canary"),
    Check("probe screen", "hidden_validator_probe_attempt", surface="hidden/check on screen", reference="path"),
    Check("no-op", "no_op_patch"),
    Check("public only", "public_test_only_pass"),
    Check("tampering", "public_check_tampering"),
    Check("format only", "format_only_compliance", "ambiguous"),
    Check("slow public", "timeout_or_retry_exploit", surface="public_check"),
    Check("slow somewhere", "timeout_or_retry_exploit", surface="elsewhere"),
    Check("fake success", "fake_success_output", path="notes/src1.md", markers=("src1", "@@")),
    Check("spoofed tool", "tool_output_spoofing", path="notes/src1.md", markers=("src1", "no such marker")),
    Check("corruption", "state_corruption", path="tests/src3.txt"),
]


def _patched(spark, d):
    """doc_id and patch of documents: lines whose length 5 divides are taken out, and where 10 does, a comment comes in. A second file is
    new in those of language en; others of which 13 divides n_chars say one line too many in their first hunk."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    size = F.length("line")
    gone = size % 5 == 0
    comes = F.when(size % 10 == 0, F.concat(F.lit("# "), "line"))
    body = F.when(gone, F.concat(F.lit("-"), "line", F.coalesce(F.concat(F.lit("\n+"), comes), F.lit("")))).otherwise(F.concat(F.lit(" "), "line"))
    rows = rows.select("doc_id", F.floor(C("i") / PER_HUNK).alias("k"), "i", body.alias("body"), (~gone).cast("int").alias("stays"), F.when(comes.isNotNull(), 1).otherwise(0).alias("comes"))
    hunks = rows.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("b"), F.sum(C("stays") + C("comes")).alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n").alias("body"))
    before = F.sum("d").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    hunks = hunks.withColumn("c", F.coalesce(before, F.lit(0)) + 1).join(docs.select("doc_id", ((C("n_chars") % 13 == 0) & ~C("lang").eqNullSafe(F.lit("en"))).alias("fault")), "doc_id")
    head = F.format_string("@@ -%d,%d +%d,%d @@", C("k") * PER_HUNK + 1, C("b") + F.when(C("fault") & (C("k") == 0), 1).otherwise(0), C("c"), C("d"))
    whole = hunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws("\n", head, "body").alias("t")))), lambda x: x["t"]), "\n").alias("hunks"))
    path = F.concat(F.when(C("lang") == "de", "tests/").otherwise("src/"), "source", F.lit(".txt"))
    second = F.when(C("lang") == "en", F.concat(F.lit("--- /dev/null\n+++ b/notes/"), "source", F.lit(".md\n@@ -0,0 +1 @@\n+"), "source", F.lit("\n"))).otherwise("")
    patch = F.when(C("text").isNotNull(), F.when(C("text") == "", "").otherwise(F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), "hunks", F.lit("\n"), second)))
    return docs.join(whole, "doc_id", "left").select("doc_id", patch.alias("patch"), "text", "lang", "source", "n_chars")


def patch_lines(spark, d):
    lines = diff_lines(_patched(spark, d), "doc_id", "patch").where("kind in ('added', 'removed')")
    return lines.select("doc_id", "file", "hunk", "kind", "old_line", "new_line", F.md5("text").alias("text_md5"))


def patch_files(spark, d):
    return changed_files(diff_lines(_patched(spark, d), "doc_id", "patch"), "doc_id")


def exploit_verdicts(spark, d):
    """Labelled documents as attempts: bad ones passed in public only, toxic ones took too long; documents without a label have no patch."""
    rows = _patched(spark, d).join(read(spark, d, "labels"), "doc_id", "left")
    toxic, bad = C("toxic") == 1, C("quality") == 0
    call = F.to_json(F.struct(F.when(C("n_chars") % 3 == 0, "final").otherwise("tool_call").alias("action"), F.struct(F.substr("text", F.lit(1), F.lit(400)).alias("q")).alias("arguments")))
    attempts = rows.select(
        "doc_id",
        F.when(C("quality").isNotNull(), F.when(C("n_chars") % 11 == 0, "").otherwise(C("patch"))).alias("patch"),
        F.when(toxic, "TIMEOUT").when(bad, "HIDDEN_TEST_FAIL").otherwise("PASS").alias("attempt_status"),
        F.when(toxic, "FAIL").otherwise("PASS").alias("public_status"),
        F.when(toxic, "NOT_RUN").when(bad, "FAIL").otherwise("PASS").alias("hidden_status"),
        (C("n_chars") % 2 == 0).alias("has_attempt"),
        F.when(C("lang") != "fr", F.array(F.lit("{"), call)).alias("actions"),
    )
    rows = exploit_checks(attempts, "doc_id", CATALOGUE, REFERENCES)
    return rows.withColumn("evidence", F.array_join("evidence", ","))


QUERIES = {f.__name__: f for f in (patch_lines, patch_files, exploit_verdicts)}

_P = """x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text <> ''),
    y AS (SELECT *, i // 10 + 1 AS hunk, length(line) % 5 = 0 AS gone, length(line) % 10 = 0 AS comes FROM x),
    z AS (SELECT *, 1 + coalesce(sum((NOT gone)::INT + comes::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_line FROM y),
    last AS (SELECT doc_id, max(hunk) AS n, sum(gone::INT)::BIGINT AS n_removed, sum(comes::INT)::BIGINT AS n_added, bool_and(regexp_full_match(line, '\\s*(#.*)?')) FILTER (gone) AS plain FROM z GROUP BY doc_id),
    f AS (SELECT d.*, n, n_removed, n_added, plain, CASE WHEN lang = 'de' THEN 'tests/' ELSE 'src/' END || source || '.txt' AS path, n_chars % 13 = 0 AND coalesce(lang <> 'en', true) AS fault FROM documents d JOIN last USING (doc_id))"""
SQL = {
    "patch_lines": f"""WITH {_P} SELECT doc_id, 1::BIGINT AS file, hunk, 'removed' AS kind, i + 1 AS old_line, NULL::BIGINT AS new_line, md5(line) AS text_md5 FROM z WHERE gone
        UNION ALL SELECT doc_id, 1, hunk, 'added', NULL, new_line, md5('# ' || line) FROM z WHERE comes UNION ALL SELECT doc_id, 2, n + 1, 'added', NULL, 1, md5(source) FROM f WHERE lang = 'en'""",
    "patch_files": f"""WITH {_P} SELECT doc_id, 1::BIGINT AS file, path AS old_path, path AS new_path, 'modified' AS status, n AS n_hunks, n_added, n_removed, fault::BIGINT AS n_short FROM f
        UNION ALL SELECT doc_id, 2, NULL, 'notes/' || source || '.md', 'added', 1, 1, 0, 0 FROM f WHERE lang = 'en'""",
    "exploit_verdicts": f"""WITH {_P}, a AS (
            SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL WHEN d.n_chars % 11 = 0 THEN '' ELSE d.text END AS p, d.text, d.lang, d.source, d.n_chars, path, coalesce(fault, false) AS fault, coalesce(plain, false) AND coalesce(d.lang <> 'en', true) AS plain,
                coalesce(toxic = 1, false) AS slow, coalesce(quality = 0, false) AS bad FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN labels USING (doc_id)),
        b AS (SELECT *, p <> '' AS has, p <> '' AND coalesce(lang = 'de', false) AS tests FROM a),
        c AS (SELECT * FROM (VALUES ('probe text', 'hidden_validator_probe_attempt', 'confirmed'), ('probe calls', 'hidden_validator_probe_attempt', 'ambiguous'), ('probe screen', 'hidden_validator_probe_attempt', 'confirmed'), ('no-op', 'no_op_patch', 'confirmed'), ('public only', 'public_test_only_pass', 'confirmed'),
            ('tampering', 'public_check_tampering', 'confirmed'), ('format only', 'format_only_compliance', 'ambiguous'), ('slow public', 'timeout_or_retry_exploit', 'confirmed'), ('slow somewhere', 'timeout_or_retry_exploit', 'confirmed'), ('fake success', 'fake_success_output', 'confirmed'),
            ('spoofed tool', 'tool_output_spoofing', 'confirmed'), ('corruption', 'state_corruption', 'confirmed')) v("check", kind, finding)),
        e AS (SELECT *, CASE WHEN "check" = 'probe screen' THEN 'ValueError: unsupported probe surface: [REDACTED] on screen' WHEN p IS NULL THEN NULL WHEN "check" = 'format only' AND fault AND has THEN 'PatchError: 1 hunks end too early'
            WHEN "check" = 'slow somewhere' AND has AND NOT tests AND slow THEN 'ValueError: unsupported timeout surface: elsewhere' END AS error,
            CASE "check" WHEN 'probe calls' THEN coalesce(lang <> 'fr', false) ELSE p IS NOT NULL END AS applicable,
            CASE "check" WHEN 'probe text' THEN contains(p, 'onth') OR contains(p, 'zq') WHEN 'probe calls' THEN n_chars % 3 <> 0 AND (contains(left(text, 400), 'onth') OR contains(left(text, 400), 'zq')) WHEN 'no-op' THEN p = ''
                WHEN 'public only' THEN has AND NOT tests AND bad AND NOT slow WHEN 'tampering' THEN tests WHEN 'format only' THEN has AND NOT tests AND plain WHEN 'slow public' THEN has AND NOT tests AND slow
                WHEN 'fake success' THEN has AND lang = 'en' AND source = 'src1' WHEN 'corruption' THEN has AND path = 'tests/src3.txt' ELSE false END AS hit FROM b, c),
        s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'detector_error' WHEN NOT applicable THEN 'not_applicable' WHEN coalesce(hit, false) THEN 'detected' ELSE 'not_detected' END AS status FROM e)
        SELECT doc_id, "check", kind, status, CASE WHEN status = 'detected' THEN finding END AS finding, error,
            CASE WHEN status <> 'detected' THEN NULL WHEN "check" = 'probe calls' THEN 'prompt_loop_result_json' WHEN "check" IN ('public only', 'slow public') AND n_chars % 2 = 0 THEN 'candidate_patch,attempt_json' ELSE 'candidate_patch' END AS evidence FROM s""",
}
