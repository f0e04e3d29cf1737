"""Review and eligibility queries over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.gates import eligibility, first_reason, missing_names, tri_state
from ..functions.hashing import derived_id, normalized_text
from ..functions.text import has_line, normalized_page, percentage, redacted
from ..operators.coverage import coverage, duplicate_keys, outer_diff
from ..operators.scan import containing
from ..operators.summaries import count_true, sum_known, sum_or_null, zero_filled


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gated(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(read(spark, d, "labels"), "doc_id", "left")


GATE = lambda: first_reason((F.col("quality").isNull(), "not reviewed"), (F.col("toxic") == 1, "blocked"), (F.col("quality") == 0, "rejected"))


def review_gate_counts(spark, d):
    return _gated(spark, d).groupBy("source", F.coalesce(GATE(), F.lit("eligible")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def eligibility_flags(spark, d):
    size = first_reason((F.col("n_chars") < 100, "too short"), (F.col("n_chars") > 20000, "too long"))
    lang = F.when(F.col("lang") != "en", "language")
    out = _gated(spark, d).select("doc_id", missing_names(quality=F.col("quality"), toxic=F.col("toxic")).alias("missing"), *eligibility("sft", GATE(), size, lang), *eligibility("preference", GATE(), size), *eligibility("negative", F.when(F.col("quality").isNull(), "not reviewed"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "succeeded")))
    path = F.col("sft_eligible") | F.col("preference_eligible") | F.col("negative_eligible")
    return out.withColumn("class", F.when(path, "downstream").otherwise("analysis only"))


def eligibility_counts(spark, d):
    e = eligibility_flags(spark, d)
    return e.agg(F.count(F.lit(1)).alias("n"), *(count_true(F.col(f"{k}_eligible")).alias(k) for k in ("sft", "preference", "negative")), count_true(F.col("class") == "downstream").alias("downstream"))


def tri_state_components(spark, d):
    j = _gated(spark, d)
    known = F.col("quality").isNotNull()
    ok, safe = tri_state(known, F.col("quality") == 1), tri_state(known, F.col("toxic") == 0)
    c = j.select("source", ok.alias("ok"), safe.alias("safe"))
    return c.groupBy("source").agg(count_true(F.col("ok")).alias("n_ok"), count_true(~F.col("ok")).alias("n_not_ok"), count_true(F.col("ok").isNull()).alias("n_unknown"), count_true(F.col("ok").eqNullSafe(F.col("safe"))).alias("n_agree"))


def null_sums(spark, d):
    return _gated(spark, d).groupBy("source", "lang").agg(sum_or_null(F.col("quality")).cast("long").alias("strict_sum"), sum_known(F.col("quality")).cast("long").alias("known_sum"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("zero_sum"))


def label_coverage(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "labels")
    return coverage(docs, labels, "doc_id", (F.col("l.n_chars") > 200) | (F.col("r.quality") == 0))


def duplicate_label_keys(spark, d):
    labels = read(spark, d, "labels").select("doc_id")
    again = labels.unionByName(labels.where("doc_id % 7 = 0")).unionByName(labels.where("doc_id % 21 = 0"))
    return duplicate_keys(again, "doc_id").select("doc_id", F.col("n").cast("long").alias("n"))


def review_rates(spark, d):
    j = _gated(spark, d).groupBy("lang").agg(F.count("quality").alias("n_reviewed"), count_true((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n_passed"))
    return j.select("lang", "n_passed", "n_reviewed", percentage(F.col("n_passed"), F.col("n_reviewed")).alias("rate"))


def zero_filled_gates(spark, d):
    j = _gated(spark, d).withColumn("gate", F.coalesce(GATE(), F.lit("eligible")))
    return zero_filled(j, "source", "gate", ["eligible", "rejected", "blocked", "not reviewed", "withdrawn"])


def customer_snapshot_diff(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    old = c.where("c_mktsegment <> 'BUILDING'")
    new = c.where("c_mktsegment <> 'HOUSEHOLD'").select("c_custkey", F.when(F.expr("c_custkey % 6 = 0"), "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.expr("c_custkey % 4 = 0"), None).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    return outer_diff(old, new, "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")


def benchmark_containment(spark, d):
    return containing(read(spark, d, "documents").select("doc_id", "text"), "doc_id", read(spark, d, "benchmark"), "item_id")


def normalized_duplicates(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(normalized_text(F.col("text"))).alias("h"))
    return docs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def evidence_reuse(spark, d):
    g = read(spark, d, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), count_true(F.col("n") > 1).alias("n_reused"))


def line_predicates(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", has_line(t, "The ").alias("has_the_line"), has_line(t, "[A-Z]+!!").alias("has_shout"), F.contains(t, F.lit(" | ")).alias("has_table"), (F.trim(t) == "").alias("is_blank"))


def page_normalized(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(normalized_page(F.col("html"))).alias("page_md5"))


def redacted_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(redacted(F.col("text"), 1000)).alias("text_md5"), (F.length("text") > 1000).alias("was_cut"))


def derived_ids(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", derived_id("ctx", F.col("lang"), F.col("source")).alias("context_id"), derived_id("ev", F.col("doc_id"), F.col("lang")).alias("evidence_id"))


_GATED = "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
_REASON = "CASE WHEN quality IS NULL THEN 'not reviewed' WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'rejected' END"
_SIZE = "CASE WHEN n_chars < 100 THEN 'too short' WHEN n_chars > 20000 THEN 'too long' END"
_FLAGS = f"""
SELECT *, CASE WHEN sft_eligible OR preference_eligible OR negative_eligible THEN 'downstream' ELSE 'analysis only' END AS class FROM (
  SELECT doc_id, missing, sft_reason IS NULL AS sft_eligible, sft_reason, preference_reason IS NULL AS preference_eligible, preference_reason,
         negative_reason IS NULL AS negative_eligible, negative_reason FROM (
    SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing,
           coalesce({_REASON}, {_SIZE}, CASE WHEN lang <> 'en' THEN 'language' END) AS sft_reason,
           coalesce({_REASON}, {_SIZE}) AS preference_reason,
           CASE WHEN quality IS NULL THEN 'not reviewed' WHEN quality = 1 AND toxic = 0 THEN 'succeeded' END AS negative_reason
    FROM ({_GATED})))
"""

QUERIES = {f.__name__: f for f in (review_gate_counts, eligibility_flags, eligibility_counts, tri_state_components, null_sums, label_coverage, duplicate_label_keys, review_rates, zero_filled_gates, customer_snapshot_diff, benchmark_containment, normalized_duplicates, evidence_reuse, line_predicates, page_normalized, redacted_texts, derived_ids)}

SQL = {
    "review_gate_counts": f"SELECT source, coalesce({_REASON}, 'eligible') AS gate, count(*) AS n FROM ({_GATED}) GROUP BY ALL",
    "eligibility_flags": _FLAGS,
    "eligibility_counts": f"SELECT count(*) AS n, count_if(sft_eligible)::BIGINT AS sft, count_if(preference_eligible)::BIGINT AS preference, count_if(negative_eligible)::BIGINT AS negative, count_if(class = 'downstream')::BIGINT AS downstream FROM ({_FLAGS})",
    "tri_state_components": f"""SELECT source, count_if(quality = 1)::BIGINT AS n_ok, count_if(quality <> 1)::BIGINT AS n_not_ok, count_if(quality IS NULL)::BIGINT AS n_unknown,
        count_if((quality = 1) IS NOT DISTINCT FROM (CASE WHEN quality IS NOT NULL THEN toxic = 0 END))::BIGINT AS n_agree FROM ({_GATED}) GROUP BY source""",
    "null_sums": f"SELECT source, lang, CASE WHEN count(*) = count(quality) THEN sum(quality)::BIGINT END AS strict_sum, sum(quality)::BIGINT AS known_sum, coalesce(sum(toxic), 0)::BIGINT AS zero_sum FROM ({_GATED}) GROUP BY ALL",
    "label_coverage": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown'
        WHEN NOT coalesce(d.n_chars > 200 OR l.quality = 0, false) THEN 'mismatch' ELSE 'matched' END AS status FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    "duplicate_label_keys": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 21 = 0) GROUP BY doc_id HAVING count(*) > 1",
    "review_rates": f"""SELECT lang, n_passed, n_reviewed, CASE WHEN n_reviewed = 0 THEN '' ELSE n_passed || '/' || n_reviewed || ' (' || CAST(round(100 * n_passed::DECIMAL(20,0) / n_reviewed, 1) AS DECIMAL(10,1)) || '%)' END AS rate
        FROM (SELECT lang, count(quality) AS n_reviewed, count_if(quality = 1 AND toxic = 0)::BIGINT AS n_passed FROM ({_GATED}) GROUP BY lang)""",
    "zero_filled_gates": f"""SELECT source, status, count_if(gate = status)::BIGINT AS n FROM (SELECT source, coalesce({_REASON}, 'eligible') AS gate FROM ({_GATED}))
        CROSS JOIN (VALUES ('eligible'), ('rejected'), ('blocked'), ('not reviewed'), ('withdrawn')) v(status) GROUP BY ALL""",
    "customer_snapshot_diff": """WITH o AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment,
          CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, c_nationkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
        j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_custkey AS a, n.c_custkey AS b, concat_ws(',', CASE WHEN o.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'c_mktsegment' END,
          CASE WHEN o.c_acctbal IS DISTINCT FROM n.c_acctbal THEN 'c_acctbal' END, CASE WHEN o.c_nationkey IS DISTINCT FROM n.c_nationkey THEN 'c_nationkey' END) AS f FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
        SELECT c_custkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN f <> '' THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN f ELSE '' END AS fields FROM j""",
    "benchmark_containment": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "normalized_duplicates": r"SELECT md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "evidence_reuse": "SELECT source, count(*) AS n_groups, max(n) AS largest, count_if(n > 1)::BIGINT AS n_reused FROM (SELECT source, md5(text) AS h, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
    "line_predicates": r"SELECT doc_id, regexp_matches(text, '(^|\n)The ') AS has_the_line, regexp_matches(text, '(^|\n)[A-Z]+!!') AS has_shout, contains(text, ' | ') AS has_table, trim(text) = '' AS is_blank FROM documents",
    "page_normalized": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'),
        'https?://[^\s"''<>]+', '{url}', 'g'), '</?[a-zA-Z][^>]*>', '{tag}', 'g'), '[0-9]+', '{n}', 'g'), '[ \t\n]+', ' ', 'g'))) AS page_md5 FROM pages""",
    "redacted_texts": "SELECT doc_id, md5(substr(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '{email}', 'g'), 1, 1000)) AS text_md5, length(text) > 1000 AS was_cut FROM documents",
    "derived_ids": r"SELECT doc_id, 'ctx_' || substr(md5(concat_ws(chr(31), coalesce(lang, '<null>'), coalesce(source, '<null>'))), 1, 32) AS context_id, 'ev_' || substr(md5(concat_ws(chr(31), doc_id::VARCHAR, coalesce(lang, '<null>'))), 1, 32) AS evidence_id FROM documents",
}
