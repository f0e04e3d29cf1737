"""Queries over chains of tables and token rows, made from lineitem, orders, customer and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage, materialize
from ..operators.candidates import candidate_counts, candidates
from ..operators.lineage import Chain, Derived
from ..operators.stages import fresh_folder
from .reviews import read

C = F.col
MONEY = "decimal(18,2)"


def _tables(spark, d):
    lines = lambda _: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", C("l_extendedprice").cast(MONEY).alias("price"))
    buyers = lambda _: read(spark, d, "orders").select("o_orderkey", "o_custkey")
    totals = lambda t: t["lines"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    spent = lambda t: t["order_totals"].join(t["buyers"], C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
    classes = lambda t: t["customer_totals"].groupBy((F.floor(F.log10(C("total").cast("double")))).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
    return [Derived("lines", ("l_orderkey", "l_linenumber"), (), lines), Derived("buyers", ("o_orderkey",), (), buyers), Derived("order_totals", ("l_orderkey",), ("lines",), totals), Derived("customer_totals", ("o_custkey",), ("order_totals", "buyers"), spent), Derived("classes", ("class",), ("customer_totals",), classes)]


def tampered_lineage(spark, d):
    """A chain in which the dearest line is changed, the best customer is gone, and the last manifest pins other rows."""
    chain = Chain(spark, fresh_folder(spark, "lineage"), _tables(spark, d))
    chain.write()
    other = Chain(spark, fresh_folder(spark, "lineage"), _tables(spark, d))
    for t in chain.tables:
        rows = chain.stored(t.name)
        if t.name == "lines":
            most = rows.agg(F.max("price").alias("most"))
            rows = rows.join(F.broadcast(most)).withColumn("price", F.when(C("price") == C("most"), C("price") + 1).otherwise(C("price")).cast(MONEY)).drop("most")
        if t.name == "customer_totals":
            most = rows.agg(F.max("total").alias("most"))
            rows = rows.join(F.broadcast(most)).where("total < most").drop("most")
        other.put_rows(t.name, rows)
        held = chain.manifest(t.name)
        other.put_manifest(t.name, held["digest"], {s: "0" if t.name == "classes" else p for s, p in held["sources"].items()})
    return other.verify()


LIMIT = 90


def _tokens(role, content):
    """A mark of the role, and a number for each word."""
    words = F.transform(F.regexp_extract_all(content, F.lit(r"\S+"), F.lit(0)), lambda w: (F.length(w) * 1000 + F.ascii(w)).cast("long"))
    return F.concat(F.array(F.ascii(role).cast("long")), words)


def _messages(spark, d):
    c = linkage.ordinals(read(spark, d, "conversations"), "conv_id", ["turn"])
    return c.select("conv_id", "ordinal", F.when(F.length("text") % 41 == 0, "narrator").otherwise(C("role")).alias("role"), F.when(F.length("text") % 37 != 0, C("text")).alias("content"))


def _shown(column):
    return F.md5(F.array_join(column, ","))


def _examples(spark, d):
    return materialize.examples(_messages(spark, d), "conv_id", LIMIT, _tokens)


def materialized_examples(spark, d):
    return _examples(spark, d).withColumns({"ids": _shown(C("ids")), "labels": _shown(C("labels"))})


def _pairs(spark, d):
    """Conversations up to their last turn of the assistant, against the same context with the answer of the next conversation, or,
    where that is longer, with its first turn as context."""
    m = _messages(spark, d)
    ends = m.where("role = 'assistant'").groupBy("conv_id").agg(F.max("ordinal").alias("end"))
    chosen = m.join(ends, "conv_id").where("ordinal <= end")
    answer = chosen.where("ordinal = end").select((C("conv_id") - 1).alias("conv_id"), C("end").alias("their_end"), C("role").alias("their_role"), C("content").alias("their_content"))
    rejected = chosen.join(answer, "conv_id")
    swapped = F.when(C("ordinal") == C("end"), C("their_content")).when((C("their_end") > C("end")) & (C("ordinal") == 0), C("their_content")).otherwise(C("content"))
    rejected = rejected.select(F.concat(F.lit("r"), C("conv_id").cast("string")).alias("branch"), "ordinal", "role", swapped.alias("content"))
    branches = chosen.select(F.concat(F.lit("c"), C("conv_id").cast("string")).alias("branch"), "ordinal", "role", "content").unionByName(rejected)
    wanted = ends.select("conv_id", F.concat(F.lit("c"), C("conv_id").cast("string")).alias("chosen"), F.concat(F.when(C("conv_id") % 25 == 24, "c").otherwise("r"), C("conv_id").cast("string")).alias("rejected"))
    return materialize.pairs(wanted, branches, "conv_id", LIMIT, _tokens)


def materialized_pairs(spark, d):
    return _pairs(spark, d).withColumns({c: _shown(C(c)) for c in ("chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels")})


SUMS = {"tokens": "length", "supervised": "n_supervised"}


def miscounted_examples(spark, d):
    """Counts of the examples against those of a manifest that knows nothing of the limit."""
    declared = materialize.recounted(materialize.examples(_messages(spark, d), "conv_id", 1 << 30, _tokens), SUMS)
    return materialize.miscounted(declared, _examples(spark, d), SUMS)


def _candidates(spark, d):
    """Documents as runs, judged by what their texts hold, and labels as reviews; documents without a label are not reviewed."""
    t, n = C("text"), F.length("text")
    runs = read(spark, d, "documents").select(
        "doc_id",
        F.when(C("source").isin("src0", "src1"), "scripted").otherwise("model").alias("policy_type"),
        F.when(C("lang") == "fr", "heldout").otherwise("train").alias("split"),
        F.contains(t, F.lit("@")).alias("leaked"),
        F.contains(t, F.lit("###")).alias("failed"),
        F.when(n < 200, "incomplete").otherwise("complete").alias("detection"),
        F.when(n > 6000, "confirmed").when(n > 2500, "ambiguous").otherwise("not_detected").alias("finding"),
        (n % 2 == 0).alias("task_success"),
        F.when(n % 7 != 0, C("source")).alias("agent_id"),
        F.when(n % 9 != 0, C("lang")).alias("run_status"),
    )
    labels = read(spark, d, "labels").select("doc_id", "quality", "toxic")
    decision = F.when(C("toxic") == 1, F.when(C("quality") == 1, "needs_followup").otherwise("unclear")).when(C("quality") == 1, "accepted").when(C("quality") == 0, "rejected")
    reviews = read(spark, d, "documents").select("doc_id", "n_chars", n.alias("size")).join(labels, "doc_id", "left")
    hack = F.when(C("size").between(2501, 4000) & (C("quality") == 1), F.when(C("size") < 3000, "cleared").when(C("size") < 3500, "confirmed").otherwise("unclear"))
    reviews = reviews.select("doc_id", F.when(C("quality").isNull(), "not_reviewed").otherwise("reviewed").alias("status"), decision.alias("decision"), hack.alias("hack_decision"))
    return candidates(runs, reviews, "doc_id", ["agent_id", "run_status"], "model", ("heldout",))


def training_candidates(spark, d):
    return _candidates(spark, d).withColumn("missing", F.array_join("missing", ","))


def training_candidate_counts(spark, d):
    return candidate_counts(_candidates(spark, d))


QUERIES = {f.__name__: f for f in (tampered_lineage, materialized_examples, materialized_pairs, miscounted_examples, training_candidates, training_candidate_counts)}

_M = """m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, CASE WHEN length(text) % 41 = 0 THEN 'narrator' ELSE role END AS role, CASE WHEN length(text) % 37 <> 0 THEN text END AS content FROM conversations)"""
_T = """list_concat([unicode(role)::BIGINT], list_transform(regexp_extract_all(content, '\\S+'), lambda w: length(w) * 1000 + unicode(w)))"""
_E = f"""{_M}, t AS (SELECT *, CASE WHEN content IS NOT NULL THEN {_T} END AS ids FROM m),
    g AS (SELECT conv_id, bool_or(role = 'narrator') AS strange, bool_or(content IS NULL) AS no_content, bool_or(role = 'assistant') AS answered, coalesce(sum(len(ids)), 0)::BIGINT AS length, coalesce(sum(len(ids)) FILTER (role = 'assistant'), 0)::BIGINT AS n_supervised,
        md5(array_to_string(flatten(list(ids ORDER BY ordinal)), ',')) AS ids, md5(array_to_string(flatten(list(CASE WHEN role = 'assistant' THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY ordinal)), ',')) AS labels FROM t GROUP BY conv_id),
    e AS (SELECT *, CASE WHEN strange THEN 'unknown role' WHEN no_content THEN 'no content' WHEN NOT answered THEN 'no assistant' END AS error FROM g)"""
_SUMS = """SELECT 'rows' AS name, count(*) AS n FROM {0} UNION ALL SELECT 'tokens', coalesce(sum(length) FILTER (ok), 0)::BIGINT FROM {0} UNION ALL SELECT 'supervised', coalesce(sum(n_supervised) FILTER (ok), 0)::BIGINT FROM {0}
    UNION ALL SELECT 'status ' || CASE WHEN ok THEN 'completed' ELSE 'failed' END, count(*) FROM {0} GROUP BY 1 UNION ALL SELECT 'failure ' || CASE WHEN error IS NULL THEN 'sequence_length_exceeded' ELSE 'materialization_error' END, count(*) FROM {0} WHERE NOT ok GROUP BY 1"""
_CANDIDATES = """WITH d AS (SELECT doc_id, text, source, lang, length(text) AS n, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    e AS (SELECT *, CASE WHEN n > 6000 THEN 'confirmed' WHEN n > 2500 THEN 'ambiguous' ELSE 'none' END AS finding, CASE WHEN n > 2500 AND n <= 4000 AND quality = 1 THEN CASE WHEN n < 3000 THEN 'cleared' WHEN n < 3500 THEN 'confirmed' ELSE 'unclear' END END AS hack,
        concat_ws(',', CASE WHEN n % 7 = 0 OR n IS NULL OR source IS NULL THEN 'agent_id' END, CASE WHEN n % 9 = 0 OR n IS NULL OR lang IS NULL THEN 'run_status' END) AS missing FROM d),
    b AS (SELECT *, CASE WHEN quality IS NULL THEN 'not reviewed' WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'review asks for more' ELSE 'not accepted in review' END WHEN quality = 0 THEN 'rejected in review' END AS review,
        CASE WHEN source IN ('src0', 'src1') THEN 'not from a model' WHEN lang = 'fr' THEN 'split kept out of training' WHEN contains(text, '@') THEN 'leak in what the model saw' WHEN contains(text, '###') THEN 'orchestration failed' WHEN n < 200 THEN 'detection not complete'
            WHEN missing <> '' THEN 'evidence missing: ' || replace(missing, ',', ', ') END AS common FROM e),
    g AS (SELECT *, coalesce(review, common, CASE WHEN finding = 'ambiguous' AND hack IS NULL THEN 'ambiguous finding without adjudication' END) AS gate FROM b),
    p AS (SELECT *, coalesce(gate, CASE WHEN hack = 'confirmed' THEN 'finding confirmed in review' WHEN finding = 'confirmed' THEN 'confirmed finding' WHEN finding = 'ambiguous' AND coalesce(hack, '') <> 'cleared' THEN 'ambiguous finding not cleared' END) AS pos, coalesce(gate, CASE WHEN n % 2 = 0 THEN 'the run succeeded' END) AS neg FROM g),
    o AS (SELECT doc_id, missing, pos IS NULL AS positive, coalesce(pos, 'accepted review, nothing against it as an example') AS positive_reason, neg IS NULL AS negative, coalesce(neg, 'accepted review, nothing against it as a counterexample') AS negative_reason,
        common IS NULL AS preference, coalesce(common, 'the evidence of the run can be trusted') AS preference_reason, pos IS NULL OR neg IS NULL OR common IS NULL AS downstream, NOT (pos IS NULL OR neg IS NULL OR common IS NULL) AND review IS NULL AS analysis_only, NOT (pos IS NULL OR neg IS NULL OR common IS NULL) AND review IS NOT NULL AS closed FROM p)"""
SQL = {
    "tampered_lineage": """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS price FROM lineitem),
        hit AS (SELECT * FROM l WHERE price = (SELECT max(price) FROM l)),
        o AS (SELECT l_orderkey, sum(price) AS total FROM l GROUP BY 1), c AS (SELECT o_custkey, sum(total) AS total FROM o JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
        best AS (SELECT o_custkey, floor(log10(total::DOUBLE))::BIGINT AS class FROM c WHERE total = (SELECT max(total) FROM c))
        SELECT 'lines' AS "table", 'rows differ from the manifest' AS problem, NULL AS key, NULL::BIGINT AS n UNION ALL SELECT 'customer_totals', 'rows differ from the manifest', NULL, NULL UNION ALL SELECT 'classes', 'pins other rows of customer_totals', NULL, NULL
        UNION ALL SELECT 'lines', 'changed', min('["' || l_orderkey || '","' || l_linenumber || '"]'), count(DISTINCT (l_orderkey, l_linenumber)) FROM hit
        UNION ALL SELECT 'order_totals', 'changed', min('["' || l_orderkey || '"]'), count(DISTINCT l_orderkey) FROM hit
        UNION ALL SELECT 'customer_totals', 'missing', min('["' || o_custkey || '"]'), count(*) FROM best
        UNION ALL SELECT 'classes', CASE WHEN (SELECT count(*) FROM c WHERE floor(log10(total::DOUBLE)) = any_value(class)) = count(*) THEN 'surplus' ELSE 'changed' END, min('["' || class || '"]'), count(DISTINCT class) FROM best""",
    "materialized_examples": f"""WITH {_E} SELECT conv_id, CASE WHEN error IS NULL AND length <= 90 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NOT NULL THEN 'materialization_error' WHEN length > 90 THEN 'sequence_length_exceeded' END AS failure_kind,
        CASE WHEN error IS NOT NULL THEN error WHEN length > 90 THEN length || ' tokens of 90' END AS error, CASE WHEN error IS NULL AND length > 90 THEN length END AS observed_length, CASE WHEN error IS NULL AND length <= 90 THEN length END AS length,
        CASE WHEN error IS NULL AND length <= 90 THEN n_supervised END AS n_supervised, CASE WHEN error IS NULL AND length <= 90 THEN length - n_supervised END AS n_ignored, CASE WHEN error IS NULL AND length <= 90 THEN ids END AS ids, CASE WHEN error IS NULL AND length <= 90 THEN labels END AS labels FROM e""",
    "materialized_pairs": f"""WITH {_M}, ends AS (SELECT conv_id, max(ordinal) AS e FROM m WHERE role = 'assistant' GROUP BY 1),
        ch AS (SELECT m.*, e FROM m JOIN ends USING (conv_id) WHERE ordinal <= e), an AS (SELECT conv_id - 1 AS conv_id, e AS their_e, content AS theirs FROM ch WHERE ordinal = e),
        br AS (SELECT 'c' || conv_id AS branch, ordinal, e, role, content FROM ch UNION ALL SELECT 'r' || conv_id, ordinal, e, role, CASE WHEN ordinal = e OR (their_e > e AND ordinal = 0) THEN theirs ELSE content END FROM ch JOIN an USING (conv_id)),
        t AS (SELECT *, CASE WHEN content IS NOT NULL THEN {_T} END AS ids FROM br),
        b AS (SELECT branch, CASE WHEN bool_or(role = 'narrator') THEN 'unknown role' WHEN bool_or(content IS NULL) THEN 'no content' END AS error, coalesce(sum(len(ids)), 0)::BIGINT AS length, coalesce(sum(len(ids)) FILTER (ordinal < e), 0)::BIGINT AS n_prompt,
            flatten(list(ids ORDER BY ordinal)) AS ids, flatten(list(CASE WHEN ordinal = e THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY ordinal)) AS labels FROM t GROUP BY branch),
        p AS (SELECT conv_id, x.length AS cl, y.length AS rl, x.n_prompt, x.ids AS ci, y.ids AS ri, x.labels AS cb, y.labels AS rb,
            CASE WHEN x.error IS NOT NULL THEN 'chosen: ' || x.error WHEN y.branch IS NULL THEN 'rejected: branch unknown' WHEN y.error IS NOT NULL THEN 'rejected: ' || y.error WHEN greatest(x.length, y.length) > 90 THEN NULL WHEN x.ids[:x.n_prompt] <> y.ids[:y.n_prompt] THEN 'prompts differ' WHEN x.ids = y.ids THEN 'responses equal' END AS error
            FROM ends JOIN b x ON x.branch = 'c' || conv_id LEFT JOIN b y ON y.branch = CASE WHEN conv_id % 25 = 24 THEN 'c' ELSE 'r' END || conv_id),
        s AS (SELECT *, error IS NULL AND greatest(cl, rl) > 90 AS long, error IS NULL AND greatest(cl, rl) <= 90 AS ok FROM p)
        SELECT conv_id, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status, CASE WHEN long THEN 'sequence_length_exceeded' WHEN NOT ok THEN 'materialization_error' END AS failure_kind, CASE WHEN long THEN cl || ' and ' || rl || ' tokens of 90' ELSE error END AS error,
            CASE WHEN long THEN cl END AS observed_chosen, CASE WHEN long THEN rl END AS observed_rejected, CASE WHEN ok THEN n_prompt END AS n_prompt, CASE WHEN ok THEN cl END AS chosen_length, CASE WHEN ok THEN rl END AS rejected_length,
            CASE WHEN ok THEN md5(array_to_string(ci, ',')) END AS chosen_ids, CASE WHEN ok THEN md5(array_to_string(cb, ',')) END AS chosen_labels, CASE WHEN ok THEN md5(array_to_string(ri, ',')) END AS rejected_ids, CASE WHEN ok THEN md5(array_to_string(rb, ',')) END AS rejected_labels FROM s""",
    "miscounted_examples": f"""WITH {_E}, x AS (SELECT *, error IS NULL AND length <= 90 AS ok FROM e), y AS (SELECT *, error IS NULL AS ok FROM e), counted AS ({_SUMS.format("x")}), declared AS ({_SUMS.format("y")})
        SELECT name, coalesce(declared.n, 0) AS declared, coalesce(counted.n, 0) AS counted FROM counted FULL JOIN declared USING (name) WHERE coalesce(declared.n, 0) <> coalesce(counted.n, 0)""",
    "training_candidates": f"{_CANDIDATES} SELECT * FROM o",
    "training_candidate_counts": f"{_CANDIDATES} SELECT count(*) AS n, count_if(positive)::BIGINT AS n_positive, count_if(negative)::BIGINT AS n_negative, count_if(preference)::BIGINT AS n_preference, count_if(downstream)::BIGINT AS n_downstream, count_if(analysis_only)::BIGINT AS n_analysis_only, count_if(closed)::BIGINT AS n_closed FROM o",
}
