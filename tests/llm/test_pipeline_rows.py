"""The pipeline's verdicts take effect by row: null ids, repeated rows, one id with two texts."""

from __future__ import annotations

import random
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stage(spark, name, rows):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    out = dict(pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_exact_verdicts_by_row(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (3, "unlike"), (4, "c d"), (4, "a b"), (None, "zz"), (None, "zz"), (5, "p q"), (5, "p  q")]
    assert stage(spark, "exact_dedup", rows) == Counter([(3, "a b"), (3, "unlike"), (4, "c d"), (None, "zz"), (5, "p  q")])


def test_near_verdicts_by_row(spark):
    base, other, third = words(1), words(2), words(3)
    near = base[:-1] + ["changed"]
    a, b, c, d = (" ".join(x) for x in (base, near, other, third))
    rows = [(1, a), (2, b), (2, c), (None, b + " end"), (None, d), (None, d + " more")]
    got = stage(spark, "near_dedup", rows)
    assert got - Counter([(None, d), (None, d + " more")]) == Counter([(1, a), (2, c)])
    assert sum(got.values()) == 3


def test_suffix_cuts_by_row(spark):
    shared = " ".join(words(4, 30))
    one, two = "first text " + " ".join(words(5, 40)), "zz " + " ".join(words(6, 40))
    rows = [(1, shared), (2, one), (2, two + " | " + shared), (None, "nothing " + shared)]
    got = {t for _, t in stage(spark, "suffix_dedup", rows)}
    assert shared in got and one in got
    assert sum(shared in t for t in got) == 1
    assert any(t.startswith(two) for t in got)
