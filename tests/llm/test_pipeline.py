"""The pipeline against plain implementations of its stages, each on its own input."""

from __future__ import annotations

import re

import numpy as np

from millrace.llm import language, suffix

from .test_nearjoin import plain as plain_groups


def test_stages(spark, small):
    import corpus_pipeline as pipeline

    base = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", 0), (9003, "", None, None, None)], base.schema)
    docs = base.unionByName(odd)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "best_fit_packing"]

    def step(name, df):
        out = stages[name](spark, df, small)
        assert out.columns == base.columns
        return out.cache()

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = step("language_id", docs)
    assert set(texts(docs)) - set(texts(one)) >= {9001, 9002, 9003}
    assert texts(one).items() <= texts(docs).items()
    scorer = language.Scorer(language.learn(docs))
    assert set(texts(one)) == {d for d, t in texts(docs).items() if (s := scorer.score([t])[0])[0] != "und" and s[1] >= 0.5 and s[2] >= 0.5}

    two = step("exact_dedup", one)
    best = {}
    for d, t in texts(one).items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (-len(t), d)), (-len(t), d))
    assert texts(two) == {d: texts(one)[d] for _, d in best.values()}

    three = step("near_dedup", two)
    assert texts(three) == {d: texts(two)[d] for d, (_, comp) in plain_groups(texts(two)).items() if d == comp}

    four = step("suffix_dedup", three)
    want, seen = {}, set()
    for d in sorted(texts(three)):
        raw = texts(three)[d].encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 99):
            gone[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        lo, hi = suffix.whole_characters(raw, edges[::2].tolist(), edges[1::2].tolist())
        kept = suffix.kept_pieces(raw, lo, hi).decode()
        if kept or not gone.any():
            want[d] = kept
    assert texts(four) == want
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect() if r["text"] != texts(three)[r["doc_id"]])

    last = stages["best_fit_packing"](spark, four, small)
    assert {r["doc_id"] for r in last.collect()} == set(want)
    run = pipeline.run(spark, small)
    assert run.columns == last.columns and run.count() > 0


def test_whole_characters():
    raw = "aéb😀c".encode()
    assert suffix.whole_characters(raw, [0, 5], [2, 9]) == ([0, 8], [1, 9])
    assert suffix.whole_characters(raw, [2, 5], [3, 7]) == ([], [])
