"""Suffix deduplication against a plain search for repeated strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix


def plain(texts: dict[int, str], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            part = raw[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def odd_texts() -> dict[int, str]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(7))
    passage = "".join(word() for _ in range(40))
    short = "".join(word() for _ in range(16))[:103]
    texts = {0: "", 1: "x" * 99, 2: "x" * 100, 3: "x" * 350, 4: "ab" * 200, 5: passage, 6: passage[50:] + passage[:160], 7: "x" * 5000}
    for i in range(8, 60):
        cut = rng.randrange(len(passage) - 120)
        texts[i] = "".join(word() for _ in range(rng.randrange(30))) + (passage[cut : cut + rng.randrange(90, 140)] if i % 3 else short) + "".join(word() for _ in range(rng.randrange(30)))
    for i in range(60, 75):
        base = list(texts[rng.randrange(8, 60)] * 2)
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice("xyz😀")
        texts[i] = "".join(base)
    return texts


@pytest.mark.parametrize("sorted_contexts", [2000, 2])
def test_against_plain_search(spark, sorted_contexts, monkeypatch):
    texts = odd_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5).withColumn("seed", F.lit(1)).withColumn("spans", F.lit("x"))
    rows = suffix.id_text(df)
    spans = suffix.merged_spans(suffix.repeated_spans(rows, sorted_contexts=sorted_contexts))
    got = results(rows.join(spans, "doc_id", "left").mapInArrow(suffix._digest_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
    assert got == plain(texts)
    assert results(suffix.suffix_dedup(df)) == plain(texts)


def test_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert results(suffix.suffix_dedup(docs)) == plain({r["doc_id"]: r["text"] or "" for r in docs.collect()})


def test_nulls_repeats_and_empty(spark):
    rows = spark.createDataFrame([(None, "y" * 300), (1, None), (2, "q" * 120), (2, "q" * 120)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.suffix_dedup(rows).collect()), key=str)
    assert got == sorted([(None, 300, 0), (1, 0, 0), (2, 120, 119), (2, 120, 119)], key=str)
    assert suffix.suffix_dedup(rows.limit(0)).collect() == []


def test_merge_sort_sorts_groups_stably():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    starts, group = rng.integers(0, 380, 300), np.sort(rng.integers(0, 6, 300))
    order = suffix.merge_sort(data, suffix.prefix_hashes(data), starts, group, 12)
    assert order.tolist() == sorted(range(300), key=lambda i: (group[i], data[starts[i] : starts[i] + 12].tobytes(), i))


def test_long_texts_come_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffix, "STEP_BYTES", 1000)
    parts = list(suffix._text_parts(np.array([0, 10, 5010]), 100))
    windows = [w for i, ends, at in parts if i == 1 for w in range(at, at + int(ends[-1] - ends[0]) - 99)]
    assert windows == list(range(4901))


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    a, b = "m" * 30 + "".join(map(str, range(60))), "".join(map(str, range(60))) + "n" * 30
    rows = spark.createDataFrame([(2, a), (2, b), (2, b), (1, "z"), (None, a)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["kept_sha256"], r["n_removed"] > 0) for r in suffix.suffix_dedup(rows).collect()}
    first, second = sorted((a, b), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = plain({0: "z", 1: first, 2: second})
    assert got == {(1, want[0][3], False), (2, want[1][3], False), (2, want[2][3], True), (None, hashlib.sha256(a.encode()).hexdigest(), False)}


def test_contexts_with_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    """With polynomial hashes that are all alike, whatever is decided by them alone would come out wrong."""
    data = np.frombuffer(b"abcabdabcabc", dtype=np.uint8)
    at = np.array([0, 0, 3, 6])
    assert suffix.same_bytes(data, at, np.array([3, 6, 9, 9]), np.array([3, 3, 3, 2])).tolist() == [False, True, False, True]
    monkeypatch.setattr(suffix, "substring_hashes", lambda prefixes, start, size: np.zeros(len(start), dtype=np.uint64))
    text = np.frombuffer(b"xxabcdexxabcdfxxabcde", dtype=np.uint8)
    starts = np.array([2, 9, 16])
    hit = suffix.repeated(text, suffix.prefix_hashes(text), starts, np.zeros(3, dtype=np.int64), 5)
    assert hit.tolist() == [False, False, True]


def test_many_contexts_of_one_seed(spark):
    """A seed with many contexts: its windows are dealt to several sorts and all are found."""
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh ") for _ in range(95))
    left = ["".join(rng.choice("01") for _ in range(20)) for _ in range(6)]
    texts = {i: rng.choice(left) + core + rng.choice(left) for i in range(150)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for limit in (2000, 3):
        spans = suffix.merged_spans(suffix.repeated_spans(rows, sorted_contexts=limit))
        got = results(rows.join(spans, "doc_id", "left").mapInArrow(suffix._digest_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
        assert got == plain(texts)
