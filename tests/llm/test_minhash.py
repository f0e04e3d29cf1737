"""Near copies by MinHash against a comparison of all pairs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def plain(texts: dict[int, str | None]) -> dict[int, tuple]:
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d, s in sets.items():
        for o in {o for x in s for o in holders[x] if o > d}:
            both = len(s & sets[o])
            if 100 * both >= 80 * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in texts}


def results(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def families(seed: int = 11) -> dict[int, str]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts, d = {}, 0
    for _ in range(45):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 7, 8, 12, 30, 45, 80, 300]))]
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.randrange(1, 10)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 18)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[d] = " ".join(own)
            d += 1
    texts |= {d: None, d + 1: "", d + 2: " \n", d + 3: "ONE two", d + 4: "one\ttwo", d + 5: "x" * 50_000}
    return texts


@pytest.mark.parametrize("rounds,block", [(0, 1000), (0, 2), (1, 3), (3, 1000)])
def test_against_all_pairs(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = families(rounds)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("c", "node", "size", "comp", "digest", "n_lists")}).repartition(5)
    assert results(minhash.near_copies(docs)) == plain(texts)


def test_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert results(minhash.op12_minhash(spark, small)) == plain(texts)


def test_a_chain_without_a_centre(spark):
    """Each text links with the next ones only; all are one group although the ends have little in common."""
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = results(minhash.near_copies(docs))
    assert got == plain(texts)
    assert {c for _, c, _ in got.values()} == {0}


def test_null_ids_repeated_ids_and_no_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = spark.createDataFrame([(None, a), (3, a), (3, a), (3, b), (2, b + " end"), (9, a + " end")], "doc_id bigint, text string")
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_copies(rows).collect() if r["doc_id"] is not None)
    assert got == [(2, 48, 2, True), (3, 47, 2, False), (3, 47, 3, True), (3, 47, 3, True), (9, 48, 3, False)]
    lone = minhash.near_copies(rows.where("doc_id is null")).collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in lone] == [(None, None, True)]
    assert minhash.near_copies(rows.where("doc_id = 77")).collect() == []


def test_signatures_agree_as_sets_are_alike():
    rng = np.random.default_rng(3)
    agree = []
    for n in (6, 40, 400):
        for _ in range(400):
            both = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, n // 8, dtype=np.uint64)])) for _ in "ab")
            s = minhash.signatures([a, b])
            agree.append(((s[0] == s[1]).sum(), n / (n + 2 * (n // 8))))
    found, want = (np.array(x, dtype=float) for x in zip(*agree, strict=True))
    assert found.min() >= minhash.MATCHES
    for expected in set(want):
        some = found[want == expected]
        assert abs(some.mean() - 64 * expected) < 1
        assert some.var() < 2 * 64 * expected * (1 - expected) + 0.1
    assert len(np.unique(minhash.signatures([np.array([5], dtype=np.uint64)]))) == minhash.COORDINATES


def test_groups_go_over_batches():
    import pyarrow as pa

    rng = random.Random(6)
    for _ in range(200):
        keys = sorted((rng.randrange(4), rng.randrange(2), rng.randrange(2)) for _ in range(rng.randrange(30)))
        rows = pa.table({k: pa.array([x[i] for x in keys], pa.int64()) for i, k in enumerate("cij")}).append_column("row", pa.array(range(len(keys)), pa.int64()))
        batches = rows.to_batches(max_chunksize=rng.randrange(1, 8)) if len(keys) else []
        batches.insert(rng.randrange(len(batches) + 1), pa.RecordBatch.from_pylist([], rows.schema))
        groups = [g.to_pylist() for g in minhash._groups(batches)]
        assert [r["row"] for g in groups for r in g] == list(range(len(keys)))
        assert [(g[0]["c"], g[0]["i"], g[0]["j"]) for g in groups] == sorted(set(keys))
        assert all(len({(r["c"], r["i"], r["j"]) for r in g}) == 1 for g in groups)
