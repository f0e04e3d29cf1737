"""The near-duplicate join against a comparison of all pairs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import nearjoin
from millrace.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


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
            if 100 * both >= 75 * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(sets[d]), root(d)) for d in texts}


def results(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family_texts() -> dict[int, str]:
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts, d = {}, 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 6, 7, 8, 12, 30, 45, 80, 300, 420]))]
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary).upper()
            if rng.random() < 0.3:
                own = own[: rng.randrange(len(own) * 3 // 4, len(own) + 1)]
            texts[d] = rng.choice([" ", "\n", " \t"]).join(own)
            d += 1
    return texts | {d: "", d + 1: " \n", d + 2: "one", d + 3: "ONE", d + 4: "one two", d + 5: None}


@pytest.mark.parametrize("common,sample", [(10, 1), (3, 1), (2, 4)])
def test_against_all_pairs(spark, common, sample, monkeypatch):
    monkeypatch.setattr(nearjoin, "COMMON", common)
    monkeypatch.setattr(nearjoin, "SAMPLE_OF", sample)
    monkeypatch.setattr(nearjoin, "STAR_ROUNDS", 1 if common == 2 else 3)
    texts = family_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3).withColumns({c: F.lit("x") for c in ("comp", "rep", "size")})
    got, want = results(nearjoin.near_groups(df)), plain(texts)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert results(nearjoin.near_groups(docs)) == plain({r["doc_id"]: r["text"] for r in docs.collect()})


def test_nulls_repeats_and_empty(spark):
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "A b  c"), (7, None)], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in nearjoin.near_groups(rows).collect()), key=str)
    assert got == sorted([(None, 1, None), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 0, 7)], key=str)
    assert nearjoin.near_groups(rows.limit(0)).collect() == []


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    common = np.zeros(0, dtype=np.uint64)
    for _ in range(400):
        size = int(rng.integers(1, 900))
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(rng.integers(0, 2)))
        n = len(base)
        drop = int(rng.integers(0, n // 4 + 1))
        other = base[np.sort(rng.permutation(n)[: n - drop])]
        add = int(rng.integers(0, max(1, (4 * len(other) - 3 * n) // 3 + 1)))
        other = np.unique(np.concatenate([other, rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        if nearjoin.linked(base, other):
            assert nearjoin.may_link(nearjoin.sketch(base), n, nearjoin.sketch(other), len(other))
            assert np.intersect1d(nearjoin.emitted(base, common, False), nearjoin.emitted(other, common, False)).size
    far = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(2)]
    assert not nearjoin.may_link(nearjoin.sketch(far[0]), 300, nearjoin.sketch(far[1]), 300)
    assert nearjoin.levels(40) == [(6, 13), (0, 11)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 50), (100, 70), (70, 60)], "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 60: 50, 70: 50, 100: 50}


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements hash alike modulo 2**64 for any odd base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(1, f"{word} c d e f"), (2, f"{other} c d e f"), (3, f"{word.upper()}\tc d e f"), (4, word), (5, other)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_groups(rows).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4), 5: (1, 5)}


def test_word_hashes_see_every_byte_and_the_length():
    words = [b"a", b"a\x00", b"ab", b"abcdefgh", b"abcdefgi", b"abcdefgh\x00", b"abcdefghi", b"", b"\x00", b"\x00\x00"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found = nearjoin.word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(found.tolist())) == len(words)
