"""Spelling variants against a comparison of all words, and the query against its SQL."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import variants


def one_error(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows: list[tuple]) -> dict[str, tuple]:
    lower, count = str.maketrans(variants.UPPER, variants.LOWER), Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in n:
        found = [v for v in n if one_error(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


def results(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def spelt(seed: int) -> list[str]:
    """Words with chains of forms, errors at every place, and some that are far from all."""
    rng, words = random.Random(seed), []
    letters = "abcdé÷"
    for _ in range(12):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 13)))
        for weight in (130, 26, 5, 5):
            words += [base] * weight
            at, kind = rng.randrange(len(base) + 1), rng.randrange(3)
            base = base[:at] + rng.choice(letters) * (kind < 2) + base[at + (kind > 0) :]
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("shard,half", [(20_000, 20_000), (40, 3), (7, 1)])
def test_against_all_words(spark, monkeypatch, shard, half):
    monkeypatch.setattr(variants, "SHARD_WORDS", shard)
    monkeypatch.setattr(variants, "HALF_WORDS", half)
    words = spelt(shard)
    rows = [(i, " ".join(words[i::40]).upper() + ". x1y\n") for i in range(40)] + [(None, " ".join(words[:9])), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "run", "id", "part")})
    got = results(variants.variant_groups(docs))
    assert got == plain(rows)
    assert any(v[0] and v[0] != v[1] for v in got.values())
    assert variants.variant_groups(docs.where("doc_id = 999")).collect() == []


def test_against_sql(spark, small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    rows = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({variants.OP13_SQL})").fetchall()
    assert results(variants.op13_variants(spark, small)) == {r[0]: r[1:] for r in rows}


def test_automaton_numbers_words_and_finds_neighbours():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))) for _ in range(900)})
    automaton = variants.Automaton(words)
    assert len(automaton) == len(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("abd") == automaton.number("") == -1
    assert automaton.size < len({w[:i] for w in words for i in range(len(w) + 1)}) / 2  # ends are shared
    for w in words[:120]:
        for exact in (0, 2, len(w) // 2, len(w)):
            want = {i for i, v in enumerate(words) if v[:exact] == w[:exact] and one_error(w, v)}
            assert automaton.near(w, exact) == want
    assert len(variants.Automaton([])) == 0 and variants.Automaton([]).near("abc", 1) == set()


def test_long_runs(spark):
    long = "ab" * 40_000
    rows = [(i, f"{long} {long}c") for i in range(5)]
    got = results(variants.variant_groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == plain(rows)
