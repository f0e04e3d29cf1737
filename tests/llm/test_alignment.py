"""Alignment against a plain walk over both token lists."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  spaces ", "\n", "a\tb\r\n", "x" * 3000, "<|endoftext|> and <s> </s> <0x41> <unk>", "lone \x00 nul", "é è ñandú 日本語 😀", "▁literal", "ﬁ é", "123 4567", "\x1c sep", "word " * 400, "foo\xa0bar　baz", "it's 'tis"]
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts: dict) -> dict:
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    aligned, count = {}, Counter()
    for d, text in texts.items():
        a, b = ([], []) if not text else (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text))
        a_bytes = [bytes(shown[c] for c in a_of.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or any(b"".join(x) != b" " + text.encode() for x in (a_bytes, b_bytes)):
            aligned[d] = ([], [], [], [])
            continue
        groups, links, i, j, end_a, end_b, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a) and (end_a < end_b or not own[0]):
                end_a += len(a_bytes[i])
                own[0].append(a[i])
                i += 1
            else:
                end_b += len(b_bytes[j])
                own[1].append(b[j])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                links.append((own[0][-1], own[1][-1]))
                own = ([], [])
        aligned[d] = (a, b, groups, links)
        count.update(links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = {}
    for d, (a, b, groups, links) in aligned.items():
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[d] = (len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest)
    return out


def results(rows):
    return {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in rows}


@pytest.fixture(scope="module")
def docs(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    return base.unionByName(odd).withColumns({c: F.lit("clash") for c in ("links", "n_a", "code", "n")}).repartition(5)


def test_against_a_walk(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert results(alignment.align_corpus(docs, A, B).collect()) == plain(texts)


def test_texts_in_parts_give_what_whole_ones_do(docs, monkeypatch):
    texts = [r["text"] or "" for r in docs.collect()]
    texts = [*texts, " ".join(ODD[3:10] * 3), "a b " * 50, "ab  cd ef_ g 1 2. 3 日 本 é è" * 9]
    own = alignment.Aligner(A, B)
    whole = own.align(texts)
    monkeypatch.setattr(alignment.parts_of, "__defaults__", (7,))
    assert max(len(alignment.parts_of(t)) for t in texts) > 50
    assert own.align(texts) == whole
    monkeypatch.setattr(alignment, "KEPT_PIECES", 5)
    monkeypatch.setattr(alignment, "LONGEST_KEPT", 4)
    own = alignment.Aligner(A, B)
    assert [own.align([t]) for t in texts] == [{k: [v[i]] for k, v in whole.items()} for i in range(len(texts))]


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the cat"), (2, "the")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in rows.transform(lambda d: alignment.align_corpus(d, A, B)).select("doc_id", "n_a", "n_links", "n_best", "count_sum").na.fill(-1).collect())
    assert got == [(-1, 2, 2, 2, 7), (1, 2, 2, 2, 7), (1, 2, 2, 2, 7), (2, 1, 1, 1, 4)]
    assert alignment.align_corpus(rows.where("doc_id = 5"), A, B).collect() == []


def test_pairs_are_bounded_by_the_vocabularies():
    own = alignment.Aligner(A, B)
    found = own.align(["the cat sat on the mat"])
    assert found["n_links"] == found["n_groups"]
    assert own.most_pairs < 1_000_000
