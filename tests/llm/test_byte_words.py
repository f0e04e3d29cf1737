"""Byte-level BPE across rows of words, words of any length, numbering that starts anew; token ranges that split one corpus."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tok
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import bytebpe, counts, packing, tokenfile
from millrace.llm.tokens import Encoder

PATH = tok.path("byte_bpe_50k.tiktoken")


def expected(text):
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bytebpe.load_ranks(PATH), special_tokens={})
    ids = enc.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_many_rows_of_words_and_numbers_that_start_anew(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghiéß日") for _ in range(rng.randrange(1, 12))) for _ in range(400)) for _ in range(40)]
    texts += ["ab" * 400 + " the" * 50, "x" * 257 + "yz" * 300, "q" * 5000, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    for name, value in (("ROW_WORDS", 100), ("STEP_BYTES", 5000), ("KEPT_WORDS", 1500)):
        monkeypatch.setattr(bytebpe, name, value)
    got = {r["doc_id"]: tuple(r)[1:] for r in bytebpe.encode_decode(rows, PATH).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def folded(texts):
    """How many words of these texts, a batch each, go on to be folded."""
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    rows = bytebpe._cut(tok.PATTERN, set())(iter(batches))
    return sum(len(row.column("words")[0]) for row in rows if row.column("words")[0].is_valid)


def test_words_of_a_task_are_folded_once():
    letters = "abcdefghijklmnopqrst"
    words = [" " + a + b + c + d for a in letters for b in letters for c in letters for d in letters]
    texts = ["".join(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    assert folded(texts * 2) == len(words)


def test_long_words_make_numbering_start_anew(monkeypatch):
    texts = [c * 400 for c in "abcdefgh"]
    monkeypatch.setattr(bytebpe, "KEPT_CHARS", 1000)
    assert folded(texts) == 8 and folded([*texts[:4], texts[0]]) == 5 and folded([*texts[:2], *texts[:2]]) == 2


def test_small_files_share_a_task(spark, tmp_path):
    texts = [f"word{i} the {i * 7}" for i in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(100).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        docs = spark.read.parquet(f"{tmp_path}/docs")
        assert docs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        out = bytebpe.encode_decode(docs, PATH)
        assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == {i: expected(t) for i, t in enumerate(texts)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rank_table_holds_every_join():
    ranks = bytebpe.load_ranks(PATH)
    table = bytebpe.RankTable(ranks)
    mask, n = len(table.cells) - 1, 0
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if piece[:i] in ranks and piece[i:] in ranks:
                key = ranks[piece[:i]] * table.span + ranks[piece[i:]]
                assert table.cells[(key >> table.bits) + table.shifts[key & (len(table.shifts) - 1)] & mask] == key << 20 | rank
                n += 1
    assert n == sum(x >= 0 for x in table.cells)
    assert all(x < 0 for x in bytebpe.RankTable({bytes([b]): b for b in range(256)}).cells)


def test_letters_whose_lower_case_ends_in_a_mark(spark):
    texts = ["TÜRKİYE CUMHURİYETİ.", "DEVLETİ, iki", "İ. İ! Foo. Bar!", "ǰ. ß? ŉ; ẖ, Ǆ.", "İİİ... x.İ"]
    for name, lead in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        want = [e.ids for e in Tokenizer.from_file(tok.path(name)).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(tok.path(name), lead).ids(texts)] == want
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = [e.ids for e in Tokenizer.from_file(tok.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)]
    assert {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(rows, tok.path("word_bpe_49k.json")).collect()} == {i: len(x) for i, x in enumerate(want)}
    crc = {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(want)}
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(rows, tok.path("word_bpe_49k.json")).collect()} == crc


def test_recent_pieces_are_bounded(monkeypatch):
    from millrace.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    enc = tokens.Encoder(tok.path("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{i}x{k % 7}" for k in range(60)) for i in range(30)]
    want = [e.ids for e in Tokenizer.from_file(tok.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    for t, w in zip(texts, want, strict=True):
        assert np.frombuffer(enc.ids([t])[0], "<u4").tolist() == w
        assert len(enc.known) <= 110 and len(enc.known.old) <= 110


def test_token_ranges_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "RANGE_IDS", 60)
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 25)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "Ñu", "x1"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    ids = [None, None, *([7] * 20), *range(100, 138)]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(3)
    got = tokenfile.round_trip(rows, tok.path("byte_bpe_50k.json")).collect()
    want = {i: [*e.ids, 0] for i, e in enumerate(Tokenizer.from_file(tok.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False))}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((ids[i], len(x), crc(x)) for i, x in want.items()), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
