"""The dealt operators against plain implementations, on the small tables plus odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from millrace.llm import bytebpe, counts, exact, language, packing, quality, tokenfile, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, digest string, w string, chunk string"
ODD = ["", None, " \t\n", "a", "é", "x" * 3000, "one two three four five six", "one two three four five six", "one  two three\nfour five six ", "<|endoftext|> a<|endoftext|>b", "it's  'tis\r\n\x1c ok", "😀 ñandú  日本語\n\n", "word " * 400, "!!! ### $$$ |", "same line\nsame line\n\nsame line", "lone \x00 nul"]


@pytest.fixture(scope="module")
def docs(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10_000 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(ODD)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {c: F.lit("clash") for c in ("keep_id", "digest", "w", "chunk")}
    return base.unionByName(odd).withColumns(extra).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, texts, empty):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d))
    want = {}
    for key, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            want[d] = (keep, len(members), d == keep, hashlib.sha256(key.encode()).hexdigest())
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id") < 90):
        got = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_dedup(docs, history).collect()}
        assert got == want
    assert exact.exact_dedup(empty).collect() == []


def test_exact_dedup_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (3, "ab"), (3, "ab"), (2, "a b"), (None, "zz")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(rows).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (3, 2, 4, False), (3, 2, 4, False), (2, 2, 4, True), (None, None, 1, True)], key=str)


def test_exact_dedup_least_id_and_two_texts_of_one_id(spark):
    least = -(1 << 63)
    rows = spark.createDataFrame([(least, "a b"), (3, "ab"), (least + 1, "a b"), (5, "c d"), (5, "c  d"), (6, "c d")], "doc_id bigint, text string")
    for history in (None, F.lit(True), F.lit(False)):
        got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(rows, history).collect())
        assert got == [(least, least, 3, True), (least + 1, least, 3, False), (3, least, 3, False), (5, 5, 3, False), (5, 5, 3, True), (6, 5, 3, False)]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(5)
    digests = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    mph = exact.PerfectHash.over(digests)
    assert sorted(mph.slot(digests)) == list(range(5000))
    assert exact.PerfectHash.over(digests[:0]).slot(digests[:3]).tolist() == [-1, -1, -1]


def plain_ids(name, texts):
    from tokenizers import Tokenizer

    return dict(zip(texts, [e.ids for e in Tokenizer.from_file(tok.path(name)).encode_batch(list(texts.values()), add_special_tokens=False)], strict=True))


def test_token_counts(docs, texts, empty):
    ids = plain_ids("word_bpe_49k.json", texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in counts.count_tokens(docs, tok.path("word_bpe_49k.json")).collect()}
    assert got == {d: (len(t.encode()), len(ids[d])) for d, t in texts.items()}
    assert counts.count_tokens(empty, tok.path("word_bpe_49k.json")).collect() == []
    long = "ab cd\nefg " * 30
    assert "".join(counts.safe_parts(long, 20)) == long and max(map(len, counts.safe_parts(long, 20))) <= 24
    assert counts.safe_parts("x" * 50, 20) == ["x" * 50]


@pytest.mark.parametrize("name,lead", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_on_random_texts(name, lead):
    from millrace.llm.tokens import Encoder

    rng = random.Random(3)
    bits = [" ", "  ", "\n", "a", "Bar", "'s", "1", "é", "́", "<|endoftext|>", "\t", ".", "!!", "|", "\x1c", " ", "😀", "Σ", "foo "]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randrange(14))) for i in range(1500)}
    want = plain_ids(name, texts)
    got = Encoder(tok.path(name), lead).ids(list(texts.values()))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == list(want.values())


def test_packing(docs, texts, empty):
    ids = {d: [*x, 0] for d, x in plain_ids("word_bpe_49k.json", texts).items()}
    rows = packing.pack_documents(docs, tok.path("word_bpe_49k.json")).collect()
    bins = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + 2048]
        assert (r["start"], r["length"]) == (r["piece"] * 2048, len(part))
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(r["doc_id"] for r in rows) == Counter({d: -(-len(x) // 2048) for d, x in ids.items()})
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, tok.path("word_bpe_49k.json")).collect() == []


def test_open_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenBins(10, 2)
    assert [bins.put(x) for x in (6, 8, 5, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_quality(spark, docs, texts, empty, small):
    trusted = quality.trusted_labels(spark.read.parquet(f"{small}/labels.parquet"))
    rows = {r["doc_id"]: r for r in quality.quality(docs, trusted).collect()}
    assert {d: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for d, r in rows.items()} == {d: plain_quality(t) for d, t in texts.items()}
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in rows.values())
    assert quality.quality(empty, trusted).collect() == []
    assert {r["score"] for r in quality.quality(docs, trusted.limit(0)).collect()} == {0.0}


def test_quality_scores(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a c c"), (None, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in quality.quality(rows, spark.createDataFrame([(1,), (1,)], "doc_id bigint")).collect()}
    grams = {1: ["a", "b", "a b"], 2: ["a", "c", "c", "a c", "c c"]}
    raw, good, n = Counter(grams[1] + grams[2]), Counter(grams[1]), quality.BUCKETS
    for d, own in grams.items():
        want = np.mean([np.log((good[g] + 1) / (3 + n)) - np.log((raw[g] + 1) / (8 + n)) for g in own])
        assert got[d] == pytest.approx(want)
    assert got[None] == 0.0


def test_byte_bpe(docs, texts, empty):
    import tiktoken

    path = tok.path("byte_bpe_50k.tiktoken")
    ranks = bytebpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in texts.items():
        ids = enc.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in bytebpe.encode_decode(docs, path).collect()}
    assert got == want
    assert bytebpe.encode_decode(empty, path).collect() == []
    word = "ab" * 700 + "the" * 90
    assert bytebpe.heap_merge(word.encode(), ranks) == enc.encode_ordinary(word)


def test_language_id(spark, docs, empty, small):
    model = language.learn(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if r["doc_id"] < 10_000}
    held = {r["doc_id"] for r in docs.where(language.held_out()).select("doc_id").collect()}
    assert held == {d for d in got if zlib.crc32(str(d).encode()) % 3 == 1}
    right = [got[d]["lang_pred"] == truth[d] for d in truth if d in held]
    assert np.mean(right) > 0.95
    for i, t in enumerate(ODD):
        no_letter = t is None or not any(c.isalpha() for c in t)
        assert (got[10_000 + i]["lang_pred"] == "und") == no_letter
        assert 0 <= got[10_000 + i]["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(docs, language.learn(empty)).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def test_language_backs_off_to_shorter_grams():
    model = language.Model.named(["a", "b"], {"yes": [-1.0, -2.0]}, {5: {"<xyz>": [-3.0, -1.0]}, 1: {"q": [-5.0, -6.0]}})
    got, telling = model.vectors(["yes", "xyz", "qqq", "w"])
    assert got.tolist() == [[-1, -2], [-3, -1], [-5, -6], [0, 0]]
    assert telling.tolist() == [True, True, False, False]
    assert language.Scorer(model).score(["w", "12", None, "", "yes"])[:4] == [("a", 0.5, 0.0), ("und", 0.0, 0.0), ("und", 0.0, 0.0), ("und", 0.0, 0.0)]


def test_token_file(docs, texts, empty):
    ids = {d: [*x, 0] for d, x in plain_ids("byte_bpe_50k.json", texts).items()}
    want, at = {}, 0
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        at += len(ids[d])
    got = {r["doc_id"]: tuple(r)[1:] for r in tokenfile.round_trip(docs, tok.path("byte_bpe_50k.json")).collect()}
    assert got == want
    assert tokenfile.round_trip(empty, tok.path("byte_bpe_50k.json")).collect() == []


def test_rank_coding_round_trip(spark, docs, texts, tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 4, 8, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data, _ = tokenfile.pack_ranks(ranks)
        assert len(control) == n // 4
        assert tokenfile.unpack_ranks(control, data).tolist() == ranks.tolist()
    control, data, _ = tokenfile.pack_ranks(np.array([5, 300, 0, 255], dtype=np.uint32))
    assert (control.tolist(), data.tolist()) == ([4], [5, 0x2C, 1, 0, 255])
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t", tok.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokenfile.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert got == {d: [*x, 0] for d, x in plain_ids("byte_bpe_50k.json", texts).items()}


def test_warc(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9000, "http://[bad", ""), (9002, "HTTP://www.X.org/a?b", "<p>\r\n\r\n\x00é"), (9003, "http://x.org/a?b", "<p>\r\n\r\n\x00é"), (None, "http://x.org/", "<p>\r\n\r\n\x00é")], "page_id bigint, url string, html string")
    pages = pages.unionByName(odd).withColumn("mark", F.lit(1))
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    first = {}
    for p, h in rows:
        if p is not None:
            first[h] = min(p, first.get(h, p))
    got = warc.archive_round_trip(pages).collect()
    want = {p: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if p in (None, first[h]) else "revisit", None if p in (None, first[h]) else first[h]) for p, h in rows}
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert len(got) == len(rows)
    order = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert order == sorted(order)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_warc_hot_payload_large_payload_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 20)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 16)
    large = "".join(random.Random(6).choice("abcdefgh<> é") for _ in range(3_000_000))
    rows = [(i, "http://a.org/one" if i % 3 else f"http://b{i}.org/", "<p>same</p>" if i % 4 else f"<p>{i}</p>") for i in range(200)] + [(900, "http://big.org/", large), (901, "http://big.org/", large)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"mark": F.lit(0), "run": F.lit("x")})
    got = warc.archive_round_trip(pages).collect()
    first = {}
    for p, _, h in sorted(rows):
        first.setdefault(h, p)
    want = {p: (len(h.encode()), None if first[h] == p else first[h]) for p, _, h in rows}
    assert {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in got} == want
    order = [warc.capture_order(tuple(r)) for r in got]
    assert order == sorted(order)
    assert len({r["filename"] for r in got}) > 1


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert warc.url_key("http://www.B.example.com/P?q=1#z") == "com,example,b)/p?q=1"
