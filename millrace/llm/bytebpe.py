"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A task cuts its texts into the pattern's matches and numbers its distinct words; each new word goes on once, as a byte array, in
rows of bounded size, followed by the documents as arrays of word numbers. Spark folds ranked merges over each byte array. The
rank map is a literal, in two flat arrays: for every two pieces whose concatenation is a piece too it has a cell with both ids and
that piece's rank, which is its id; a second array says by how much the cells of a bucket are shifted, so that no two share one
and a look-up reads one cell. A fold step takes the leftmost pair of least rank, joins it, and looks up the two new neighbours.
Ids of a document are those of its words in order; decoding concatenates the binary pieces of the ids. Everything happens inside
one stage: nothing is shuffled, and a lost task is simply done again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, in_tasks_of, text_steps

#: UTF-8 bytes beyond which a word is merged by a heap, as a fold over it takes quadratic time: a second at this length.
LONGEST_FOLD = 4096
#: Words in a row, bytes of text whose words are numbered before they are sent on, and words, or characters in them, after which
#: numbering starts anew: what a task holds of its words is bounded, and until then each is folded once.
ROW_WORDS, STEP_BYTES, KEPT_WORDS, KEPT_CHARS = 2_000, 1 << 20, 750_000, 12_000_000
#: Bytes of input files that a task reads, if there are tasks enough for all cores: the more of them, the fewer words are folded.
TASK_BYTES = 32 << 20
#: A pair is one number: its rank, its place in the word and the id of its first piece, in so many bits; the last rank is none.
RANK_BITS, PLACE_BITS, ID_BITS = 20, 23, 20
NO_RANK = (1 << RANK_BITS) - 1

CUT = "forget boolean, words array<array<smallint>>, aside_at array<int>, aside array<string>, doc_ids array<bigint>, sizes array<int>, uses binary"
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a line has a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankTable:
    """The rank map as two flat lists: cell (key >> bits) + shifts[key & (2**bits - 1)], modulo the number of cells, holds
    key << 20 | rank, where key = left id * span + right id."""

    def __init__(self, ranks: dict[bytes, int]):
        joins = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    joins[left, right] = rank
        self.span = max(ranks.values(), default=0) + 1 | 1  # odd, so that the low bits of keys differ
        room = max(len(joins) * 9 // 8, 2 * self.span, 16)
        self.cells = [-1] * (1 << (room - 1).bit_length())
        self.bits = (len(self.cells) >> 2).bit_length() - 1
        self.shifts = [0] * (1 << self.bits)
        buckets: dict[int, list[int]] = {}
        for (left, right), rank in joins.items():
            key = left * self.span + right
            buckets.setdefault(key & (len(self.shifts) - 1), []).append(key << ID_BITS | rank)
        mask = len(self.cells) - 1
        for bucket, held in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            places, shift = [x >> ID_BITS + self.bits for x in held], bucket * 7919 & mask
            for _ in range(len(self.cells)):
                if not any(self.cells[p + shift & mask] >= 0 for p in places):
                    break
                shift = shift + 1 & mask
            else:
                raise ValueError("the rank map does not fit its table")
            self.shifts[bucket] = shift
            for p, x in zip(places, held, strict=True):
                self.cells[p + shift & mask] = x

    def look_up(self, left: Column, right: Column, cells: Column, shifts: Column) -> Column:
        """The rank of both together, or NO_RANK; cells and shifts: the lists as columns; right may be null."""

        def found(key: Column) -> Column:
            place = (F.shiftright(key, self.bits) + F.get(shifts, key.bitwiseAND(_long(len(self.shifts) - 1)))).bitwiseAND(_long(len(self.cells) - 1))
            return _let(F.get(cells, place), lambda x: F.when(F.shiftright(x, ID_BITS) == key, x.bitwiseAND(_long(NO_RANK))).otherwise(_long(NO_RANK)))

        return _let(left * _long(self.span) + right, found)


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def unreached(ranks: dict[bytes, int]) -> set[str]:
    """Words that are pieces but that merging would not give as one: they count as one piece all the same."""
    found = [p for p, r in ranks.items() if len(p) > 1 and heap_merge(p, ranks) != [r]]
    return {p.decode() for p in found if _is_text(p)}


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def piece_list(ranks: dict[bytes, int]) -> Column:
    """The pieces by id as a literal: array of hex pieces, empty where no piece has the id."""
    by_id = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece.hex().upper()
    return _literal(by_id, "string")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """For an array of words, each an array of byte values, their arrays of ids."""
    table = RankTable(ranks)
    bytes_as_ids = [ranks.get(bytes([b]), 0) for b in range(256)]
    id_mask, place_mask, low_mask = _long((1 << ID_BITS) - 1), _long((1 << PLACE_BITS + ID_BITS) - (1 << ID_BITS)), _long((1 << PLACE_BITS + ID_BITS) - 1)
    one_place, none = _long(1 << ID_BITS), _long(NO_RANK << PLACE_BITS + ID_BITS)

    def ranked(left: Column, right: Column, lists: tuple[Column, Column]) -> Column:
        return F.shiftleft(table.look_up(left, right, *lists), PLACE_BITS + ID_BITS)

    def joined(pairs: Column, least: Column, lists: tuple[Column, Column]) -> Column:
        """The pair at `at` becomes one piece, whose id is the pair's rank; both of its neighbours are looked up, what follows moves
        up a place."""

        def changed(at: Column, new: Column, before: Column, gone: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                second = ranked(new, F.get(pairs, gone + 1).bitwiseAND(id_mask), lists) + x.bitwiseAND(place_mask) + new
                first = ranked(x.bitwiseAND(id_mask), new, lists) + x.bitwiseAND(low_mask)
                return F.when(i > at, x - one_place).when(i < before, x).when(i == at, second).otherwise(first)

            return F.filter(F.transform(pairs, one), lambda x, i: i != gone)

        at = F.shiftright(least.bitwiseAND(place_mask), ID_BITS).cast("int")
        return _let(at, lambda a: _let(F.shiftright(least, PLACE_BITS + ID_BITS), lambda new: _let(a - 1, lambda b: _let(a + 1, lambda g: changed(a, new, b, g)))))

    def word(ids: Column, lists: tuple[Column, Column]) -> Column:
        """A pair is one number, of which the least is the leftmost pair of least rank; the last piece's has no rank."""
        step = lambda pairs, _: _let(F.array_min(pairs), lambda least: F.when(least >= none, pairs).otherwise(joined(pairs, least, lists)))
        pairs = F.transform(ids, lambda x, i: ranked(x, F.get(ids, i + 1), lists) + i * one_place + x)
        return F.transform(_let(pairs, lambda x: F.aggregate(x, x, step)), lambda x: x.bitwiseAND(id_mask))

    def all_words(single: Column, lists: tuple[Column, Column]) -> Column:
        return F.transform(words, lambda w: _let(F.transform(w, lambda b: F.get(single, b)), lambda ids: word(ids, lists)))

    return _let(_literal(table.cells, "bigint"), lambda c: _let(_literal(table.shifts, "bigint"), lambda s: _let(_literal(bytes_as_ids, "bigint"), lambda one: all_words(one, (c, s)))))


def decode_ids(ids: Column, pieces: Column) -> Column:
    """For an array of arrays of ids the concatenated binary pieces of each."""
    return _let(pieces, lambda table: F.transform(ids, lambda one: F.unhex(F.array_join(F.transform(one, lambda i: F.get(table, i)), ""))))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one very long word: the same merges, least rank first and leftmost among equals, kept in a heap."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if piece[i] else -1
        if j < 0 or piece[i] + piece[j] != both:
            continue
        piece[i], piece[j] = both, b""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (r := ranks.get(pair := piece[k] + piece[after[k]])) is not None:
                heapq.heappush(heap, (r, k, pair))
    return [ranks[p] for p in piece if p]


class Numbers(dict):
    """Words by their number: a new word gets the next one and is kept in `new`. chars: those of the words sent on."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


_CUT_KINDS = (("forget", pa.bool_()), ("words", pa.list_(pa.list_(pa.int16()))), ("aside_at", pa.list_(pa.int32())), ("aside", pa.list_(pa.string())), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("uses", pa.binary()))


def _cut_row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(name)], kind) for name, kind in _CUT_KINDS], names=[name for name, _ in _CUT_KINDS])


def _word_row(words: list[str], apart: set[str], forget: bool) -> pa.RecordBatch:
    """Words as byte arrays; those that are not to be folded are empty there and stand aside as text."""
    raw = [w.encode() for w in words]
    aside_at = [i for i, (w, r) in enumerate(zip(words, raw, strict=True)) if len(r) > LONGEST_FOLD or w in apart]
    for i in aside_at:
        raw[i] = b""
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int16))
    folded = pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values))
    row = _cut_row(forget=forget, aside_at=aside_at, aside=[words[i] for i in aside_at])
    return row.set_column(1, "words", folded)


def _cut(pattern: str, apart: set[str]):
    """Rows of new words, and after them rows of the documents that use them, by number."""

    def run(batches):
        find, numbers, forget = regex.compile(pattern).findall, Numbers(), True
        for batch in batches:
            for step in text_steps(batch, limit=STEP_BYTES):
                if len(numbers) > KEPT_WORDS or numbers.chars > KEPT_CHARS:
                    numbers, forget = Numbers(), True
                uses = [array("i", map(numbers.__getitem__, find(t))).tobytes() for t in step.column("text").to_pylist()]
                for i in range(0, len(numbers.new), ROW_WORDS):
                    yield _word_row(numbers.new[i : i + ROW_WORDS], apart, forget)
                    forget = False
                numbers.chars += sum(map(len, numbers.new))
                numbers.new.clear()
                yield _cut_row(forget=forget, doc_ids=step.column("doc_id").to_pylist(), sizes=[len(u) // 4 for u in uses], uses=b"".join(uses))
                forget = False

    return run


def _assemble(path: str):
    """Ids and pieces of the words, put together document by document."""

    def run(batches):
        ranks, by_id, texts, raw = None, {}, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row["forget"].as_py():
                    texts, raw = [], []
                if row["doc_ids"].as_py() is None:
                    first = len(texts)
                    texts += row["id_texts"].as_py()
                    raw += row["raw"].as_py()
                    for i, w in zip(row["aside_at"].as_py(), row["aside"].as_py(), strict=True):
                        if ranks is None:
                            ranks = load_ranks(path)
                            by_id = {r: p for p, r in ranks.items()}
                        ids = [ranks[w.encode()]] if w.encode() in ranks else heap_merge(w.encode(), ranks)
                        texts[first + i], raw[first + i] = " ".join(map(str, ids)), b"".join(by_id[x] for x in ids)
                    continue
                uses, at, out = np.frombuffer(row["uses"].as_buffer(), dtype="<i4"), 0, []
                for doc_id, size in zip(row["doc_ids"].as_py(), row["sizes"].as_py(), strict=True):
                    own = uses[at : at + size].tolist()
                    at += size
                    ids = " ".join(map(texts.__getitem__, own))
                    out.append((doc_id, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(map(raw.__getitem__, own))).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 of every whole text.

    Null or empty text has no ids: both digests are those of nothing. Words of more than LONGEST_FOLD bytes are merged by a
    heap, with the same result; a word that is a piece as a whole is one id, as in the library. Repeated rows are encoded each; a
    null doc_id is kept as null. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    ranks = load_ranks(path)
    cut = in_tasks_of(id_text(docs), TASK_BYTES).mapInArrow(_cut(pattern, unreached(ranks)), CUT)
    coded = cut.withColumn("ids", encode_words(F.col("words"), ranks))
    coded = coded.select("forget", "aside_at", "aside", "doc_ids", "sizes", "uses", F.transform("ids", lambda x: F.array_join(x.cast("array<string>"), " ")).alias("id_texts"), decode_ids(F.col("ids"), piece_list(ranks)).alias("raw"))
    return coded.mapInArrow(_assemble(path), OUT)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
