"""Alignment of the tokens that two tokenizers make of the same bytes, and how often their ids end together in a corpus.

Tokenizer A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model with byte fallback. Over the tokens of a
batch of texts, cumulative sums of their byte lengths are the places where they end; the ends that both have are the cuts, and
groups of tokens lie between cuts. A token of A and one of B are linked if they end at the same place. Texts are encoded once: a
table keeps each document's numbers and its links, four bytes each. Pairs are counted from it in each task, by salted key, then by
key.

Of two linked tokens the shorter one's bytes are the end of the longer one's. So a token has at most as many partners in the other
vocabulary that are not longer as it has bytes, and all pairs that any corpus can have are at most the bytes of both vocabularies
(some 600,000 for the usual ones). This bounds the table of counts, which goes to all tasks when documents are scored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, id_text, pool, table, text_steps, tidied
from .tokens import BYTE_LETTERS

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text in a step, and characters beyond which a text is encoded in parts.
STEP = 1 << 19
LONG_TEXT = 1 << 20
#: Distinct codes of batches that a task gathers before it sums them.
KEPT_CODES = 1 << 20
#: Salted keys of a pair in the first of two stages of counting.
SALTS = 16
#: Pieces in each of the two generations that a worker remembers, and characters beyond which a piece is not remembered.
KEPT_PIECES = 300_000
LONGEST_KEPT = 64
#: A space between letters or digits: long texts are cut before some of these.
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: No token of either tokenizer goes over the place before one space, or one line feed, that is not beside other white space.
_PIECES = re.compile(r"(?<=\S)(?=[ \n]\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"


def parts_of(text: str, longest: int = LONG_TEXT) -> list[str]:
    """The text cut before spaces between letters or digits into parts of about `longest` characters; without such a place it stays whole."""
    parts, i = [], 0
    while len(text) - i > longest:
        cut = _CUT.search(text, i + longest)
        if not cut:
            break
        parts.append(text[i : cut.start()])
        i = cut.start()
    return [*parts, text[i:]]


class Vocabulary:
    """Bytes of each token, their lengths, and the token's number as text with each sign that may follow it."""

    def __init__(self, tokens: list[bytes], separators: str):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.shown = [f"{i}{s}".encode() for i in range(len(tokens)) for s in separators]

    def of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        byte_of = {chr(b): b for b in range(256)} | {c: b for b, c in BYTE_LETTERS.items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.vocabulary_a = Vocabulary([bytes(byte_of[c] for c in n) for n in names], ",|")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        own = [bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.vocabulary_b = Vocabulary(own, ",;")
        if min(self.vocabulary_a.lengths.min(), self.vocabulary_b.lengths.min()) < 1:
            raise ValueError("a token without bytes")
        self.most_pairs = int(self.vocabulary_a.lengths.sum() + self.vocabulary_b.lengths.sum())
        every = self.vocabulary_a.shown + self.vocabulary_b.shown
        self.shown_sizes = np.array([len(x) for x in every], dtype=np.int64)
        width = int(self.shown_sizes.max())
        self.shown = np.frombuffer(b"".join(x.ljust(width) for x in every), dtype=np.uint8).reshape(-1, width)
        self.space = self.b.piece_to_id("▁")
        if any(c in p.lstrip("▁") for p in pieces for c in "▁\n"):
            raise ValueError("texts cannot be encoded in pieces: a token has a space or line feed after another character")
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _fresh(self, pieces: list[str]) -> None:
        """Encode pieces, all at once, and remember them. A reads them as they are; B adds a space to each, which stands for the one
        that a piece begins with, or is taken away again from one that begins with a line feed."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        ids_b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        for i, p in enumerate(pieces):
            if p[0] != " ":
                if ids_b[i][0] != self.space:
                    raise ValueError("the space that B adds went into another token")
                del ids_b[i][0]
        sides = ((self.vocabulary_a, ids_a), (self.vocabulary_b, ids_b))
        whole = "".join(pieces).encode()
        all_same = all(b"".join(map(v.of, ids)) == whole for v, ids in sides)
        for piece, a, b in zip(pieces, ids_a, ids_b, strict=True):
            same = all_same or self.vocabulary_a.of(a) == self.vocabulary_b.of(b) == piece.encode()
            self.known[piece] = (array("I", a).tobytes(), array("I", b).tobytes()) if same else None

    def _parts(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        cut = [_PIECES.split(p) for p in parts]
        new = set().union(*cut).difference(self.known)
        self.known |= {p: self.old[p] for p in new if p in self.old}
        if unseen := new.difference(self.old):
            self._fresh(list(unseen))
        found = [list(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in unseen:
            if len(p) > LONGEST_KEPT:
                del self.known[p]
        if len(self.known) > KEPT_PIECES:
            self.known, self.old = {}, self.known
        return [None if None in f else (b"".join([x for x, _ in f]), b"".join([x for _, x in f])) for f in found]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text, which A reads with a space before; none where the bytes of either are not those of the text."""
        parts = [[p if i else f" {p}" for i, p in enumerate(parts_of(t))] if t else [] for t in texts]
        if max(map(len, parts), default=0) > 1:
            found = [[x for p in own for x in self._parts([p])] for own in parts]
        else:
            every = iter(self._parts([p for own in parts for p in own]))
            found = [[next(every) for _ in own] for own in parts]
        return [tuple(np.frombuffer(b"" if None in f else b"".join([p[k] for p in f]), "<u4").astype(np.int64) for k in (0, 1)) for f in found]

    def align(self, texts: list[str]) -> dict[str, list]:
        """The columns of ALIGNED but doc_id."""
        ids = self.encoded(texts)
        n_a, n_b = (np.array([len(x[k]) for x in ids], dtype=np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in ids)]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.vocabulary_a.lengths[a]), np.cumsum(self.vocabulary_b.lengths[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty, so no end is there twice
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)

        # Links: at each cut, all tokens of A that end there with all tokens of B that do.
        at_a, at_b = np.flatnonzero(cuts[group_a] == ends_a), np.flatnonzero(cuts[group_b] == ends_b)
        many_b = np.bincount(group_b[at_b], minlength=len(cuts))
        times = many_b[group_a[at_a]]
        left = np.repeat(at_a, times)
        first_b = np.cumsum(many_b) - many_b
        right = at_b[np.repeat(first_b[group_a[at_a]] - (np.cumsum(times) - times), times) + np.arange(len(left))]
        links = self.codes(a[left], b[right])

        # The text form: tokens of both in the order of groups, A before B, each with the sign that follows it.
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        shown = np.zeros(len(a) + len(b), dtype=np.int64)
        closes_a, closes_b = (np.concatenate([g[1:] != g[:-1], [True]])[: len(g)] for g in (group_a, group_b))
        shown[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + closes_a
        shown[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (len(self.vocabulary_a.tokens) + b) + closes_b
        size = self.shown_sizes[shown]
        whole = self.shown[shown][np.arange(self.shown.shape[1]) < size[:, None]].tobytes()

        to_a, to_both = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_a + n_b)])
        link_at, group_at = np.searchsorted(left, to_a), np.searchsorted(cuts, np.concatenate([[0], ends_a])[to_a], "right")
        text_at = np.concatenate([[0], np.cumsum(size)])[to_both].tolist()
        return {
            "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": np.diff(group_at).tolist(), "n_links": np.diff(link_at).tolist(),
            "groups_sha256": [hashlib.sha256(whole[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(text_at[:-1], text_at[1:], strict=True)],
            "links": [links[i:j].tobytes() for i, j in zip(link_at[:-1], link_at[1:], strict=True)],
        }

    @property
    def code_type(self) -> str:
        return "<u4" if len(self.vocabulary_a.tokens) * len(self.vocabulary_b.tokens) < 1 << 32 else "<u8"

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b * len(self.vocabulary_a.tokens) + a).astype(self.code_type)


_aligners: dict = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, kept from task to task; that of other files is dropped."""
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The columns of ALIGNED for every row of docs; links are codes b * |A| + a, in order."""

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            for step in text_steps(batch, limit=STEP):
                found = own.align(step.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": step.column("doc_id")} | found, schema=_schema())

    return id_text(docs).mapInArrow(tidied(run), ALIGNED)


def _schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ALIGNED.split(", "))])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and the sums of their counts in all parts."""
    codes, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c.astype(np.uint64) for c, _ in parts)]), return_inverse=True)
    sums = np.zeros(len(codes), dtype=np.int64)
    np.add.at(sums, at, np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))
    return codes, sums


def pair_counts(aligned: DataFrame, code_type: str) -> DataFrame:
    """code and n: how many links of all documents have the pair. Tasks count their own first, then salted keys, then keys are summed."""

    def run(batches):
        kept: list = []
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(pool(batch.column("links"))[0].tobytes(), code_type)
                kept.append(np.unique(codes, return_counts=True))
            if sum(len(codes) for codes, _ in kept[1:]) > KEPT_CODES:
                kept = [_summed(kept)]
        codes, counts = _summed(kept)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    own = aligned.select("links").mapInArrow(tidied(run), "code bigint, n bigint")
    salted = own.groupBy("code", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("code").agg(F.sum("n").alias("n"))


def align_corpus(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads the text with a space before it, B adds that space itself; special strings in texts are plain text. A document has no
    tokens (zeros, '') if its text is null or empty or if the bytes of its tokens, A's or B's, are not those of the text with a space
    before. n_best: links whose pair is counted, over all documents, as often as the pair counted most that has the same token of B
    (ties are all best). count_sum: the sum of the counts of the links' pairs. Repeated rows count each; a null doc_id is kept as
    null; an empty table gives no rows; texts of any length are encoded whole. Columns other than doc_id and text are ignored.
    """
    own = aligner(path_a, path_b)
    aligned = table(alignments(docs, path_a, path_b), "aligned")
    counted = table(pair_counts(aligned, own.code_type), "aligned-pairs")
    if counted.count() > own.most_pairs:
        raise ValueError("more pairs than two such vocabularies can have")
    rows = counted.orderBy("code").toArrow()
    codes, counts = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    of_b = codes // len(own.vocabulary_a.tokens)
    first = np.flatnonzero(np.concatenate([[True], of_b[1:] != of_b[:-1]])[: len(codes)])
    best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(counts)))) if len(codes) else np.zeros(0, bool)
    code_type = own.code_type
    sent = docs.sparkSession.sparkContext.broadcast((codes, counts, best))

    def run(batches):
        codes, counts, best = sent.value
        for batch in batches:
            n_best, sums = [], []
            for x in batch.column("links").to_pylist():
                at = np.searchsorted(codes, np.frombuffer(x, code_type).astype(np.int64))
                n_best.append(int(best[at].sum()))
                sums.append(int(counts[at].sum()))
            cols = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            yield pa.RecordBatch.from_pydict(cols | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": batch.column("groups_sha256")})

    return aligned.mapInArrow(tidied(run), "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return align_corpus(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
