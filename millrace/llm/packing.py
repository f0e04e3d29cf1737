"""Bounded-space best-fit packing of token sequences.

Each task packs its share of the pieces. A fixed number of bins is open at a time; a bitset has a bit for each free space
that some open bin has, so the tightest bin that still takes a piece is the lowest set bit at or above the piece's length. If
no open bin takes it and all are open, the fullest bin, the lowest set bit of all, closes first. Pieces come longest first.
"""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, text_steps, tidied
from .tokens import encoder

CAPACITY = 2048
OPEN_BINS = 4096
#: Pieces that one task is meant to pack.
TASK_PIECES = 500_000

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, spaces_lead: bool, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Cut each document's ids, then `end_id`, into pieces of `capacity`; the last one may be shorter."""
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        enc = encoder(path, spaces_lead)
        for batch in batches:
            for step in text_steps(batch):
                rows = []
                for doc_id, ids in zip(step.column("doc_id").to_pylist(), enc.ids(step.column("text").to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), width):
                        part = ids[k : k + width]
                        rows.append((doc_id, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(tidied(run), PIECE)


class OpenBins:
    """put(length) gives the bin and the offset in it."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0
        self.bins: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        if not held:
            self.free ^= 1 << space
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            held = self.bins.setdefault(left, [])
            if not held:
                self.free |= 1 << left
            held.append(number)
            self.open += 1
        return number, self.capacity - space


def pack(cut: DataFrame, n_pieces: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to pieces of at most `capacity`. n_pieces: about how many there are, which alone sets the number
    of tasks: each leaves bins of its own half filled.

    Sequences are gapless from 0. Repeated rows are packed each. No pieces, no sequences. The same pieces give the same
    sequences, as each task's pieces are sorted.
    """
    n = max(1, -(-n_pieces // TASK_PIECES))

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = cut.repartition(n, "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(tidied(run), f"{PIECE}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, spaces_lead: bool = False, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is one piece that holds only the end id. Texts of any length are cut, never dropped. Columns other than
    doc_id and text are ignored; an empty table gives no rows; a null doc_id is kept as null.
    """
    return pack(pieces(docs, path, spaces_lead, capacity), docs.select("doc_id").count(), capacity, open_bins)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
