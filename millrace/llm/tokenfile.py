"""A binary file format for token ids, and its writer and reader.

Ids are replaced by their rank of frequency in the corpus, so that the most frequent ones take one byte. Ranks are written in
byte-aligned variable length: one control byte tells the lengths (1 to 4) of four ranks, two bits each, and stands apart from
the data bytes. A document's ranks are filled up with zeros to a multiple of four. A segment is

    magic, number of documents, number of control bytes, ids before it (8 bytes each), document ids (8 bytes each, and a byte
    that tells if there is one), numbers of ids (8 bytes each), control bytes, data bytes

and a file holds one segment; a file of the folder's `vocabulary` lists the ids by rank. Files are written and read by
Spark's own sources, so any store that Spark knows will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, fresh_path, id_text, table, text_steps
from .tokens import encoder

MAGIC = b"MILLTOK1"
#: Ids that a segment is meant to hold, and a range of documents that one task writes; and the most ranges: beyond it they grow,
#: and a task writes more segments.
SEGMENT_IDS = 4 << 20
RANGE_IDS = 4 << 20
MOST_RANGES = 10_000

LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
"""By control byte, the four lengths."""


def filled(counts: np.ndarray) -> np.ndarray:
    return (counts + 3) // 4 * 4


def pack_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and the length of each rank; the ranks are a multiple of four."""
    width = 2 if int(ranks.max(initial=0)) < 1 << 16 else 4
    size = np.ones(len(ranks), dtype=np.uint8)
    for k in range(1, width):
        size += ranks >= np.uint32(1 << 8 * k)
    lanes = (size - 1).reshape(-1, 4)
    control = lanes[:, 0] | lanes[:, 1] << 2 | lanes[:, 2] << 4 | lanes[:, 3] << 6
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return control, data[np.arange(width, dtype=np.uint8) < size[:, None]], size


def pack_documents(ids: np.ndarray, counts: np.ndarray, by_id: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; ids: those of all, counts: how many are whose."""
    spread = filled(counts)
    ranks = np.zeros(int(spread.sum()), dtype=np.uint32)
    shift = np.cumsum(spread) - spread - (np.cumsum(counts) - counts)
    ranks[np.arange(len(ids)) + np.repeat(shift, counts)] = by_id[ids]
    control, data, size = pack_ranks(ranks)
    c_ends, d_ends = np.cumsum(spread) // 4, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(spread)]
    cut = lambda raw, ends: [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return cut(control.tobytes(), c_ends), cut(data.tobytes(), d_ends)


def unpack_ranks(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks, a multiple of four, by looking up the lengths that each control byte stands for."""
    size = LENGTHS[control].reshape(-1)
    starts = np.cumsum(size, dtype=np.int64)
    starts -= size
    ranks = data[starts].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        ranks[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_segment(doc_ids: list, counts: list[int], before: int, control: list[bytes], data: list[bytes]) -> bytes:
    head = np.array([len(doc_ids), sum(map(len, control)), before], dtype="<i8").tobytes()
    names = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + bytes(d is not None for d in doc_ids)
    return b"".join([MAGIC, head, names, np.array(counts, dtype="<i8").tobytes(), *control, *data])


def read_segment(raw: bytes) -> tuple[list, np.ndarray, int, np.ndarray]:
    """Document ids, numbers of ids, ids before it, and the ranks, filled up document by document."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_control, before = (int(x) for x in np.frombuffer(raw, "<i8", 3, 8))
    at = 32
    names, there = np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    at += 9 * n_docs
    counts = np.frombuffer(raw, "<i8", n_docs, at)
    at += 8 * n_docs
    ranks = unpack_ranks(np.frombuffer(raw, np.uint8, n_control, at), np.frombuffer(raw, np.uint8, offset=at + n_control))
    return [int(d) if t else None for d, t in zip(names, there, strict=True)], counts, before, ranks


ENCODED = "doc_id bigint, width int, n bigint, ids binary, counts array<struct<id:bigint,n:bigint>>"
_COUNTS = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def _encode(path: str, spaces_lead: bool, end_id: int):
    """A row per document, and at the end one with the numbers of the task's ids, by id."""

    def run(batches):
        enc, end, total = encoder(path, spaces_lead), end_id.to_bytes(4, "little"), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for step in text_steps(batch):
                raw = [x + end for x in enc.ids(step.column("text").to_pylist())]
                sizes, ids = [len(x) for x in raw], np.frombuffer(b"".join(raw), "<u4")
                width = 2 if int(ids.max()) < 1 << 16 else 4
                held = ids.astype(f"<u{width}")
                found = np.bincount(held)
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) // 4
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends * width), pa.py_buffer(held)])
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array([width] * len(raw), pa.int32()), pa.array(np.diff(ends)), packed.cast(pa.binary()), pa.nulls(len(raw), _COUNTS)], names=["doc_id", "width", "n", "ids", "counts"])
        held = np.flatnonzero(total)
        counts = [{"id": i, "n": n} for i, n in zip(held.tolist(), total[held].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], _COUNTS)], names=["doc_id", "width", "n", "ids", "counts"])

    return run


def part_of(edges: np.ndarray, doc_ids: pa.Array) -> np.ndarray:
    """The range of each id: how many edges are below it; null is in the first."""
    return np.where(np.asarray(doc_ids.is_null()), 0, np.searchsorted(edges, doc_ids.fill_null(0).to_numpy(zero_copy_only=False), side="left"))


def _part_sizes(edges: np.ndarray):
    """The numbers of ids of each range in a batch."""

    def run(batches):
        for batch in batches:
            found = np.bincount(part_of(edges, batch.column("doc_id")), weights=batch.column("n").to_numpy(), minlength=len(edges) + 1)
            held = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(found[held].astype(np.int64))], names=["part", "n"])

    return run


PACKED = "doc_id bigint, part int, n bigint, control binary, data binary"


def _pack(by_id: np.ndarray, edges: np.ndarray):
    """Ids to ranks in variable length, document by document."""

    def run(batches):
        for batch in batches:
            for step in text_steps(batch, "ids"):
                ids = [np.frombuffer(x, f"<u{w}") for w, x in zip(step.column("width").to_pylist(), step.column("ids").to_pylist(), strict=True)]
                counts = np.array([len(x) for x in ids], dtype=np.int64)
                control, data = pack_documents(np.concatenate(ids), counts, by_id)
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(part_of(edges, step.column("doc_id")), pa.int32()), pa.array(counts), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["doc_id", "part", "n", "control", "data"])

    return run


def _segments(before: dict[int, int]):
    """One segment for every SEGMENT_IDS ids or so of a task's documents, which come in order."""

    def run(batches):
        held, size, at = [], 0, None
        for batch in batches:
            for doc_id, part, n, control, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "n", "control", "data")), strict=True):
                at = before[part] if at is None else at
                held.append((doc_id, n, control, data))
                size += n
                if size >= SEGMENT_IDS:
                    yield _segment(held, at)
                    held, size, at = [], 0, at + size
        if held:
            yield _segment(held, at)

    return run


def _segment(held: list[tuple], at: int) -> pa.RecordBatch:
    docs, counts, control, data = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([write_segment(docs, counts, at, control, data)], pa.binary())], names=["segment"])


def _raw_files(df: DataFrame, column: str, path: str) -> None:
    """Each row's bytes as a file of its own, with a line feed at the end."""
    df.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, spaces_lead: bool = True, end_id: int = 0) -> None:
    """Write the ids of every text and `end_id` to files under path, in ascending order of doc_id (null first).

    Ids are counted while texts are encoded, which gives the ranks and the number of ranges; the numbers of ids of each range of
    documents give where a range starts. Then ids are ranked, and each range is sorted and written as segments.
    """
    spark = docs.sparkSession
    encoded = table(id_text(docs).mapInArrow(_encode(tokenizer, spaces_lead, end_id), ENCODED), "token-ids", "snappy")
    counted = encoded.select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [(r["id"], r["n"]) for r in counted.orderBy(F.desc("n"), "id").collect()]
    order, total = [i for i, _ in ranked], sum(n for _, n in ranked)
    by_id = np.zeros(max(order, default=0) + 1, dtype=np.uint32)
    by_id[order] = np.arange(len(order), dtype=np.uint32)

    rows = encoded.where(F.col("counts").isNull())
    n = min(MOST_RANGES, -(-total // RANGE_IDS))
    bounds = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"] if n > 1 else []
    edges = np.array(sorted(set(bounds or [])), dtype=np.int64)
    sizes = {r["part"]: r["n"] for r in rows.select("doc_id", "n").mapInArrow(_part_sizes(edges), "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(sizes):
        before[p] = at
        at += sizes[p]
    _raw_files(spark.createDataFrame([(bytearray(np.array(order, dtype="<u4").tobytes()),)], "ids binary"), "ids", f"{path}/vocabulary")
    dealt = rows.select("doc_id", "width", "ids").mapInArrow(_pack(by_id, edges), PACKED).repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions("doc_id")
    _raw_files(dealt.mapInArrow(_segments(before), "segment binary"), "segment", f"{path}/segments")
    discard(encoded)


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files; with
    `digests`, ids_crc32 in place of ids."""
    order = spark.read.format("binaryFile").load(f"{path}/vocabulary").select("content").first()
    by_rank = np.frombuffer(order["content"][:-1], dtype="<u4")
    last = ("ids_crc32", pa.int64()) if digests else ("ids", pa.binary())

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                docs, counts, before, ranks = read_segment(raw.as_buffer().to_pybytes()[:-1])
                ids = by_rank[ranks]
                starts = np.cumsum(filled(counts)) - filled(counts)
                own = [ids[a : a + c] for a, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                out = [zlib.crc32(x) for x in own] if digests else [x.tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(before + np.cumsum(counts) - counts), pa.array(counts), pa.array(out, last[1])], names=["doc_id", "start", "n_tokens", last[0]])

    schema = f"doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digests else 'ids binary'}"
    return spark.read.format("binaryFile").load(f"{path}/segments").select("content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read back.

    Null or empty text is the end id alone. Repeated rows are written each, next to each other. Null ids come first. An empty
    table gives an empty folder and no rows. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path, digests=True)


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
