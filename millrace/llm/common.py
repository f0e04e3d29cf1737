"""Helpers that the operators of this folder share: the shared folder, Arrow text access, byte-balanced batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that count as white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode without it, a folder made here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _made[0], True)
    return f"file://{_made[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: later steps start there, whichever executor is lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables written by `table` that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of input files for each of which a shuffle that is dealt out by number gets a partition at least.
SHARE_BYTES = 32 << 20


def _input_sizes(docs: DataFrame) -> list[int]:
    """Bytes of what docs reads; rows that are not from files count as endless."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]


def in_tasks_of(docs: DataFrame, size: int) -> DataFrame:
    """docs in fewer, larger tasks, without a shuffle: of `size` bytes of input files each, but not fewer than cores. If a size is
    not known, docs as it is."""
    sizes = _input_sizes(docs)
    if any(x >= 1 << 60 for x in sizes):
        return docs
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // size)))


def partitions(docs: DataFrame) -> int:
    """How many partitions to deal rows made from docs to: as the session says, and more if the files that docs reads are large."""
    known = sum(x for x in _input_sizes(docs) if x < 1 << 60)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // SHARE_BYTES))


def free_name(taken, name: str) -> str:
    """`name`, with as many underscores behind it as make it none of the names taken; names that differ in case only are one."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; whatever other columns are called, they are gone."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pool(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its rows in them (one more than rows); null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges (i, j) whose bytes together stay under limit; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_steps(batch: pa.RecordBatch, name: str = "text", limit: int = STEP_BYTES):
    """Slices of a batch, balanced by the bytes of one column."""
    if not batch.num_rows:
        return
    _, offsets = pool(batch.column(name))
    for i, j in by_bytes(offsets, limit):
        yield batch.slice(i, j - i)


def tidied(work):
    """work, a function on record batches, that gives back at its end what its worker process holds free: workers stay for later
    tasks, and those that idle should take little."""

    def run(batches):
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
