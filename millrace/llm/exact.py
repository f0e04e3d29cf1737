"""Exact deduplication against a minimal perfect hash of the digests already known.

The digests of earlier documents (the history) are distinct after one pre-aggregated grouping. They are dealt to shards by
digest; each shard becomes a minimal perfect hash: level after level, every digest that has a bit position to itself takes it,
the others go on to the next level, and the rank of a digest's bit is its slot. A slot holds the full 32-byte digest and the
locator of the group's winner. New digests, grouped likewise, probe their shard: where the slot's 32 bytes equal the probe's
it is a repeat and joins the slot's group; everything else is no member and forms groups of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, documents, id_text, table

#: Distinct digests that a shard of the index is meant to hold.
SHARD_DIGESTS = 50_000
#: Bit positions per digest on each level.
ROOM = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8")


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A position for each digest on a level: two of its words, mixed anew for each level."""
    x = words[:, 1] + words[:, 2] * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """slot(digests) is each one's number from 0 to n - 1 if it is a member; any number or -1 if not."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits) - bits

    @classmethod
    def over(cls, digests: np.ndarray) -> PerfectHash:
        words, sizes, levels = _words(digests), [], []
        while len(words):
            size = max(2, ROOM * len(words))
            at = _place(words, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            words = words[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def slot(self, digests: np.ndarray) -> np.ndarray:
        words, found = _words(digests), np.full(len(digests), -1, dtype=np.int64)
        left, base = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(words[left], level, size)
            hit = self.bits[at]
            found[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        return found


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, 32)


INDEX = "shard int, sizes array<bigint>, bits binary, digests binary, keep_id array<bigint>, n_points array<bigint>, n array<bigint>"
WINNER = "digest binary, keep_id bigint, group_size bigint, keep_points bigint"


def _build(groups: pa.Table) -> pa.Table:
    digests = _digests(groups["digest"])
    mph = PerfectHash.over(digests)
    order = np.argsort(mph.slot(digests))
    rows = groups.take(pa.array(order))
    one = {"shard": [groups["shard"][0].as_py()], "sizes": [mph.sizes], "bits": [np.packbits(mph.bits).tobytes()], "digests": [digests[order].tobytes()]}
    one |= {c: [rows[c].to_pylist()] for c in ("keep_id", "n_points", "n")}
    return pa.table([pa.array(one[c], t) for c, t in (("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()), ("keep_id", pa.list_(pa.int64())), ("n_points", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())))], names=list(one))


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, id) the one with more code points, then with the smaller id; an id of null comes last."""
    return max(a, b, key=lambda x: (x[0], x[1] is not None, ~(x[1] or 0)))


def _probe(new: pa.Table, index: pa.Table) -> pa.Table:
    """Winners of one shard: the groups of the history with the repeats that joined them, and the groups of no member."""
    fresh = list(zip(new["n_points"].to_pylist(), new["keep_id"].to_pylist(), new["n"].to_pylist(), strict=True))
    digests = _digests(new["digest"]) if len(fresh) else np.zeros((0, 32), dtype=np.uint8)
    kept, slots = [], np.zeros((0, 32), dtype=np.uint8)
    member = np.zeros(len(fresh), dtype=bool)
    if index.num_rows:
        row = index.to_pylist()[0]
        slots = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, 32)
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=sum(row["sizes"])).astype(bool)
        kept = list(zip(row["n_points"], row["keep_id"], row["n"], strict=True))
        at = PerfectHash(row["sizes"], bits).slot(digests)
        member = at >= 0
        member[member] = (slots[at[member]] == digests[member]).all(axis=1)
        for i in np.flatnonzero(member):
            s = at[i]
            kept[s] = (*_better(kept[s][:2], fresh[i][:2]), kept[s][2] + fresh[i][2])
    groups = kept + [x for x, m in zip(fresh, member, strict=True) if not m]
    names = [bytes(d) for d in slots] + [bytes(d) for d in digests[~member]]
    return pa.table({"digest": pa.array(names, pa.binary()), "keep_id": pa.array([g[1] for g in groups], pa.int64()), "group_size": pa.array([g[2] for g in groups], pa.int64()), "keep_points": pa.array([g[0] for g in groups], pa.int64())})


def exact_dedup(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so without white space (`common.BLANKS`). Of equal ones the one with the most code points
    stays, then the one with the smallest doc_id. `history` says of a document whether it belongs to those already indexed;
    by default, half of the ids by their CRC. The result does not depend on it.

    Null text counts as empty, and all empty texts are one group. A document without id loses ties and stays only if its group
    has no other best. Rows that repeat the same id and text count each in group_size and share their verdict; of texts of one id
    that are equal but for white space only the longest is kept. Any id will do, the least of all too. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    history = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0 if history is None else history
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(history, F.lit(False)).alias("old"))
    rows = rows.select("doc_id", F.unhex(F.sha2(F.translate("text", BLANKS, ""), 256)).alias("digest"), F.length("text").cast("long").alias("n_points"), "old")
    rows = table(rows, "exact-digests")
    shards = max(1, -(-rows.count() // SHARD_DIGESTS))
    low = F.bitwise_not("doc_id")  # turns the order round, and no id overflows
    best = F.max(F.struct("n_points", low.alias("low"))).alias("best")

    def grouped(part: DataFrame) -> DataFrame:
        found = part.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
        shard = F.pmod(F.crc32("digest"), F.lit(shards)).cast("int").alias("shard")
        return found.select(shard, "digest", F.bitwise_not("best.low").alias("keep_id"), F.col("best.n_points").alias("n_points"), "n")

    index = grouped(rows.where("old")).groupBy("shard").applyInArrow(_build, INDEX)
    winners = grouped(rows.where("not old")).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, WINNER)
    repeated = table(winners.where("group_size > 1"), "exact-winners")
    out = rows.join(repeated, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.col("group_size").isNull() | keep.eqNullSafe(F.col("doc_id")) & (F.col("n_points") == F.col("keep_points"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
