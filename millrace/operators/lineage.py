"""Chains of derived tables with manifests that pin their sources: written, read back, derived again and held against what is there."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Derived:
    """A table of a chain: the columns of its key, the names of the tables that it is made from, and how; a root is made from none."""

    name: str
    key: tuple[str, ...]
    sources: tuple[str, ...]
    derive: Callable[[dict[str, DataFrame]], DataFrame]


FOUND = "table string, problem string, key string, n bigint"


def row_text(df: DataFrame) -> Column:
    """A row as JSON, columns in order of names, nulls told from what is not there."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def _halves(df: DataFrame, *more: Column) -> DataFrame:
    """`more` and, as `a` and `b`, two numbers of 60 bits of the MD5 of each row."""
    half = lambda at: F.conv(F.substr("h", F.lit(at), F.lit(15)), 16, 10).cast("bigint")
    hashed = df.select(*more, F.md5(row_text(df)).alias("h"))
    return hashed.select(*(c for c in hashed.columns if c != "h"), half(1).alias("a"), half(16).alias("b"))


def _sums() -> list[Column]:
    """The number of rows and the sums of `a` and `b`, by 20 bits of those, so that they are whole numbers of any count of rows."""
    third = lambda c, at: F.sum(F.shiftright(c, at).bitwiseAND(F.lit((1 << 20) - 1)))
    return [F.count(F.lit(1)).alias("n"), *(third(c, 20 * i).alias(f"{c}{i}") for c in "ab" for i in range(3))]


def _added(row: Row) -> tuple[int, int, int]:
    whole = lambda c: sum((row[f"{c}{i}"] or 0) << 20 * i for i in range(3))
    return row["n"], whole("a"), whole("b")


def _digest(n: int, a: int, b: int) -> str:
    return f"{n}:{a % (1 << 60):015x}:{b % (1 << 60):015x}"


def multiset_digest(df: DataFrame) -> str:
    """A digest of the rows as a multiset, whatever their order, files or partitions: their number and two sums of 60 bits of their MD5."""
    return _digest(*_added(_halves(df).agg(*_sums()).first()))


#: Keys are dealt to so many buckets by their hash; rows of buckets with equal sums on both sides are not compared one by one.
BUCKETS = 4096


def _named(key: Sequence[str]) -> Column:
    return F.to_json(F.array(*(F.col(k).cast("string") for k in key)), {"ignoreNullFields": "false"})


def _bucket(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(BUCKETS)).cast("int")


def differing_buckets(stored: DataFrame, derived: DataFrame, key: Sequence[str]) -> tuple[str, list[int]]:
    """The digest of what is stored, and the buckets of keys in which the two sides are not the same multiset. Only sums by bucket are
    exchanged, and come to the driver: no more than two rows a bucket."""

    def side(df: DataFrame, is_stored: bool) -> DataFrame:
        return _halves(df, _bucket(key).alias("bucket"), F.lit(is_stored).alias("stored"))

    found: dict[bool, dict[int, tuple[int, int, int]]] = {True: {}, False: {}}
    for r in side(stored, True).unionByName(side(derived, False)).groupBy("bucket", "stored").agg(*_sums()).collect():
        found[r["stored"]][r["bucket"]] = _added(r)
    ours, theirs = found[True], found[False]
    return _digest(*(sum(s[i] for s in ours.values()) for i in range(3))), sorted(x for x in ours.keys() | theirs.keys() if ours.get(x) != theirs.get(x))


def row_differences(stored: DataFrame, derived: DataFrame, key: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
    """(key, problem) of the keys whose rows are not the same multiset on both sides: `changed`, `surplus` (stored, not derived) or
    `missing`. The key is the JSON of its columns. One exchange: rows of both sides, of `buckets` if they are given, are summed, as
    +1 and -1, by key and content."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        if buckets is not None:
            df = df.where(_bucket(key).isin(list(buckets)))
        return df.select(_named(key).alias("key"), F.md5(row_text(df)).alias("h"), F.lit(sign).alias("d"))

    both = side(stored, 1).unionByName(side(derived, -1)).groupBy("key", "h").agg(F.sum("d").alias("d")).where("d <> 0")
    more, less = F.max("d") > 0, F.min("d") < 0
    return both.groupBy("key").agg(F.when(more & less, "changed").when(more, "surplus").otherwise("missing").alias("problem"))


class Chain:
    """Tables in a folder, each written after its sources, with a manifest: its digest and the digests of the sources it was made from."""

    def __init__(self, spark: SparkSession, folder: str, tables: Sequence[Derived]):
        self.spark, self.folder, self.tables = spark, folder, list(tables)
        names: set[str] = set()
        for t in self.tables:
            if not names.issuperset(t.sources) or t.name in names:
                raise ValueError(f"{t.name}: sources come first, and names are there once")
            names.add(t.name)

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/rows")

    def manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}/manifest").first()["value"])

    def put_manifest(self, name: str, digest: str, pins: dict[str, str]) -> None:
        text = json.dumps({"digest": digest, "sources": pins}, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}/manifest")

    def put_rows(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/rows")

    def write(self) -> None:
        for t in self.tables:
            self.put_rows(t.name, t.derive({s: self.stored(s) for s in t.sources}))
            self.put_manifest(t.name, multiset_digest(self.stored(t.name)), {s: self.manifest(s)["digest"] for s in t.sources})

    def verify(self) -> DataFrame:
        """FOUND of all that is wrong, nothing if all is right. For each table: whether its rows have the digest of its manifest; whether
        the manifest pins the digests that the manifests of the sources have; and, derived again from its sources as they are stored,
        which rows differ: the least key of each kind, and how many keys there are. A change thus shows at the table that was
        changed, and at those made from it."""
        manifests = {t.name: self.manifest(t.name) for t in self.tables}
        said, differing = [], []
        for t in self.tables:
            own = manifests[t.name]
            stored, derived = self.stored(t.name), t.derive({s: self.stored(s) for s in t.sources})
            digest, buckets = differing_buckets(stored, derived, t.key)
            if digest != own["digest"]:
                said.append((t.name, "rows differ from the manifest", None, None))
            for s in sorted(set(t.sources) | set(own["sources"])):
                if own["sources"].get(s) != manifests.get(s, {}).get("digest"):
                    said.append((t.name, f"pins other rows of {s}", None, None))
            if not buckets:
                continue
            rows = row_differences(stored, derived, t.key, buckets)
            differing.append(rows.groupBy("problem").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).select(F.lit(t.name).alias("table"), "problem", "key", "n"))
        out = self.spark.createDataFrame(said, FOUND)
        for rows in differing:
            out = out.unionByName(rows)
        return out

    def load(self, name: str) -> DataFrame:
        """The rows of a table, if it and all that it was made from are as they were written; anything else is an error."""
        needed, order = {name}, {t.name: t for t in self.tables}
        for t in reversed(self.tables):
            if t.name in needed:
                needed |= set(order[t.name].sources)
        wrong = Chain(self.spark, self.folder, [t for t in self.tables if t.name in needed]).verify().orderBy("table", "problem").first()
        if wrong is not None:
            raise ValueError(f"{wrong['table']}: {wrong['problem']}" + (f" at {wrong['key']}" if wrong["key"] else ""))
        return self.stored(name)
