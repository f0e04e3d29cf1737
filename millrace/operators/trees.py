"""Directory trees: bounded listings, digests of every folder, and where two trees differ."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import cut


def listed(spark: SparkSession, folder: str, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(path, size, content_md5) of the files under a folder that are at most `depth` levels down (1: in the folder itself), the first
    `most` in the order of their paths; and one row (n, truncated) that tells how many there are at that depth, and whether some are
    left out. Links to other places are not followed: the listing is that of Spark's own file index, which only sees what is
    stored under the folder.

    Only paths are sorted; contents are read, once, of the files that stay. Spark's reader passes over empty files, so paths are taken
    from the file index, which the driver holds for any scan, and what has no content there is empty.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = lambda path: path.split(":", 1)[-1].lstrip("/")
    root = plain(folder).rstrip("/") + "/"
    named = [(plain(unquote(p)).removeprefix(root), plain(unquote(p))) for p in found.inputFiles()]
    files = spark.createDataFrame(named, "path string, at string").where(F.size(F.split("path", "/")) <= depth)
    kept = files.orderBy("path").limit(most)
    counted = files.agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.col("n") > most)
    at = F.regexp_replace("path", "^[a-z]+:/*", "").alias("at")
    contents = found.select(at, F.col("length").alias("size"), F.md5("content").alias("content_md5"))
    rows = kept.join(contents, "at", "left")
    return rows.select("path", F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("content_md5", F.md5(F.lit(""))).alias("content_md5")), counted


def folder_digests(files: DataFrame) -> DataFrame:
    """(path, digest, n_files) of every folder of trees of files (path, content_md5), the root as the empty path; folders are those that hold
    a file somewhere below.

    Of what a folder holds, `file <name> <digest>` and `folder <name> <digest>` are hashed by MD5; the folder's digest is the MD5 of how many
    these are and of two sums of 60 bits of them, which any order gives and which are summed before they are exchanged, however much
    a folder holds. It changes with any name or content below and with nothing else. Folders are worked out level by level, the
    deepest first: a round for each level, each over the entries of one level only.
    """
    half = lambda at: F.sum(F.conv(F.substr("h", F.lit(at), F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string")
    entries = files.select(F.split("path", "/").alias("parts"), F.col("content_md5").alias("digest"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("n_files"))
    entries = cut(entries.select(F.size("parts").alias("level"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/").alias("parent"), F.element_at("parts", -1).alias("name"), "digest", "kind", "n_files"))
    deepest = entries.agg(F.max("level").alias("d")).first()["d"] or 0
    below, out = None, None
    for level in range(deepest, 0, -1):
        here = entries.where(F.col("level") == level).select("parent", "name", "digest", "kind", "n_files")
        held = here if below is None else here.unionByName(below)
        held = held.withColumn("h", F.md5(F.concat_ws(" ", "kind", "name", "digest")))
        digest = F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1), half(16)))
        found = cut(held.groupBy(F.col("parent").alias("path")).agg(digest.alias("digest"), F.sum("n_files").alias("n_files")))
        out = found if out is None else out.unionByName(found)
        below = found.select(F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "digest", F.lit("folder").alias("kind"), "n_files")
    if out is None:
        return files.sparkSession.createDataFrame([], "path string, digest string, n_files long")
    return out


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of the folders and files, by digest (path, digest), that are `added`, `removed` or `changed`."""
    both = before.select("path", F.col("digest").alias("b")).join(after.select("path", F.col("digest").alias("a")), "path", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def numbered(df: DataFrame, order: list[str], name: str = "at", partitions: int | None = None) -> DataFrame:
    """df with the place of each row, from 0, in the order of all: rows are dealt by ranges of the order and sorted there; a row's place is
    its place in its partition and the numbers of rows in the partitions before. Only these numbers, one for each partition, meet in
    one task. Rows that are equal in `order` get their places in any order, so it should tell rows apart."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("__part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"))
    return dealt.join(F.broadcast(shifts), "__part").select(*df.columns, (F.col("__id") + F.col("__shift")).alias(name))


def zipped(left: DataFrame, right: DataFrame, order: list[str], compared: list[str]) -> DataFrame:
    """(at, <column>_left, <column>_right, side, same): rows of two tables by their place in the order of each. side is `both`, `left` or
    `right`: what one table has more is no error but a row."""
    sides = [numbered(df, order).select("at", *(F.col(c).alias(f"{c}_{s}") for c in compared), F.lit(True).alias(f"__{s}")) for df, s in ((left, "left"), (right, "right"))]
    rows = sides[0].join(sides[1], "at", "full")
    side = F.when(F.col("__right").isNull(), "left").when(F.col("__left").isNull(), "right").otherwise("both")
    same = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    for c in compared:
        same = same & F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))
    return rows.select("at", *(f"{c}_{s}" for c in compared for s in ("left", "right")), side.alias("side"), F.coalesce(same, F.lit(False)).alias("same"))


def first_mismatch(zipped_rows: DataFrame) -> DataFrame:
    """The first row of a zip that is not the same on both sides; none if all are."""
    return zipped_rows.where("not same").orderBy("at").limit(1)
