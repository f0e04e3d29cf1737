"""JSONL tables with a manifest: row count and content hash are checked when a table is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_digest(df: DataFrame) -> tuple[int, int]:
    """Row count and the sum of row hashes (modulo 2**64), which does not depend on order or files."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0) % (1 << 64)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows and, beside them, a manifest. An existing table is an error unless overwrite is set."""
    mode = "overwrite" if overwrite else "error"
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/rows")
    spark = df.sparkSession
    n, digest = content_digest(read_rows(spark, f"{path}/rows", T.StructType(sorted(df.schema.fields, key=lambda f: f.name))))
    spark.createDataFrame([(n, str(digest))], "row_count bigint, digest string").coalesce(1).write.mode(mode).json(f"{path}/manifest")


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSONL folder; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows whose count and hash are those of the manifest; anything else is an error."""
    want = spark.read.schema("row_count bigint, digest string").json(f"{path}/manifest").first()
    rows = read_rows(spark, f"{path}/rows", T.StructType(sorted(schema.fields, key=lambda f: f.name)))
    n, digest = content_digest(rows)
    if want is None or (n, str(digest)) != (want["row_count"], want["digest"]):
        raise ValueError(f"{path}: rows do not agree with the manifest")
    return rows
