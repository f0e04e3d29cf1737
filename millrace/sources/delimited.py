"""Comma-separated tables whose header and rows are checked: names that are there once, no ragged rows, no open quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .typed import numbered_lines

_FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^,"]*+'
_WHOLE = rf"\A(?:{_FIELD})(?:,(?:{_FIELD}))*+\z"


def fields_of(line: Column) -> Column:
    """The fields of one line, quotes taken away and doubled ones made single; null if a quote is open or stands inside a field."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_FIELD})"), F.lit(1))
    plain = F.transform(parts, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(line.rlike(_WHOLE), plain)


def scan_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(file, line, reason, and the columns asked for, in that order) of the rows of CSV files, each with a header of its own.

    reason is null for right rows, else `open quote`, `<n> fields of <m>`, or what is wrong with the file's header, which fails all of
    its rows: `header: open quote`, `header: twice <name>`, `header: no <name>`. Lines without any character are passed over; a line is a
    row, so a quoted line feed is an open quote. All columns are text.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    heads = lines.where("line = 1").select("file", fields_of(F.col("value")).alias("names"))
    twice = F.get(F.filter("names", lambda x: F.size(F.filter(F.col("names"), lambda y: x == y)) > 1), 0)
    absent = F.get(F.filter(F.array(*map(F.lit, columns)), lambda x: ~F.array_contains("names", x)), 0)
    wrong = F.when(F.col("names").isNull(), "header: open quote").when(twice.isNotNull(), F.concat(F.lit("header: twice "), twice)).when(absent.isNotNull(), F.concat(F.lit("header: no "), absent))
    heads = heads.withColumn("wrong", wrong)
    rows = lines.where("line > 1 and value <> ''").join(heads, "file").withColumn("fields", fields_of(F.col("value")))
    ragged = F.when(F.size("fields") != F.size("names"), F.format_string("%d fields of %d", F.size("fields"), F.size("names")))
    rows = rows.withColumn("reason", F.coalesce("wrong", F.when(F.col("fields").isNull(), "open quote").otherwise(ragged)))
    value = lambda c: F.get("fields", (F.array_position("names", c) - 1).cast("int"))
    return rows.select("file", "line", "reason", *(F.when(F.col("reason").isNull(), value(c)).alias(c) for c in columns))
