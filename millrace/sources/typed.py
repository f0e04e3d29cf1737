"""Typed scans of JSON lines: every record checked against named fields, every rejected line told by file, line number and reason."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsontext import bound, parsed

#: The type that a JSON value of each kind shows; whole numbers of any size are numbers without a fraction.
KINDS = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
AS_TYPE = {"string": "string", "integer": "decimal(38,0)", "number": "double", "boolean": "boolean", "object": "variant", "array": "variant"}


@dataclass(frozen=True)
class Field:
    """A field of a record: its kind (KINDS), whether it must be there, whether it may be null, and what must hold for its value,
    by name of the rule; `as_type` overrides the column type of the kind, and `default` is for decoders that fill in what is not there."""

    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    rules: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    as_type: str | None = None
    default: object = None

    @property
    def column_type(self) -> str:
        return self.as_type or AS_TYPE[self.kind]

    @property
    def path(self) -> str:
        if "'" in self.name and '"' in self.name:
            raise ValueError(f"no path leads to a name with both kinds of quotes: {self.name}")
        return f'$["{self.name}"]' if "'" in self.name else f"$['{self.name}']"


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line, value) of text files: the number of each line in its file, from 1, also where a file is read in blocks by many tasks.

    Rows of a block are read in order, so a line's number is its place among the rows of its block, which the running number of the
    task's rows tells, and the lines of the blocks before it in its file. Only the number of lines of each block is exchanged.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    # A row for each block of a file: no more than the driver lists to read the files.
    return raw.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def held_in(field: Field, record: Column) -> Column:
    """A struct of what a field holds: kind (null if it is not there), and the value in the type of the column, if it can be."""
    held = F.try_variant_get(record, field.path, "variant")
    return F.struct(type_of(held).alias("kind"), F.try_variant_get(record, field.path, field.column_type).alias("value"))


def problem_of(field: Field, record: Column) -> Column:
    """What is wrong with one field of a record, or null."""
    return bound(held_in(field, record), lambda held: _problem(field, held))


def _problem(field: Field, held: Column) -> Column:
    kind, value = held["kind"], held["value"]
    say = lambda text: F.lit(f"{field.name}: {text}")
    found = F.when(kind.isNull(), say("missing") if field.required else F.lit(None))
    found = found.when(kind == "VOID", F.lit(None) if field.nullable else say("null"))
    found = found.when(~kind.rlike(f"^({KINDS[field.kind]})$") | value.isNull(), say(f"no {field.kind}"))
    for name, holds in field.rules:
        found = found.when(~F.coalesce(holds(value), F.lit(False)), say(name))
    return found


def scan(spark: SparkSession, path: str | Sequence[str], fields: Sequence[Field], blank: str = "skip", closed: bool = True) -> DataFrame:
    """(file, line, reason, and a column for each field) of every line of JSONL files.

    reason is null for accepted records, else the first thing wrong: `blank line` (only with blank='error'; else blank lines are
    passed over), `no JSON`, `no object`, `unknown field <name>` (if closed: the first in order of names), or `<field>: <what>` of the first
    field in the order given. Fields of rejected lines are null. An object that has a name twice is no JSON.
    """
    lines = numbered_lines(spark, path)
    is_blank = F.trim(F.col("value"), F.lit(" \t\r\f\x0b")) == ""
    if blank == "skip":
        lines = lines.where(~is_blank)
    at = [f"f{i}" for i in range(len(fields))]

    def strange() -> Column:
        if not closed:
            return F.lit(None).cast("string")
        return F.array_min(F.array_except(F.json_object_keys("value"), F.array(*(F.lit(f.name) for f in fields))))

    def told(seen: Column) -> Column:
        """The reason and the fields, from what was seen in a line."""
        reason = F.coalesce(seen["shape"], F.concat(F.lit("unknown field "), seen["strange"]), *(_problem(f, seen[n]) for f, n in zip(fields, at, strict=True)))
        values = lambda why: [F.when(why.isNull(), seen[n]["value"]).alias(n) for n in at]
        return bound(reason, lambda why: F.struct(why.alias("reason"), *values(why)))

    def seen(record: Column) -> Column:
        shape = F.when(is_blank, "blank line").when(record.isNull(), "no JSON").when(~type_of(record).startswith("OBJECT"), "no object")
        return bound(shape, lambda s: F.struct(s.alias("shape"), F.when(s.isNull(), strange()).alias("strange"), *(held_in(f, record).alias(n) for f, n in zip(fields, at, strict=True))))

    # What is asked of the outcome is not asked of a copy of all this: filters stay above the generator.
    lines = lines.select("file", "line", F.explode(F.array(bound(bound(parsed(F.col("value")), seen), told))).alias("told"))
    return lines.select("file", "line", "told.reason", *(F.col(f"told.{n}").alias(f.name) for f, n in zip(fields, at, strict=True)))


def accepted(scanned: DataFrame, fail: bool = False) -> DataFrame:
    """The records of a scan that are right; with `fail`, any other line is an error that names its file, line and reason."""
    if not fail:
        return scanned.where("reason is null").drop("reason")
    told = F.raise_error(F.format_string("%s:%d: %s", "file", "line", "reason"))
    return scanned.where(F.col("reason").isNull() | told.cast("boolean")).drop("reason")


def rejected(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason is not null").select("file", "line", "reason")
