"""Markers of private material, and looking for them in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN_REF = "[hidden]"


def path_markers(path: Column) -> Column:
    """A path and all folders above it, the deepest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def field_markers(name: str) -> Column:
    """The ways in which a field's name stands in structured text: before a colon, or quoted. The bare word is no marker."""
    return F.array(F.lit(f"{name}:"), F.lit(f'"{name}"'), F.lit(f"'{name}'"))


def touched(text: Column, markers: Column) -> Column:
    """Whether the text holds one of the markers; empty ones do not count."""
    return F.exists(markers, lambda m: (m != "") & F.contains(text, m))


def canary_hash(canary: Column) -> Column:
    """Null for no canary."""
    return F.md5(canary)


def redacted_ref(ref: Column, canary: Column) -> Column:
    """A reference without the canary in it; an empty one fails the job."""
    return F.when(ref == "", F.raise_error(F.lit("a reference is empty"))).otherwise(F.replace(ref, canary, F.lit(HIDDEN_REF)))
