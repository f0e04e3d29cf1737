"""Content hashes: canonical JSON, derived identifiers and hashes of ordered lists."""

from __future__ import annotations

import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .jsontext import exact_json


def canonical_json(record: Column) -> Column:
    """JSON of a struct or map with sorted keys, also of what is nested in it, and nulls kept."""
    return sorted_json(F.to_json(record, {"ignoreNullFields": "false"}))


def sorted_json(text: Column) -> Column:
    """JSON text with sorted keys at all depths, no spaces, and numbers as written; null for what is no JSON."""
    return exact_json(text)


def content_hash(*parts: Column, separator: str = "\x1f") -> Column:
    """MD5 of the parts as text; null counts as the text <null>, so it differs from empty."""
    return F.md5(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("<null>")) for p in parts)))


def derived_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(content_hash(*parts), 1, 32))


def ordered_hash(ordinal: Column, child: Column) -> Column:
    """Aggregate: hash of the children in the order of their ordinal."""
    ordered = F.array_sort(F.collect_list(F.struct(ordinal.alias("o"), child.alias("h"))))
    return F.md5(F.array_join(F.transform(ordered, lambda x: x["h"]), "\n"))


def normalized_text(text: Column) -> Column:
    """Compatibility forms (NFKC) and lower case, white space of any kind as single spaces, ends trimmed.

    Spark has no Unicode normalization: texts with more than ASCII go through an Arrow function, which others pass as nulls.
    """
    is_ascii = text.rlike(r"\A\p{ASCII}*\z")

    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))

    native = F.lower(F.trim(F.regexp_replace(text, r"[\s\x0b\x1c-\x1f]+", " ")))
    return F.when(is_ascii, native).otherwise(F.pandas_udf(folded, StringType())(F.when(~is_ascii, text)))


def content_digest(content: Column) -> Column:
    """`xxh64:` and the sixteen hex digits of xxHash64 with seed 0 of the bytes, or of a text in UTF-8; null for null.

    Spark's own function has another seed, so this one works on Arrow batches. Meant for digests that others must be able to compute;
    keys inside a job are cheaper by `content_hash`.
    """

    def digests(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else f"xxh64:{xxhash.xxh64_hexdigest(b)}")

    return F.pandas_udf(digests, StringType())(content.cast("binary"))
