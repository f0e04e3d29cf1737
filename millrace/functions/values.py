"""Parsers and writers of small text formats, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import pointed_json

#: Seconds in each unit of a duration.
UNIT_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(text: Column) -> Column:
    """`<number><ms|s|m|h>` in seconds; null for anything else."""
    found = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)$", 1)
    unit = F.regexp_extract(text, "(ms|s|m|h)$", 1)
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair]), F.when(unit != "", unit))
    return F.when(found != "", found.cast("double") * scale)


def pointed(document: Column, pointer: Column) -> Column:
    """The value that a JSON pointer (`/a/0/b`, with ~1 for / and ~0 for ~) leads to, as text: strings as they are, others as exact JSON
    (a JSON null is the text null); null if it leads nowhere. A segment is the name of a member, or the index of an item; the empty
    pointer is the document as it is written."""
    found = pointed_json(document, pointer)
    return F.when(pointer == "", document).when(found.startswith('"'), F.try_variant_get(F.try_parse_json(found), "$", "string")).otherwise(found)


def query_text(parameters: Column) -> Column:
    """A map as `k=v` pairs, sorted by key, in percent-encoding of all but letters, digits and -._~."""
    strict = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(strict(e["key"]), F.lit("="), strict(e["value"]))), "&")


def relative_path(path: Column) -> Column:
    """The path without empty and `.` segments and with `..` resolved; null if it leads above its root or is absolute; `.` for none."""
    kept = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.lit(None).cast("array<string>")
    up = lambda held: F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(none)
    parts = F.aggregate(kept, F.array().cast("array<string>"), lambda held, x: F.when(held.isNull(), none).when(x == "..", up(held)).otherwise(F.concat(held, F.array(x))))
    return F.when(~path.startswith("/"), F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/")))


def expanded(template: Column, values: Column) -> Column:
    """`${name}` replaced by the value of that name, `$$` by one dollar, in one pass: what a value holds is not looked at again. Null
    if a name has no value."""
    parts = F.regexp_extract_all(template, F.lit(r"(?s)\$\$|\$\{[A-Za-z_][A-Za-z0-9_]*\}|[^$]+|\$"), 0)
    one = lambda x: F.when(x == "$$", F.lit("$")).when(x.startswith("${"), F.try_element_at(values, F.regexp_extract(x, r"^\$\{(.*)\}$", 1))).otherwise(x)
    found = F.transform(parts, one)
    return F.when(~F.exists(found, lambda x: x.isNull()), F.array_join(found, ""))


def assignments(text: Column) -> Column:
    """`KEY=value` lines as an array of (key, value) in order; blank lines and those that start with # do not count. A value in double
    quotes keeps its spaces and has \\" and \\\\ unescaped. Null if a line is none of these or a key is there twice."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: (x != "") & ~x.startswith("#"))
    quoted = lambda v: F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")
    value = lambda v: F.when(v.rlike(r'^"(?:[^"\\]|\\.)*"$'), quoted(v)).when(~v.rlike(r"[\"\s]"), v)
    pair = lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z_][A-Za-z0-9_]*)=", 1).alias("key"), value(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value"))
    pairs = F.transform(lines, pair)
    right = ~F.exists(pairs, lambda p: (p["key"] == "") | p["value"].isNull()) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs))
    return F.when(right, pairs)


def merged_headers(defaults: Column, overrides: Column) -> Column:
    """Two arrays of (name, value): defaults in their order, with the spelling and the value of an override whose name differs at most
    in letter case, then the other overrides in their order."""
    low = lambda x: F.lower(x["name"])
    override = lambda d: F.coalesce(F.get(F.filter(overrides, lambda o: low(o) == low(d)), 0), d)
    return F.concat(F.transform(defaults, override), F.filter(overrides, lambda o: ~F.exists(defaults, lambda d: low(d) == low(o))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Float division; a denominator of zero fails the job."""
    return F.when(denominator == 0, F.raise_error(F.lit("division by zero"))).otherwise(numerator.cast("double") / denominator)


def utf8_batches(texts: Column, most: int, most_bytes: int) -> Column:
    """By text, in order, the number of the greedy batch that it is in: a new one starts where the open one would hold more than `most`
    texts or `most_bytes` bytes. A text that is too large for any batch fails the job."""

    def put(held: Column, text: Column) -> Column:
        size = F.octet_length(text)
        fits = (held["n"] < most) & (held["bytes"] + size <= most_bytes)
        number = F.when(fits, held["number"]).otherwise(held["number"] + 1)
        too_large = F.when(size > most_bytes, F.raise_error(F.lit("a text is larger than a batch")).cast("int")).otherwise(number)
        return F.struct(too_large.alias("number"), F.when(fits, held["n"] + 1).otherwise(1).alias("n"), F.when(fits, held["bytes"] + size).otherwise(size).alias("bytes"), F.concat(held["out"], F.array(number)).alias("out"))

    start = F.struct(F.lit(-1).alias("number"), F.lit(most).alias("n"), F.lit(0).alias("bytes"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(texts, start, put)["out"]


def stable_order(nodes: Column, needs: Column, fail: bool = False) -> Column:
    """The nodes so that each comes after what it needs, the earliest given one first among those that are ready; null if there is a
    cycle or a need that is no node, with `fail` an error. nodes: array; needs: array of (node, needed)."""
    ready = lambda done: lambda x: ~F.array_contains(done, x) & ~F.exists(needs, lambda e: (e["node"] == x) & ~F.array_contains(done, e["needed"]))
    done = F.aggregate(nodes, F.array().cast("array<string>"), lambda held, _: F.concat(held, F.slice(F.filter(nodes, ready(held)), 1, 1)))
    told = F.raise_error(F.concat(F.lit("no order for "), F.array_join(F.array_except(nodes, done), ", "))).cast("array<string>")
    return F.when(F.size(done) == F.size(nodes), done).otherwise(told if fail else F.lit(None).cast("array<string>"))
