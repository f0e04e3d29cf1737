"""Text predicates, normalizers and parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of our own: what a normalizer puts in place of volatile parts.
PLACEHOLDERS = {"tag": "{tag}", "number": "{n}", "url": "{url}", "email": "{email}"}


def normalized_page(html: Column) -> Column:
    """Page source with line ends unified, URLs, tags and numbers replaced, in this order, and white space collapsed."""
    text = F.regexp_replace(html, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"https?://[^\s\"'<>]+", PLACEHOLDERS["url"])
    text = F.regexp_replace(text, r"</?[a-zA-Z][^>]*>", PLACEHOLDERS["tag"])
    text = F.regexp_replace(text, r"[0-9]+", PLACEHOLDERS["number"])
    return F.trim(F.regexp_replace(text, r"[ \t\n]+", " "))


def redacted(text: Column, limit: int) -> Column:
    """Text without e-mail addresses, cut to `limit` characters."""
    return F.substring(F.regexp_replace(text, r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", PLACEHOLDERS["email"]), 1, limit)


def has_line(text: Column, prefix_pattern: str) -> Column:
    """Whether some line starts with the pattern."""
    return text.rlike(f"(^|\n){prefix_pattern}")


def percentage(n: Column, total: Column) -> Column:
    """`n/N (p%)` with one decimal, empty text for a total of 0, null where one is not known."""
    share = F.format_string("%d/%d (%s%%)", n, total, F.round(100 * n.cast("decimal(20,0)") / total, 1).cast("decimal(10,1)").cast("string"))
    return F.when(total == 0, F.lit("")).when(n.isNotNull() & total.isNotNull(), share)


def counts_text(names: Column, counts: Column) -> Column:
    """Aggregate: sorted `name=count` pairs, joined by a comma."""
    return F.array_join(F.array_sort(F.collect_list(F.concat(names, F.lit("="), counts.cast("string")))), ", ")


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def version_key(version: Column) -> Column:
    """A sortable struct of a three-part version with optional prerelease; build metadata does not count.

    A release sorts after its prereleases. Prerelease identifiers are compared from left to right: numbers by value and before
    texts, texts by character, and a list before the longer ones that it begins.
    """
    plain = F.split_part(version, F.lit("+"), F.lit(1))
    core, pre = F.regexp_extract(plain, "^([^-]*)", 1), F.regexp_extract(plain, "-(.*)$", 1)
    parts = [F.split_part(core, F.lit("."), F.lit(i)).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2, 3)]
    named = lambda x: F.struct((~x.rlike("^[0-9]+$")).alias("is_text"), F.when(x.rlike("^[0-9]+$"), x.cast("decimal(38,0)")).alias("number"), x.alias("text"))
    return F.struct(*parts, (pre == "").alias("release"), F.transform(F.split(pre, r"\."), named).alias("pre"))


def scope_matches(pattern: Column, value: Column) -> Column:
    """`*`, the same text, or a prefix of whole colon segments."""
    return (pattern == "*") | (pattern == value) | F.startswith(value, F.concat(pattern, F.lit(":")))


def first_difference(left: Column, right: Column) -> Column:
    """The place, from 0, of the first character in which the texts differ: the shorter length if one begins the other, null if they are
    equal. Halves the range until it is found, so that long texts take few steps."""
    bounds = F.struct(F.lit(0).alias("lo"), F.least(F.length(left), F.length(right)).alias("hi"))
    middle = lambda b: F.floor((b["lo"] + b["hi"] + 1) / 2).cast("int")
    agree = lambda b: F.substring(left, F.lit(1), middle(b)) == F.substring(right, F.lit(1), middle(b))
    halved = lambda b, _: F.struct(F.when(agree(b), middle(b)).otherwise(b["lo"]).alias("lo"), F.when(agree(b), b["hi"]).otherwise(F.greatest(middle(b) - 1, b["lo"])).alias("hi"))
    return F.when(left != right, F.aggregate(F.sequence(F.lit(1), F.lit(32)), bounds, halved)["lo"])


def roots_replaced(text: Column, roots: dict[str, str]) -> Column:
    """Folders replaced by their placeholders, longer ones first, where no character of a path or name stands before or goes on behind."""
    for root in sorted(roots, key=lambda r: (-len(r), r)):
        quoted = "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in root)
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_./-]){quoted}(?![A-Za-z0-9_-]|\.[A-Za-z0-9])", roots[root].replace("\\", "\\\\").replace("$", "\\$"))
    return text
