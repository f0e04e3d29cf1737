"""Ordered gates: the first reason that holds, lists of what is missing, and tri-state flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The text of the first rule that is true, in the order given; a null condition is not true."""
    chain = reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return chain.otherwise(F.lit(otherwise))


def missing_names(**present: Column) -> Column:
    """Names whose column is null, in the order given, joined by commas; empty if none is missing."""
    return F.concat_ws(",", *(F.when(c.isNull(), F.lit(name)) for name, c in present.items()))


def eligibility(name: str, *reasons: Column) -> list[Column]:
    """`<name>_eligible` and `<name>_reason`: the first reason that is not null makes it false."""
    reason = F.coalesce(*reasons)
    return [reason.isNull().alias(f"{name}_eligible"), reason.alias(f"{name}_reason")]


def tri_state(known: Column, value: Column) -> Column:
    """True or false where known, else null; an unknown never becomes false."""
    return F.when(known, value)


def worst(status: Column, *order: str) -> Column:
    """Aggregate: of the statuses in a group the one that is first in `order`; null for an empty group."""
    places = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return F.element_at(F.array(*map(F.lit, order)), (F.min(places[status]) + 1).cast("int"))
