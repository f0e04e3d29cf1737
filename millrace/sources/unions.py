"""Tagged unions: JSON records decoded by a tag into one struct that has the fields of all cases, with one error at most."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsontext import exact_json, parsed
from .typed import Field, problem_of, type_of


def _fields(cases: Mapping[str, Sequence[Field]]) -> dict[str, Field]:
    found: dict[str, Field] = {}
    for name, fields in cases.items():
        for f in fields:
            if found.setdefault(f.name, f).column_type != f.column_type:
                raise ValueError(f"{name}: field {f.name} has another type in another case")
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _decoded(record: Column, tag: Column, tag_name: str, cases: Mapping[str, Sequence[Field]], inside: bool) -> Column:
    every = _fields(cases)
    unknown = F.concat(F.lit(f"{tag_name}: unknown "), tag)
    error = F.when(~F.coalesce(type_of(record).startswith("OBJECT"), F.lit(False)), "no object").when(tag.isNull(), f"{tag_name}: missing").when(~tag.isin(*cases), unknown)
    keys = F.json_object_keys(F.to_json(record))
    for name, fields in cases.items():
        known = [f.name for f in fields] + [tag_name] * inside
        strange = F.array_min(F.array_except(keys, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
        error = error.when(tag == name, F.coalesce(F.concat(F.lit("unknown field "), strange), *(problem_of(f, record) for f in fields)))

    def value(f: Field, wrong: Column) -> Column:
        held = F.try_variant_get(record, f.path, f.column_type)
        default = F.lit(None).cast(f.column_type) if f.default is None else F.parse_json(F.lit(f.default)) if f.column_type == "variant" else F.lit(f.default).cast(f.column_type)
        there = [n for n, fields in cases.items() if f.name in [x.name for x in fields]]
        return F.when(wrong.isNull() & tag.isin(*there), F.coalesce(held, default)).alias(f.name)

    return _let(error, lambda wrong: F.struct(wrong.alias("error"), *(value(f, wrong) for f in every.values())))


def decoded(record: Column, tag: Column, tag_name: str, cases: Mapping[str, Sequence[Field]], inside: bool = True) -> Column:
    """struct(error, and a field for each of all cases) of a VARIANT.

    error is null or the first thing wrong: `no object`, `<tag name>: missing`, `<tag name>: unknown <tag>`, `unknown field <name>` (the
    first in order of names), or what is wrong with the first field of the case (see `typed.scan`). Fields that the case lacks are
    null, as are all fields of a record with an error; those that are not there have their default. `inside` says that the
    record itself holds the tag.
    """
    return _let(F.struct(record.alias("record"), tag.alias("tag")), lambda x: _decoded(x["record"], x["tag"], tag_name, cases, inside))


def decoded_text(text: Column, tag_name: str, cases: Mapping[str, Sequence[Field]]) -> Column:
    """The same of a JSON text that holds its tag, which comes after the error in the struct as `tag`; what is no JSON has the error
    `no JSON`."""

    def whole(record: Column) -> Column:
        tag = F.when(type_of(record).startswith("OBJECT"), F.try_variant_get(record, f"$.{tag_name}", "string"))
        out = lambda x: F.struct(x["found"]["error"].alias("error"), F.when(x["found"]["error"].isNull(), x["tag"]).alias("tag"), *(x["found"][f].alias(f) for f in _fields(cases)))
        return _let(F.struct(tag.alias("tag"), decoded(record, tag, tag_name, cases).alias("found")), out)

    nothing = F.struct(F.lit("no JSON").alias("error"), F.lit(None).cast("string").alias("tag"), *(F.lit(None).cast(f.column_type).alias(n) for n, f in _fields(cases).items()))
    return _let(parsed(text), lambda record: F.when(record.isNotNull(), whole(record)).otherwise(nothing))


def _not_empty(value: Column) -> Column:
    return value != ""


def _between(low: int, high: int):
    return (f"not between {low} and {high}", lambda v: (v >= low) & (v <= high))


_TEXT = (("empty", _not_empty),)
#: Actions of an agent and arguments of its tools, with bounds and defaults.
ACTIONS = {
    "tool_call": [Field("tool_name", "string", rules=_TEXT), Field("arguments", "object", required=False, default="{}")],
    "final_answer": [Field("text", "string", rules=_TEXT)],
}
TOOLS = {
    "list_files": [Field("path", "string", required=False, rules=_TEXT, default="."), Field("max_depth", "integer", required=False, rules=(_between(0, 20),), as_type="int", default=4), Field("max_files", "integer", required=False, rules=(_between(1, 1000),), as_type="int", default=200)],
    "read_file": [Field("path", "string", rules=_TEXT, default=None)],
    "write_file": [Field("path", "string", rules=_TEXT), Field("content", "string")],
    "run_tests": [Field("command", "string", rules=_TEXT)],
}


def decoded_action(text: Column, actions: Mapping[str, Sequence[Field]] = ACTIONS, tools: Mapping[str, Sequence[Field]] = TOOLS) -> Column:
    """struct(error, tag, the fields of all actions, tool: struct of the arguments of all tools) of an agent's output.

    An action with wrong arguments has the error `arguments.<error>` and keeps its tag and fields, as it is an action; its tool is
    null. A tool that is not known is `arguments.tool_name: unknown <name>`.
    """
    names = _fields(actions)

    def with_tool(action: Column) -> Column:
        own = F.when(action["tool_name"].isNotNull(), decoded(action["arguments"], action["tool_name"], "tool_name", tools, inside=False))
        return _let(F.struct(action.alias("action"), own.alias("own")), lambda x: whole(x["action"], x["own"]))

    def whole(action: Column, own: Column) -> Column:
        error = F.coalesce(action["error"], F.concat(F.lit("arguments."), own["error"]))
        tool = F.when(own.isNotNull() & own["error"].isNull(), F.struct(*(own[f].alias(f) for f in _fields(tools))))
        return F.struct(error.alias("error"), action["tag"].alias("tag"), *(action[n].alias(n) for n in names), tool.alias("tool"))

    return _let(decoded_text(text, "action", actions), with_tool)


def observation(content: Column) -> Column:
    """struct(hash, error) of what a tool showed: the MD5 of its exact JSON, or an error where it is no JSON."""
    return _let(exact_json(content), lambda text: F.struct(F.md5(text).alias("hash"), F.when(text.isNull(), "observation is no JSON").alias("error")))

