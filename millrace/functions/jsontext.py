"""JSON texts of any schema: a canonical form that keeps numbers as written, normalizers at all depths, pointers.

Spark's VARIANT sorts keys and walks any depth, but holds numbers as numbers: 1.0 becomes 1, and 1e400 no number at all. So before a text is
parsed, strings get an `s` in front and numbers become strings with an `n` in front; when it is text again, both are taken away.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is in a JSON string, without backtracking, and what may stand between strings.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_STRING = f'"({_INSIDE})"'
_NUMBER = r"-?[0-9][0-9.eE+-]*+"
_NEXT_NUMBER = rf'\G([^"0-9-]*+(?:"{_INSIDE}"[^"0-9-]*+)*+)({_NUMBER})'
_NEXT_TAGGED = rf'\G([^"]*+(?:"s{_INSIDE}"[^"]*+)*+)"n([^"]*+)"'


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else. Spark's parser passes over what comes after a value, so it has to be right
    within brackets of both kinds: what goes on after it would have to begin with a bracket of one kind and close the other."""
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}")))
    return F.coalesce(in_array.isNotNull() & in_object.isNotNull(), F.lit(False))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Stands before numbers, and after a text, where the text itself has it nowhere.
_MARK = "\u2063"
_VALID_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+(?![0-9.eE+-])"
_NEXT_VALID = rf'\G([^"0-9-]*+(?:"{_INSIDE}"[^"0-9-]*+)*+)({_VALID_NUMBER})'
#: Spark's parser takes no number of more characters.
_LONG_NUMBER = r"[0-9.eE+-]{1000}"


def _has_mark(text: Column) -> Column:
    return text.contains(_MARK) | text.contains("\\u2063")


def _alone(text: Column) -> Column:
    """An array of a text's value and the mark, null unless the text is one JSON value: what goes on after it would be between the two,
    and what closes the array, or opens a string, would leave the mark outside."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))


def _is_alone(both: Column) -> Column:
    return F.try_variant_get(both, "$[1]", "string") == _MARK


def parsed(text: Column) -> Column:
    """The VARIANT of a JSON text; null for what is no JSON (`is_json`), or has a name twice in one object."""
    fast = bound(_alone(text), lambda both: F.when(_is_alone(both), F.try_variant_get(both, "$[0]", "variant")))
    return F.when(_has_mark(text), F.when(is_json(text), F.try_parse_json(text))).otherwise(fast)


def _marked(text: Column) -> Column:
    """Canonical JSON in which numbers are strings that begin with the mark; null for what is no JSON. Only for texts without the mark.

    Numbers that are none stay as they are, and no parser takes those."""
    numbers = F.regexp_replace(text, _NEXT_VALID, f'$1"{_MARK}$2"')
    found = bound(_alone(numbers), lambda both: F.when(_is_alone(both), F.to_json(both)))
    alone = bound(found, lambda x: F.substr(x, F.lit(2), F.length(x) - 6))
    return F.when((F.length(text) >= 1000) & text.rlike(_LONG_NUMBER), F.when(is_json(text), alone)).otherwise(alone)


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, f'"{_MARK}([^"]*+)"', "$1")


def tagged(text: Column) -> Column:
    """JSON as JSON whose strings begin with s and whose numbers are strings that begin with n; null for other texts."""
    return F.when(is_json(text), F.regexp_replace(F.regexp_replace(text, _STRING, '"s$1"'), _NEXT_NUMBER, '$1"n$2"'))


def untagged(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _NEXT_TAGGED, "$1$2"), '"s(' + _INSIDE + ')"', '"$1"')


def small_escapes(text: Column) -> Column:
    """JSON text whose escapes of control characters have digits in lower case, as most writers have them; Spark's are in upper case."""

    def lowered(found: Column) -> Column:
        lower = found
        for digit in "ABCDEF":
            lower = F.regexp_replace(lower, r"(?<!\\)((?:\\\\)*+\\u00[01])" + digit, f"$1{digit.lower()}")
        return F.when(found.contains("\\u00"), lower).otherwise(found)

    return bound(text, lowered)


def exact_json(text: Column) -> Column:
    """JSON text with sorted keys at all depths, no spaces, strings in their shortest form and numbers as written: 1, 1.0 and 1e0 stay
    three, and no digit of a long one is lost. Null for what is no JSON or has a name twice in one object. Names are in the order of
    their UTF-16 units."""
    return small_escapes(F.when(_has_mark(text), untagged(F.to_json(F.try_parse_json(tagged(text))))).otherwise(_unmarked(_marked(text))))


def nesting(text: Column) -> Column:
    """How deep objects and arrays stand in each other: 0 for a text without any."""
    brackets = F.regexp_replace(F.regexp_replace(text, rf'(?:[^\[\]{{}}"]++|"{_INSIDE}")++', ""), '"++', "")
    # In each piece some open and then some close: two numbers in one, where a piece begins and the most so far.
    deepest = 1 << 31

    def step(held: Column, piece: Column) -> Column:
        closing = F.length(F.ltrim(piece, F.lit("[{")))
        at = F.shiftright(held, 32).cast("long") + F.length(piece) - closing
        most = F.greatest(held.bitwiseAND(F.lit(deepest - 1)), at)
        return F.shiftleft(at - closing, 32).bitwiseOR(most)

    pieces = F.split(brackets, r"(?<=[\]}])(?=[\[{])")
    return F.aggregate(pieces, F.lit(0).cast("long"), step, lambda held: held.bitwiseAND(F.lit(deepest - 1)).cast("int"))


def _quoted(text: Column) -> Column:
    return small_escapes(F.to_json(text.cast("variant")))


def _shallow(body: str) -> str:
    return rf'[^\[\]{{}}"]*+(?:"{_INSIDE}"[^\[\]{{}}"]*+)*+{body}'


#: An object or array that holds no other, a string, a bracket, or what stands between those.
_TOKEN = rf'\{{{_shallow(chr(92) + "}")}|\[{_shallow(chr(92) + "]")}|"{_INSIDE}"|[^\[\]{{}}"]++|[\[\]{{}}]'


def _folded(text: Column, dropped: Sequence[str], replaced: Mapping[str, str] | None, rule: Callable[[Column], Column]) -> Column:
    """`normalized_json` for members of any depth.

    A text is folded from within, once for each level that it has itself: what holds no other object or array is written in its final
    form, and a reference (`c<round>_<place>`) takes its place, so that what held it holds none in the next round.
    """
    names = [F.lit(f"s{n}") for n in dropped]
    fixed = [(F.lit(f"s{n}"), _quoted(F.lit(t))) for n, t in (replaced or {}).items()]
    none = F.lit(None).cast("string")

    def referred(mark: Column, done: Column) -> Column:
        at = F.split(F.substr(mark, F.lit(2)), "_")
        return F.get(F.get(done, F.get(at, 0).try_cast("int")), F.get(at, 1).try_cast("int"))

    def written(value: Column, done: Column) -> Column:
        held = F.try_variant_get(value, "$", "string")
        rest = F.substr(held, F.lit(2))
        return F.when(held.startswith("s"), _quoted(rule(rest))).when(held.startswith("n"), rest).when(held.startswith("c"), referred(held, done)).otherwise(F.to_json(value))

    def flat(token: Column, done: Column) -> Column:
        members = F.map_entries(F.try_variant_get(F.try_parse_json(token), "$", "map<string,variant>"))
        kept = F.filter(members, lambda e: ~e["key"].isin(*names)) if names else members
        put = lambda e: F.coalesce(*(F.when(e["key"] == n, t) for n, t in fixed), written(e["value"], done))
        of_object = F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(_quoted(F.substr(e["key"], F.lit(2))), F.lit(":"), put(e))), ","), F.lit("}"))
        items = F.try_variant_get(F.try_parse_json(token), "$", "array<variant>")
        of_array = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: written(x, done)), ","), F.lit("]"))
        return F.when(token.startswith("{"), of_object).otherwise(of_array)

    closed = lambda token: token.rlike(r"^[\[{]") & (F.length(token) > 1)

    def fold(held: Column, _: Column) -> Column:
        tokens, done = F.regexp_extract_all(held["text"], F.lit(_TOKEN), F.lit(0)), held["done"]
        mark = lambda i: F.concat(F.lit('"c'), F.size(done).cast("string"), F.lit("_"), i.cast("string"), F.lit('"'))
        shorter = F.array_join(F.transform(tokens, lambda t, i: F.when(closed(t), mark(i)).otherwise(t)), "")
        found = F.transform(tokens, lambda t: F.when(closed(t), flat(t, done)).otherwise(none))
        return F.struct(shorter.alias("text"), F.concat(done, F.array(found)).alias("done"))

    start = F.struct(tagged(text).alias("text"), F.array().cast("array<array<string>>").alias("done"))
    levels = F.sequence(F.lit(0), nesting(text) - 1, F.lit(1))
    steps = F.when(nesting(text) > 0, levels).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, fold, lambda held: written(F.try_parse_json(held["text"]), held["done"]))


#: How deep objects and arrays may stand in a member that is dropped or replaced without folding.
_DEPTH = 6


def _any_value() -> str:
    """A value in canonical JSON, of up to _DEPTH levels."""
    held = ""
    for _ in range(_DEPTH):
        held = rf'[\[{{](?:[^\[\]{{}}"]++|"{_INSIDE}"{held and "|" + held})*+[\]}}]'
    return rf'(?:"{_INSIDE}"|{held}|[^\[\]{{}}",]++)'


def _exactly(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in text)


def _member(names: Sequence[str]) -> str:
    """The name of a member as canonical JSON has it, and the colon: what goes before it is a bracket or a comma, not a backslash."""
    upper = lambda n: re.sub(r"\\u00[01][0-9a-f]", lambda m: m[0][:2] + m[0][2:].upper(), json.dumps(n, ensure_ascii=False)[1:-1])
    return rf'"(?<=[{{,]")(?:{"|".join(_exactly(upper(n)) for n in names)})":'


#: A string that is a value and no marked number, or what stands between those.
_PIECE = rf'"(?!{_MARK}){_INSIDE}"(?!:)|(?:[^"]++|"{_MARK}[^"]*+"|"{_INSIDE}":)++'


def _edited(marked: Column, dropped: Sequence[str], replaced: Mapping[str, str] | None, rule: Callable[[Column], Column]) -> Column:
    """Normalized JSON, made from the marked canonical text by regular expressions; null where a member is too deep for those, or what
    `rule` gives is null or has the mark."""
    value, left = _any_value(), marked
    if dropped:
        name = _member(dropped)
        left = F.regexp_replace(F.regexp_replace(left, f"{name}{value},", ""), rf"(?:,|(?<=\{{)){name}{value}(?=\}})", "")
        left = bound(left, lambda x: F.when(~x.rlike(name), x))
    is_value = lambda t: t.startswith('"') & ~t.startswith(f'"{_MARK}')
    inside = lambda t: F.when(t.contains("\\"), F.try_variant_get(F.try_parse_json(t), "$", "string")).otherwise(F.substr(t, F.lit(2), F.length(t) - 2))

    def written(piece: Column, said: Column) -> Column:
        quoted = F.when(said.rlike(r'["\\\x00-\x1f]'), _quoted(said)).otherwise(F.concat(F.lit('"'), said, F.lit('"')))
        return F.when(is_value(piece), F.coalesce(quoted, F.lit(_MARK))).otherwise(_unmarked(piece))

    def ruled(pieces: Column) -> Column:
        said = F.transform(pieces, lambda t: F.when(is_value(t), rule(inside(t))))
        return F.array_join(F.zip_with(pieces, said, written), "")

    done = bound(F.regexp_extract_all(left, F.lit(_PIECE), F.lit(0)), ruled)
    done = bound(done, lambda x: F.when(~x.contains(_MARK), x))
    for n, told in (replaced or {}).items():
        name, fixed = _member([n]), json.dumps(told, ensure_ascii=False)
        other = rf"{name}(?!{_exactly(fixed)})"
        done = F.regexp_replace(done, f"({name}){value}", "$1" + re.sub(r"([\\$])", r"\\\1", fixed))
        done = bound(done, lambda x: F.when(~x.rlike(other), x))  # noqa: B023
    return small_escapes(done)


def normalized_json(text: Column, dropped: Sequence[str] = (), replaced: Mapping[str, str] | None = None, rule: Callable[[Column], Column] = lambda x: x) -> Column:
    """JSON in canonical form (`exact_json`) of which, at every depth, members named in `dropped` are left out, those in `replaced` get
    that text in place of whatever they hold, and other strings what `rule` makes of them. Names are taken as they are. Null for
    what is no JSON.

    Members go from the canonical text, and strings change there, in a number of passes that depth has no part in; texts in which a
    member to go holds more than a few levels are folded.
    """
    edited = F.when(~_has_mark(text), _edited(_marked(text), dropped, replaced, rule))
    return F.coalesce(edited, F.when(is_json(text), _folded(text, dropped, replaced, rule)))


def normalized_file(path: Column, content: Column, dropped: Sequence[str] = (), replaced: Mapping[str, str] | None = None, rule: Callable[[Column], Column] = lambda x: x) -> Column:
    """Contents normalized by what the path ends in. `.json`: as `normalized_json`; `.jsonl`: each line that is not blank so, and a line
    feed at the end; others: rule alone. Null for JSON that is none, also in one line of several."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x, F.lit(" \t\r\f\x0b")) != "")
    done = F.transform(lines, lambda x: normalized_json(x, dropped, replaced, rule))
    of_lines = F.when(~F.exists(done, lambda x: x.isNull()), F.concat(F.array_join(done, "\n"), F.lit("\n")))
    return F.when(path.endswith(".jsonl"), of_lines).when(path.endswith(".json"), normalized_json(content, dropped, replaced, rule)).otherwise(rule(content))


def pointer_steps(pointer: Column) -> Column:
    """The decoded segments of a JSON pointer; null if it is none: it does not begin with /, or has a ~ without 0 or 1 after it."""
    plain = lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    good = (pointer == "") | pointer.startswith("/") & ~pointer.rlike("~(?![01])")
    return F.when(good, F.when(pointer == "", F.array().cast("array<string>")).otherwise(F.transform(F.slice(F.split(pointer, "/", -1), 2, 1 << 30), plain)))


def pointed_json(document: Column, pointer: Column) -> Column:
    """The exact JSON of what a pointer leads to in a JSON text; null if it leads nowhere, if it is no pointer or the text no JSON. A
    JSON null found there is the text null.

    A segment names a member of an object, whatever it looks like, or, as digits without leading zeros, an item of an array.
    """

    def step(held: Column, segment: Column) -> Column:
        members, items = F.try_variant_get(held, "$", "map<string,variant>"), F.try_variant_get(held, "$", "array<variant>")
        index = F.when(segment.rlike("^(0|[1-9][0-9]{0,8})$"), F.get(items, segment.try_cast("int")))
        return F.when(members.isNotNull(), F.try_element_at(members, F.concat(F.lit("s"), segment))).otherwise(index)

    return small_escapes(untagged(F.to_json(F.aggregate(pointer_steps(pointer), F.try_parse_json(tagged(document)), step))))
