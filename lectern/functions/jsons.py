"""JSON that models write: extraction, a small schema validator, tool arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Problems = Iterator[str]


def _kind(value: Any) -> set[str]:
    """The JSON types that a value has."""
    match value:
        case None:
            return {"null"}
        case bool():
            return {"boolean"}
        case int() | float():
            return {"number", "integer"} if value == value // 1 else {"number"}
        case str():
            return {"string"}
        case dict():
            return {"object"}
    return {"array"}


def _listed(kinds: str | list[str]) -> list[str]:
    return [kinds] if isinstance(kinds, str) else list(kinds)


def _properties(value: dict, known: dict, at: str) -> Problems:
    for name, schema in known.items():
        if name in value:
            yield from _broken(value[name], schema, f"{at}.{name}")


def _items(value: list, schema: dict, at: str) -> Problems:
    for i, v in enumerate(value):
        yield from _broken(v, schema, f"{at}[{i}]")


#: Keyword: the type of value it looks at (None: any), and what it says about one that breaks it.
RULES: dict[str, tuple[str | None, Callable[[Any, Any, str, dict], Problems]]] = {
    "enum": (None, lambda v, known, at, _: [] if v in known else [f"{at}: not one of {known}"]),
    "minimum": ("number", lambda v, least, at, _: [f"{at}: below {least}"] if v < least else []),
    "maximum": ("number", lambda v, most, at, _: [f"{at}: above {most}"] if v > most else []),
    "required": ("object", lambda v, names, at, _: (f"{at}: {n} is missing" for n in names if n not in v)),
    "additionalProperties": ("object", lambda v, more, at, schema: (f"{at}: {n} is unknown" for n in v if more is False and n not in schema.get("properties", {}))),
    "properties": ("object", lambda v, known, at, _: _properties(v, known, at)),
    "items": ("array", lambda v, schema, at, _: _items(v, schema, at)),
}


def _broken(value: Any, schema: dict, at: str) -> Problems:
    kinds, own = _listed(schema.get("type", [])), _kind(value)
    if kinds and own.isdisjoint(kinds):
        yield f"{at}: not {' or '.join(kinds)}"
        return
    for word, (kind, rule) in RULES.items():
        if word in schema and (kind is None or kind in own):
            yield from rule(value, schema[word], at, schema)


def problems(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema's type and of RULES.  Of a value of another type nothing else is said."""
    return list(_broken(value, schema, at))


def _native(v: Column, schema: dict, at: Column) -> Column:
    """The problems of a variant, an array of strings; the same as problems() gives."""
    none = F.expr("cast(array() as array<string>)")
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.try_variant_get(v, "$", "double")
    is_ = {"null": kind == "VOID", "boolean": kind == "BOOLEAN", "string": kind == "STRING", "object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY")), "number": number, "integer": number & (value == F.floor(value))}

    def say(when: Column, *told: Column | str) -> Column:
        return F.when(when, F.array(F.concat(at, *[x if isinstance(x, Column) else F.lit(x) for x in told]))).otherwise(none)

    def same(x: Any) -> Column:
        if isinstance(x, bool):
            return is_["boolean"] & (F.try_variant_get(v, "$", "boolean") == x)
        if isinstance(x, int | float):
            return number & (value == float(x))
        return is_["null"] if x is None else is_["string"] & (F.try_variant_get(v, "$", "string") == x)

    found = []
    if "enum" in schema:
        found.append(say(~F.coalesce(reduce(or_, map(same, schema["enum"]), F.lit(False)), F.lit(False)), f": not one of {schema['enum']}"))
    found += [say(number & (value < schema["minimum"]), f": below {schema['minimum']}")] if "minimum" in schema else []
    found += [say(number & (value > schema["maximum"]), f": above {schema['maximum']}")] if "maximum" in schema else []
    keys = F.when(is_["object"], F.coalesce(F.json_object_keys(F.to_json(v)), none))
    known = schema.get("properties", {})
    found += [say(is_["object"] & ~F.array_contains(keys, n), f": {n} is missing") for n in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        odd = F.array_except(keys, F.array(*map(F.lit, known)) if known else none)
        found.append(F.when(is_["object"], F.transform(odd, lambda n: F.concat(at, F.lit(": "), n, F.lit(" is unknown")))).otherwise(none))
    for name, inner in known.items():
        part = F.try_variant_get(v, f"$['{name}']", "variant")
        found.append(F.when(is_["object"] & F.array_contains(keys, name), _native(part, inner, F.concat(at, F.lit(f".{name}")))).otherwise(none))
    if "items" in schema:
        parts = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(parts, lambda x, i: _native(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(is_["array"], F.flatten(each)).otherwise(none))
    rest = F.concat(*found) if found else none
    kinds = _listed(schema.get("type", []))
    if not kinds:
        return rest
    return F.when(reduce(or_, [F.coalesce(is_[k], F.lit(False)) for k in kinds]), rest).otherwise(F.array(F.concat(at, F.lit(f": not {' or '.join(kinds)}"))))


def extracted(text: Column) -> Column:
    """The outermost object of a reply, without a code fence and prose around it; null if it isn't JSON."""
    body = F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def arguments(raw: Column) -> Column:
    """Tool-call arguments: an object as it is, anything else under the key raw."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return F.when(F.startswith(kind, F.lit("OBJECT")), raw).otherwise(F.to_json(F.create_map(F.lit("raw"), F.coalesce(raw, F.lit("")))))


def validated(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """rows with problems: an array, empty for JSON that fits the schema; a code fence around it is taken off."""
    text = F.regexp_replace(F.trim(F.coalesce(F.col(column), F.lit("")), F.lit(" \t\r\n")), r"(?s)^```\w*\s*(.*?)\s*```$", "$1")
    value = F.try_parse_json(text)
    return rows.withColumn("problems", F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_native(value, schema, F.lit("$"))))
