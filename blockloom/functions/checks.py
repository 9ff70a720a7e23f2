"""Declared types over columns of VARIANT values: where a value first departs from its type, and how.

A type becomes one expression. A list's items are looked at in order, a map's by key, a struct's fields as declared; a union is
met if one of its members is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.types import Type

#: The names of what a VARIANT holds, by the first letters of its schema; fixed by Spark.
_HELD = {"VOID": "null", "BOOLEAN": "bool", "STRING": "string", "ARRAY": "list", "OBJECT": "struct", "TINYINT": "number", "SMALLINT": "number", "INT": "number", "BIGINT": "number", "FLOAT": "number", "DOUBLE": "number", "DECIMAL": "number"}
_FITS = {"string": "string", "path": "string", "secret": "string", "number": "number", "bool": "bool", "null": "null", "list": "list", "map": "struct", "struct": "struct"}
_VIOLATION = "struct<path: string, expected: string, got: string>"


def held(value: Column) -> Column:
    """What kind of value a VARIANT column holds; a null column and a missing field hold null. Kinds that JSON has not have Spark's name."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = F.create_map(*(F.lit(x) for pair in _HELD.items() for x in pair))
    return F.coalesce(known[name], F.lower(name), F.lit("null"))


def violation(value: Column, t: Type) -> Column:
    """A column of path, expected and got for the first place at which a VARIANT departs from type t; null where it has none.

    Paths are as in messages: .field, [0]; the value itself has the empty path. Durations and paths have no form of their own in
    JSON: a path is text, and nothing is a duration.
    """
    return _violation(value, t, F.lit(""))


def _violation(value: Column, t: Type, at: Column) -> Column:
    none = F.lit(None).cast(_VIOLATION)
    if t.kind == "any":
        return none
    kind = held(value)
    wrong = F.struct(at.alias("path"), F.lit(str(t)).alias("expected"), kind.alias("got")).cast(_VIOLATION)
    if t.kind == "optional":
        return F.when(kind != "null", _violation(value, t.args[0], at))
    if t.kind == "union":
        return F.when(_all(*(_violation(value, m, at).isNotNull() for m in t.args)), wrong)
    if t.kind not in _FITS:
        return wrong
    fits = kind == _FITS[t.kind]
    if t.kind == "list":
        inner = _first(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, k: _violation(x, t.args[0], F.concat(at, F.lit("["), k.cast("string"), F.lit("]")))))
    elif t.kind == "map":
        entries = F.try_variant_get(value, "$", "map<string, variant>")
        named = F.transform(F.array_sort(F.map_keys(entries)), lambda k: _violation(entries[k], t.args[0], F.concat(at, F.lit("."), k)))
        inner = _first(named)
    elif t.kind == "struct":
        inner = F.coalesce(none, *(_violation(F.try_variant_get(value, f"$.{n}", "variant"), a, F.concat(at, F.lit(f".{n}"))) for n, a in zip(t.names, t.args, strict=True)))
    else:
        inner = none
    return F.when(~fits, wrong).otherwise(inner)


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def departures(df: DataFrame, column: str, t: Type, parse: Callable[[Column], Column] = F.try_parse_json) -> DataFrame:
    """The rows of df whose JSON text in column is not of type t, with the columns path, expected and got. Text that is no JSON holds null."""
    return df.withColumn("__violation", violation(parse(F.col(column)), t)).where("__violation IS NOT NULL").select(*df.columns, "__violation.*")
