"""The value types of pipelines, their Spark types, checks and text forms.

Values on the driver are None, bool, Decimal, str, Duration, list and dict; in DataFrames they are columns.
Deviations from tagged values, all deliberate: lists and maps compare by content, maps and structs are one kind,
keys are shown in order, numbers are DECIMAL(38,18).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_TYPE = T.DecimalType(38, 18)
#: Nanoseconds of each unit, smallest first; fixed values.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}


class ValueTypeError(ValueError):
    """A value that is not of its declared type; the message begins with its path."""


@dataclass(frozen=True)
class Type:
    """kind is string, number, bool, duration, path, secret, null, any, list, map, struct, optional or union; args are the types inside, and names those of a struct's fields."""

    kind: str
    args: tuple[Type, ...] = ()
    names: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.kind == "list":
            return f"[{self.args[0]}]"
        if self.kind == "map":
            return f"{{string = {self.args[0]}}}"
        if self.kind == "optional":
            return f"{self.args[0]}?"
        if self.kind == "union":
            return " | ".join(map(str, self.args))
        if self.kind == "struct":
            return "{" + ", ".join(f"{n} = {t}" for n, t in zip(self.names, self.args, strict=True)) + "}"
        return self.kind


STRING, NUMBER, BOOL, DURATION, PATH, SECRET, NULL, ANY = map(Type, "string number bool duration path secret null any".split())


def list_of(t: Type) -> Type:
    return Type("list", (t,))


def map_of(t: Type) -> Type:
    return Type("map", (t,))


def struct_of(fields: dict[str, Type]) -> Type:
    return Type("struct", tuple(fields.values()), tuple(fields))


def optional(t: Type) -> Type:
    return Type("optional", (t,))


def union_of(*ts: Type) -> Type:
    return Type("union", ts)


class Duration(int):
    """Nanoseconds."""

    def __str__(self) -> str:
        return format_duration(self)


def spark_type(t: Type) -> T.DataType:
    """The type of a column that holds such values; a union is held as VARIANT."""
    simple = {"string": T.StringType(), "path": T.StringType(), "secret": T.StringType(), "number": NUMBER_TYPE, "bool": T.BooleanType(), "duration": T.LongType(), "null": T.NullType(), "any": T.VariantType(), "union": T.VariantType()}
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "optional":
        return spark_type(t.args[0])
    if t.kind == "list":
        return T.ArrayType(spark_type(t.args[0]))
    if t.kind == "map":
        return T.MapType(T.StringType(), spark_type(t.args[0]))
    return T.StructType([T.StructField(n, spark_type(a), True, {"kind": a.kind}) for n, a in zip(t.names, t.args, strict=True)])


def type_of(value: object) -> Type:
    """The type of a driver value; a list has its first item's, an empty one strings."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, Duration):
        return DURATION
    if isinstance(value, (Decimal, int)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, list):
        return list_of(type_of(value[0]) if value else STRING)
    if isinstance(value, dict):
        inner = {k: type_of(v) for k, v in sorted(value.items())}
        return map_of(next(iter(inner.values()))) if inner and len(set(inner.values())) == 1 else struct_of(inner) if inner else map_of(STRING)
    raise TypeError(f"no such value: {value!r}")


def from_spark(t: T.DataType) -> Type:
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.ArrayType):
        return list_of(from_spark(t.elementType))
    if isinstance(t, T.MapType):
        return map_of(from_spark(t.valueType))
    if isinstance(t, T.StructType):
        return struct_of({f.name: from_spark(f.dataType) for f in t.fields})
    return ANY


def validate(value: object, t: Type, at: str = "") -> None:
    """Raise ValueTypeError unless value is of type t; a union takes the first member that fits."""
    where = f"{at}: " if at else ""
    if t.kind == "any" or t.kind == "optional" and value is None:
        return
    if t.kind == "optional":
        return validate(value, t.args[0], at)
    if t.kind == "union":
        for member in t.args:
            try:
                return validate(value, member, at)
            except ValueTypeError:
                continue
        raise ValueTypeError(f"{where}expected {t}, got {type_of(value)}")
    if t.kind == "list" and isinstance(value, list):
        for k, item in enumerate(value):
            validate(item, t.args[0], f"{at}[{k}]")
        return None
    if t.kind == "map" and isinstance(value, dict):
        for k, item in sorted(value.items()):
            validate(item, t.args[0], f"{at}.{k}")
        return None
    if t.kind == "struct" and isinstance(value, dict):
        for n, a in zip(t.names, t.args, strict=True):
            validate(value.get(n), a, f"{at}.{n}")
        return None
    have = type_of(value).kind
    if have != ("string" if t.kind in ("path", "secret") else t.kind):
        raise ValueTypeError(f"{where}expected {t}, got {have}")
    return None


def parse_duration(text: str) -> Duration:
    """A duration such as 1.5h, truncated to nanoseconds."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?|\.\d+)\s*(ns|us|ms|s|m|h|d)", text.strip())
    if not m:
        raise ValueError(f"invalid duration '{text}' (expected a number followed by one of: {', '.join(UNITS)})")
    n = int(Decimal(m[1]) * UNITS[m[2]])
    if n >= 1 << 63:
        raise ValueError(f"duration overflow: {text}")
    return Duration(n)


def format_duration(ns: int) -> str:
    """The largest unit that divides it: 90m, not 1.5h."""
    unit = next((u for u in reversed(UNITS) if ns % UNITS[u] == 0), "ns")
    return "0s" if ns == 0 else f"{ns // UNITS[unit]}{unit}"


#: Nanoseconds of any duration: seconds of 64 bits are 29 digits of them.
NANOSECONDS = T.DecimalType(38, 0)


def duration_column(text: Column, wide: bool = False) -> Column:
    """parse_duration of a column; null for malformed text. wide leaves the nanoseconds in a DECIMAL(38, 0), as sums and long durations need."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?|\.\d+)\s*(ns|us|ms|s|m|h|d)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?|\.\d+)\s*(ns|us|ms|s|m|h|d)\s*$", 2)
    size = F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.nullif(unit, F.lit("")))
    return F.when(number != "", F.floor(number.cast(T.DecimalType(38, 9)) * size.cast(T.DecimalType(18, 0))).cast(NANOSECONDS if wide else T.LongType()))


def duration_text(ns: Column) -> Column:
    """format_duration of a column of nanoseconds, a BIGINT or a DECIMAL(38, 0)."""
    ns = ns.cast(NANOSECONDS)  # a quotient of BIGINTs is a DOUBLE, which has 53 bits
    out = F.when(ns == 0, F.lit("0s"))
    for unit, size in reversed(UNITS.items()):
        out = out.when(ns % size == 0, F.concat((ns / F.lit(size)).cast(NANOSECONDS).cast("string"), F.lit(unit)))
    return out


def number_text(value: Decimal | int) -> str:
    text = format(Decimal(value), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def display(value: object) -> str:
    """How a value reads inside a string."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Duration):
        return format_duration(value)
    if isinstance(value, (Decimal, int)):
        return number_text(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(display, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k} = {display(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def display_column(col: Column, t: Type) -> Column:
    """display of a column; never null."""
    if t.kind == "optional":
        return display_column(col, t.args[0])
    if t.kind == "number":
        text = col.cast(NUMBER_TYPE).cast("string")
        shown = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif t.kind == "duration":
        shown = duration_text(col)
    elif t.kind == "list":
        shown = F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: display_column(x, t.args[0])), ", "), F.lit("]"))
    elif t.kind == "map":
        entries = F.array_sort(F.map_entries(col))
        shown = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" = "), display_column(e["value"], t.args[0]))), ", "), F.lit("}"))
    elif t.kind == "struct":
        parts = [F.concat(F.lit(f"{n} = "), display_column(col[n], a)) for n, a in sorted(zip(t.names, t.args, strict=True))]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif t.kind == "null":
        return F.lit("null")
    else:
        shown = col.cast("string")
    return F.coalesce(shown, F.lit("null"))


def from_json_value(value: object) -> object:
    """A JSON document's value: numbers become decimals, objects structs."""
    if isinstance(value, bool) or value is None or isinstance(value, (str, Decimal)):
        return value
    if isinstance(value, (int, float)):
        return Decimal(str(value))
    if isinstance(value, list):
        return [from_json_value(x) for x in value]
    return {k: from_json_value(v) for k, v in value.items()}


def parameter(text: str) -> object:
    """A parameter given as text: true and false are bools, what reads as a number is one, and all else a string."""
    if text in ("true", "false"):
        return text == "true"
    return Decimal(text) if re.fullmatch(r"-?\d+(\.\d+)?", text) else text
