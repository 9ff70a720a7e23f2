"""Expressions to typed columns.

Everything is decided before Spark runs but the values: types are checked here, so that nothing is coerced as SQL
would, and the columns are built-in functions alone, so that Catalyst can fold, prune and push them down.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.library import Typed, call
from blockloom.functions.types import BOOL, DURATION, NULL, NUMBER, NUMBER_TYPE, STRING, Duration, Type, display_column, from_spark, list_of, map_of, spark_type, struct_of, type_of
from blockloom.plans.ast import Add, Bool, Call, Compare, DurationLit, Expr, If, ListLit, MapLit, Null, Number, Pipe, Ref, Text


class ExprError(ValueError):
    """What is wrong with an expression: a type, an unknown name, or a missing field."""


class UndefinedError(ExprError):
    """A reference whose first name is unknown."""


class MissingFieldError(ExprError):
    """A reference to a field that is not there."""


def literal(value: object, t: Type | None = None) -> Typed:
    """A driver value as a column."""
    t = t or type_of(value)
    if value is None:
        return Typed(F.lit(None).cast(spark_type(t)) if t.kind != "null" else F.lit(None), t)
    if isinstance(value, Duration):
        return Typed(F.lit(int(value)).cast("long"), DURATION)
    if isinstance(value, (Decimal, int)) and not isinstance(value, bool):
        return Typed(F.lit(Decimal(value)).cast(NUMBER_TYPE), NUMBER)
    if isinstance(value, list):
        items = [literal(v).col for v in value]
        return Typed(F.array(*items).cast(spark_type(t)) if items else F.array().cast(spark_type(t)), t)
    if isinstance(value, dict):
        return _map({k: literal(v) for k, v in sorted(value.items())})
    return Typed(F.lit(value), t, value if isinstance(value, str) else None)


def _map(entries: dict[str, Typed]) -> Typed:
    """A map if all values are of one type, and else a struct."""
    kinds = {e.type for e in entries.values()}
    if len(kinds) == 1:
        return Typed(F.create_map(*(x for k, e in entries.items() for x in (F.lit(k), e.col))), map_of(kinds.pop()))
    if not entries:
        return Typed(F.create_map().cast("map<string,string>"), map_of(STRING))
    return Typed(F.struct(*(e.col.alias(k) for k, e in entries.items())), struct_of({k: e.type for k, e in entries.items()}))


@dataclass
class Scope:
    """What names mean: params, lets and blocks in one space, each a typed column or a dict of fields."""

    names: dict[str, Typed | dict] = field(default_factory=dict)
    #: What each name is: param, let, block or column.
    kinds: dict[str, str] = field(default_factory=dict)

    def define(self, name: str, value: Typed | dict, kind: str) -> None:
        if name in self.names:
            raise ExprError(f"{name} is already defined as a {self.kinds[name]}")
        self.set(name, value, kind)

    def set(self, name: str, value: Typed | dict, kind: str) -> None:
        self.names[name], self.kinds[name] = value, kind

    def copy(self) -> Scope:
        return Scope(dict(self.names), dict(self.kinds))

    @staticmethod
    def of(df: DataFrame) -> Scope:
        """The columns of df."""

        def typed(f: T.StructField) -> Typed:
            t, col = from_spark(f.dataType), F.col(f"`{f.name}`")
            return Typed(col.cast(NUMBER_TYPE) if t == NUMBER else col, t)

        return Scope({f.name: typed(f) for f in df.schema.fields}, dict.fromkeys(df.columns, "column"))


def _plain(t: Type) -> Type:
    return t.args[0] if t.kind == "optional" else t


def _kind(t: Type) -> str:
    kind = _plain(t).kind
    return "string" if kind in ("path", "secret") else kind


class Compiler:
    """Compiles against a scope. A strict one fails on a missing field; a lenient one leaves ${a.b} as text."""

    def __init__(self, scope: Scope, strict: bool = True) -> None:
        self.scope, self.strict = scope, strict

    def compile(self, e: Expr) -> Typed:
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def _text(self, e: Text) -> Typed:
        if all(isinstance(p, str) for p in e.parts):
            text = "".join(e.parts)
            return Typed(F.lit(text), STRING, text)
        parts = [Typed(F.lit(p), STRING, p) if isinstance(p, str) else self.compile(p) for p in e.parts]
        known = "".join(p.text for p in parts) if all(p.text is not None for p in parts) else None
        return Typed(F.concat(*(display_column(p.col, p.type) for p in parts)), STRING, known)

    def _number(self, e: Number) -> Typed:
        return literal(e.value)

    def _durationlit(self, e: DurationLit) -> Typed:
        return literal(Duration(e.ns))

    def _bool(self, e: Bool) -> Typed:
        return literal(e.value)

    def _null(self, e: Null) -> Typed:
        return literal(None)

    def _listlit(self, e: ListLit) -> Typed:
        items = [self.compile(i) for i in e.items]
        kinds = list(dict.fromkeys(i.type for i in items if i.type != NULL)) or [STRING]
        if len({_kind(k) for k in kinds}) > 1:
            raise ExprError(f"a list's items are of one type; these are {' and '.join(map(str, kinds))}")
        t = list_of(kinds[0])
        return Typed(F.array(*(i.col for i in items)).cast(spark_type(t)) if items else F.array().cast(spark_type(t)), t)

    def _maplit(self, e: MapLit) -> Typed:
        return _map({k: self.compile(v) for k, v in e.entries})

    def _ref(self, e: Ref) -> Typed:
        name, *path = e.parts
        if e.keys:
            keys = [self.compile(k) for k in e.keys]
            if any(k.text is None for k in keys):
                raise ExprError(f"{name}[...]: keys must be known strings")
            name = f"{name}[{', '.join(k.text for k in keys)}]"
        if name not in self.scope.names:
            raise UndefinedError(f"undefined: {name}")
        here: Typed | dict = self.scope.names[name]
        for k, part in enumerate(path):
            found = self._field(here, part)
            if found is None:
                whole = ".".join([name, *path])
                if self.strict:
                    raise MissingFieldError(f"no field {part} in {'.'.join([name, *path[:k]])}")
                return Typed(F.lit(f"${{{whole}}}"), STRING, f"${{{whole}}}")
            here = found
        if isinstance(here, dict):
            return _map({k: v if isinstance(v, Typed) else self._whole(v) for k, v in sorted(here.items())})
        return here

    def _whole(self, fields: dict) -> Typed:
        return _map({k: v if isinstance(v, Typed) else self._whole(v) for k, v in sorted(fields.items())})

    def _field(self, here: Typed | dict, part: str) -> Typed | dict | None:
        if isinstance(here, Mapping):
            return here.get(part)
        t = _plain(here.type)
        if t.kind == "map":
            found = F.try_element_at(here.col, F.lit(part))
            if self.strict:
                return Typed(F.when(F.map_contains_key(here.col, part), found).otherwise(F.raise_error(F.lit(f"no field {part}"))), t.args[0])
            return Typed(F.coalesce(found, F.lit(f"${{{part}}}")) if t.args[0] == STRING else found, t.args[0])
        if t.kind == "struct" and part in t.names:
            return Typed(here.col.getField(part), t.args[t.names.index(part)])
        if t.kind == "any":
            return Typed(F.variant_get(here.col, f"$.{part}", "string"), STRING)
        return None

    def _call(self, e: Call) -> Typed:
        return call(e.name, [self.compile(a) for a in e.args])

    def _pipe(self, e: Pipe) -> Typed:
        return call(e.call.name, [self.compile(e.value), *(self.compile(a) for a in e.call.args)])

    def _if(self, e: If) -> Typed:
        test, then, other = self.compile(e.test), self.compile(e.then), self.compile(e.other)
        if _kind(test.type) != "bool":
            raise ExprError(f"a condition must be a bool, got {test.type}")
        t = then.type if then.type != NULL else other.type
        if NULL not in (then.type, other.type) and _kind(then.type) != _kind(other.type):
            raise ExprError(f"both branches must be of one type, got {then.type} and {other.type}")
        return Typed(F.when(test.col, then.col).when(~test.col, other.col).otherwise(F.raise_error(F.lit("a condition is null")).cast(spark_type(t)) if t != NULL else F.raise_error(F.lit("a condition is null"))), t)

    def _compare(self, e: Compare) -> Typed:
        left, right = self.compile(e.left), self.compile(e.right)
        same = self._equal(left, right)
        return Typed(same if e.equal else ~same, BOOL)

    @staticmethod
    def _equal(a: Typed, b: Typed) -> Column:
        """Null equals null; values of different types are different, and maps are compared entry by entry."""
        if NULL in (a.type, b.type):
            return F.lit(True) if a.type == b.type else (b if a.type == NULL else a).col.isNull()
        if _kind(a.type) != _kind(b.type):
            return F.lit(False)
        left, right = a.col, b.col
        if _kind(a.type) == "list" and spark_type(_plain(a.type)) != spark_type(_plain(b.type)):
            return (F.size(left) == 0) & (F.size(right) == 0)
        if _kind(a.type) == "map":
            if spark_type(_plain(a.type)) != spark_type(_plain(b.type)):
                return F.lit(False)
            left, right = F.array_sort(F.map_entries(left)), F.array_sort(F.map_entries(right))
        if _kind(a.type) == "struct" and _plain(a.type) != _plain(b.type):
            return F.lit(False)
        return left.eqNullSafe(right)

    def _add(self, e: Add) -> Typed:
        a, b = self.compile(e.left), self.compile(e.right)
        kinds = (_kind(a.type), _kind(b.type))
        if kinds == ("number", "number"):
            return Typed((a.col + b.col).cast(NUMBER_TYPE), NUMBER)
        if kinds == ("string", "string"):
            known = a.text + b.text if a.text is not None and b.text is not None else None
            return Typed(F.concat(a.col, b.col), STRING, known)
        if kinds == ("list", "list"):
            left, right = _plain(a.type), _plain(b.type)
            if isinstance(e.left, ListLit) and not e.left.items:
                return b
            if isinstance(e.right, ListLit) and not e.right.items:
                return a
            if spark_type(left) != spark_type(right):
                raise ExprError(f"cannot add {b.type} to {a.type}")
            return Typed(F.concat(a.col, b.col), left)
        raise ExprError(f"cannot add {b.type} to {a.type}")


def _value(x: object, t: Type) -> object:
    """A collected value as a driver value."""
    t = _plain(t)
    if x is None:
        return None
    if t.kind == "duration":
        return Duration(x)
    if t.kind == "number":
        return Decimal(x).normalize() + 0
    if t.kind == "list":
        return [_value(i, t.args[0]) for i in x]
    if t.kind == "map":
        return {k: _value(v, t.args[0]) for k, v in sorted(dict(x).items())}
    if t.kind == "struct":
        return {n: _value(x[n], a) for n, a in zip(t.names, t.args, strict=True)}
    return x


def evaluate_all(spark: SparkSession, exprs: dict[str, Expr], scope: Scope, strict: bool = True) -> dict[str, object]:
    """The values of expressions of literals, in one job of one row."""
    compiler = Compiler(scope, strict)
    typed = {k: compiler.compile(e) for k, e in exprs.items()}
    if all(t.text is not None for t in typed.values()):
        return {k: t.text for k, t in typed.items()}
    row = spark.range(1).select(*(t.col.alias(f"c{n}") for n, t in enumerate(typed.values()))).first()
    return {k: _value(row[n], t.type) for n, (k, t) in enumerate(typed.items())}


def evaluate(spark: SparkSession, e: Expr, scope: Scope | None = None, strict: bool = True) -> object:
    return evaluate_all(spark, {"it": e}, scope or Scope(), strict)["it"]


def select(df: DataFrame, exprs: dict[str, Expr], scope: Scope | None = None) -> DataFrame:
    """df's rows with the expressions as columns; names are df's columns, then the scope's."""
    own = Scope.of(df)
    for name, value in (scope.names if scope else {}).items():
        own.names.setdefault(name, value)
    compiler = Compiler(own)
    return df.select(*(compiler.compile(e).col.alias(k) for k, e in exprs.items()))
