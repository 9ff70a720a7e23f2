"""The built-in functions of pipeline expressions, as columns."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions.types import STRING, Type, list_of


class FunctionError(ValueError):
    """An unknown function, a wrong number of arguments or an argument of the wrong type."""


@dataclass(frozen=True)
class Typed:
    """A column and the type of its values; text is a string literal's value, where the column is one."""

    col: Column
    type: Type
    text: str | None = None


def _quoted(sep: Column) -> Column:
    """A regular expression that matches sep itself."""
    return F.concat(F.lit(r"\Q"), F.replace(sep, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def lines(s: Column) -> Column:
    return F.filter(F.split(s, r"\r?\n"), lambda x: x != "")


def split(s: Column, sep: Column) -> Column:
    """Parts between literal separators; an empty one splits before, between and after all characters."""
    chars = F.when(s == "", F.array(F.lit(""), F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.filter(F.split(s, ""), lambda x: x != ""), F.array(F.lit(""))))
    return F.when(sep == "", chars).otherwise(F.split(s, _quoted(sep)))


def _without_end(s: Column) -> Column:
    return F.regexp_replace(s, r"(/+\.?)+$", "")


def basename(s: Column) -> Column:
    last = F.regexp_replace(_without_end(s), r"^(?s).*/", "")
    return F.when(last.isin(".", ".."), F.lit("")).otherwise(last)


def dirname(s: Column) -> Column:
    t = _without_end(s)
    up = F.regexp_replace(F.regexp_replace(t, r"/+[^/]*$", ""), r"(/+\.)+$", "")
    return F.when(~F.contains(t, F.lit("/")), F.lit("")).when((up == "") & F.startswith(t, F.lit("/")), F.lit("/")).otherwise(up)


def _of_text_or_list(f: Callable[..., Column]) -> Callable[..., Typed]:
    """f of a string, or of each string of a list."""

    def run(value: Typed, *more: Typed) -> Typed:
        if value.type.kind == "list":
            return Typed(F.transform(value.col, lambda x: f(x, *(m.col for m in more))), list_of(STRING))
        return Typed(f(value.col, *(m.col for m in more)), STRING)

    return run


def env(name: Typed, default: Typed | None = None) -> Typed:
    """An environment variable of the driver; pipelines name it by a literal."""
    if name.text is None:
        raise FunctionError("env: the name must be a literal string")
    found = os.environ.get(name.text)
    if found is None and default is None:
        raise FunctionError(f"env: {name.text} is not set")
    return default if found is None else Typed(F.lit(found), STRING, found)


def secret(name: Typed) -> Typed:
    found = env(name)
    return Typed(found.col, Type("secret"), found.text)


def glob(pattern: Typed) -> Typed:
    """Paths that match, in order, found by the driver."""
    from blockloom.sources.files import driver_glob

    if pattern.text is None:
        raise FunctionError("glob: the pattern must be a literal string")
    found = driver_glob(pattern.text)
    return Typed(F.array(*map(F.lit, found)) if found else F.array().cast("array<string>"), list_of(STRING))


#: Replaced by those who want pipelines to run commands: a function of the command that returns its output.
run_command: Callable[[str], str] | None = None


def exec_(command: Typed) -> Typed:
    if run_command is None:
        raise FunctionError("exec: running commands is switched off; set blockloom.functions.library.run_command")
    if command.text is None:
        raise FunctionError("exec: the command must be a literal string")
    out = run_command(command.text)
    return Typed(F.lit(out), STRING, out)


_S, _L = ("string",), ("string", "list")
#: name: implementation, kinds of each argument, and how many are needed.
FUNCTIONS: dict[str, tuple[Callable[..., Typed], tuple[tuple[str, ...], ...], int]] = {
    "env": (env, (_S, _S), 1),
    "exec": (exec_, (_S,), 1),
    "glob": (glob, (_S,), 1),
    "secret": (secret, (_S,), 1),
    "trim": (_of_text_or_list(trim), (_L,), 1),
    "lines": (lambda s: Typed(lines(s.col), list_of(STRING)), (_S,), 1),
    "split": (lambda s, sep: Typed(split(s.col, sep.col), list_of(STRING)), (_S, _S), 2),
    "uniq": (lambda x: Typed(F.array_distinct(x.col), x.type), (("list",),), 1),
    "basename": (_of_text_or_list(basename), (_L,), 1),
    "dirname": (_of_text_or_list(dirname), (_L,), 1),
    "prefix": (_of_text_or_list(lambda s, p: F.concat(p, s)), (_L, _S), 2),
    "suffix": (_of_text_or_list(lambda s, e: F.concat(s, e)), (_L, _S), 2),
    "sha256": (lambda s: Typed(F.sha2(s.col, 256), STRING), (_S,), 1),
}


def call(name: str, args: list[Typed]) -> Typed:
    if name not in FUNCTIONS:
        raise FunctionError(f"unknown function: {name}")
    f, kinds, needed = FUNCTIONS[name]
    if not needed <= len(args) <= len(kinds):
        raise FunctionError(f"{name}: expected {needed if needed == len(kinds) else f'{needed} to {len(kinds)}'} arguments, got {len(args)}")
    for k, (arg, allowed) in enumerate(zip(args, kinds, strict=False)):
        kind = arg.type.args[0].kind if arg.type.kind == "optional" else arg.type.kind
        if ("string" if kind in ("path", "secret") else kind) not in allowed:
            raise FunctionError(f"{name}: argument {k + 1} must be {' or '.join(allowed)}, got {arg.type}")
        if kind == "list" and name != "uniq" and arg.type.args[0].kind not in ("string", "path", "secret"):
            raise FunctionError(f"{name}: expected a list of strings, got {arg.type}")
    return f(*args)
