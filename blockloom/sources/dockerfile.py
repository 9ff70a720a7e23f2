"""What a Dockerfile reads: its variables and the sources of COPY and ADD."""

from __future__ import annotations

import platform
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.sources.files import expanded

_VARIABLE = re.compile(r"\$(?:\{([A-Za-z_]\w*)(?:(:[-+])([^}]*))?\}|([A-Za-z_]\w*))")
# Machine names, and the builder's names of architecture and variant for them; others keep their own name.
ARCHITECTURES = {
    "x86_64": ("amd64", ""), "amd64": ("amd64", ""), "aarch64": ("arm64", ""), "arm64": ("arm64", ""), "arm": ("arm", "v7"), "armv7l": ("arm", "v7"), "s390x": ("s390x", ""),
    "powerpc64": ("ppc64le", ""), "ppc64le": ("ppc64le", ""), "riscv64": ("riscv64", ""),
}
#: Systems on which the builder makes images of another.
SYSTEMS = {"darwin": "linux", "macos": "linux"}


class UnresolvedError(ValueError):
    """A variable that has no value."""


def platform_variables(machine: str | None = None, system: str | None = None) -> dict[str, str]:
    """The variables that a build has of its own accord."""
    machine, os = (machine or platform.machine()).lower(), (system or platform.system()).lower()
    arch, variant = ARCHITECTURES.get(machine, (machine, ""))
    os = SYSTEMS.get(os, os)
    whole = f"{os}/{arch}/{variant}" if variant else f"{os}/{arch}"
    return {f"{side}{name}": value for side in ("TARGET", "BUILD") for name, value in (("PLATFORM", whole), ("OS", os), ("ARCH", arch), ("VARIANT", variant))}


def expand(text: str, variables: dict[str, str]) -> str:
    """$V, ${V}, ${V:-default} and ${V:+other}."""

    def one(m: re.Match) -> str:
        name, how, word = m[1] or m[4], m[2], m[3] or ""
        value = variables.get(name)
        if how == ":-":
            return value or expand(word, variables)
        if how == ":+":
            return expand(word, variables) if value else ""
        if value is None:
            raise UnresolvedError(f"unresolved variable {name} in {text}")
        return value

    return _VARIABLE.sub(one, text)


def expand_column(text: Column, variables: dict[str, str]) -> Column:
    """expand of a column, for variables that are known beforehand: one replacement for each of them, no UDF."""
    for name, value in variables.items():
        quoted = value.replace("\\", "\\\\").replace("$", "\\$")
        with_word = quoted if value else "$1"
        text = F.regexp_replace(text, rf"\$\{{{name}:-([^}}]*)\}}", with_word)
        text = F.regexp_replace(text, rf"\$\{{{name}:\+([^}}]*)\}}", "$1" if value else "")
        text = F.regexp_replace(text, rf"\$(?:\{{{name}\}}|{name}\b)", quoted)
    text = F.regexp_replace(text, r"\$\{[A-Za-z_]\w*:-([^}]*)\}", "$1")
    text = F.regexp_replace(text, r"\$\{[A-Za-z_]\w*:\+[^}]*\}", "")
    return F.when(text.rlike(r"\$(\{[A-Za-z_]|[A-Za-z_])"), F.raise_error(F.concat(F.lit("unresolved variable in "), text))).otherwise(text)


def instructions(text: str) -> list[tuple[str, str]]:
    """(name, rest) of each instruction; continued lines are one, comments are left out."""
    joined = re.sub(r"\\[ \t]*\n", " ", "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("#")))
    return [(m[1].upper(), m[2].strip()) for m in re.finditer(r"^[ \t]*([A-Za-z]+)[ \t]+(.+)$", joined, re.M)]


def variables(text: str, build_args: dict[str, str] | None = None) -> dict[str, str]:
    """The values of ARG and ENV; a build argument replaces an ARG's default and gives those that have none."""
    out, given = platform_variables(), build_args or {}
    for name, rest in instructions(text):
        if name == "ARG":
            key, _, default = rest.partition("=")
            value = given.get(key.strip(), default.strip("\"'") if "=" in rest else None)
            if value is not None:
                out[key.strip()] = expand(value, out)
        elif name == "ENV":
            pairs = re.findall(r"([A-Za-z_]\w*)=(\"[^\"]*\"|'[^']*'|\S*)", rest) or [tuple(rest.split(None, 1))]
            out |= {k: expand(v.strip("\"'"), out) for k, v in pairs}
    return out


def sources(text: str, build_args: dict[str, str] | None = None) -> list[str]:
    """What COPY and ADD take from the context: not from other stages, and no addresses."""
    known, out = variables(text, build_args), []
    for name, rest in instructions(text):
        if name in ("COPY", "ADD") and "--from" not in rest:
            listed = re.findall(r'"((?:[^"\\]|\\.)*)"', rest) if rest.lstrip().startswith("[") else [w for w in rest.split() if not w.startswith("--")]
            out += [expand(s, known) for s in listed[:-1] if not re.match(r"https?://|git@", s)]
    return list(dict.fromkeys(out))


def image_sources(paths: DataFrame, text: str, build_args: dict[str, str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """path: all files of the context paths(path) that the image is made of, without ignored ones."""
    out = paths.limit(0)
    for s in sources(text, build_args):
        out = out.unionByName(expanded(paths, s, rules))
    return out.distinct()


#: A health check's defaults: interval, timeout and retries; fixed values.
HEALTH = (1_000_000_000, 5_000_000_000, 3)


def health_deadline(interval: int = HEALTH[0], timeout: int = HEALTH[1], retries: int = HEALTH[2], start_period: int = 0) -> int:
    """Nanoseconds after which a container that is not healthy has failed."""
    return start_period + interval * retries + timeout


def extra_hosts(given: dict[str, str], linux: bool) -> list[tuple[str, str]]:
    """The hosts that a container knows, in order; on Linux the host machine is one of them."""
    return sorted((({"host.docker.internal": "host-gateway"} if linux else {}) | given).items())
