"""Providers: the resources that blocks are made of, and those that come with the library."""

from __future__ import annotations

import dataclasses
import hashlib
import types
import typing
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import library
from blockloom.functions.types import ANY, BOOL, DURATION, NUMBER, STRING, Duration, Type, from_json_value, list_of, map_of, optional, spark_type, struct_of, union_of
from blockloom.sources import files

CREATE, UPDATE, NONE = "create", "update", "none"


@dataclass
class Context:
    """What a resource works with."""

    spark: SparkSession
    block: str
    folder: str  # where materialised blocks lie


@dataclass
class Applied:
    outputs: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)
    passed: bool | None = None
    message: str = ""


class Resource(ABC):
    """A kind of block. inputs and outputs are its schema; kind is build or test."""

    kind = "build"
    inputs: dict[str, Type] = {}
    outputs: dict[str, Type] = {}
    doc = ""

    def resolve(self, ctx: Context, inputs: dict) -> dict[str, str]:
        """The sources that the block reads: a hash for each."""
        return {}

    def plan(self, ctx: Context, inputs: dict, prior: dict | None) -> str:
        return CREATE if prior is None else NONE if prior.get("inputs") == inputs else UPDATE

    @abstractmethod
    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied: ...

    def destroy(self, ctx: Context, prior: dict) -> None:
        return None

    def input_schema(self):  # noqa: ANN201
        from pyspark.sql import types as T

        return T.StructType([T.StructField(n, spark_type(t), t.kind == "optional", {"type": str(t)}) for n, t in self.inputs.items()])


def schema_of(cls: type) -> dict[str, Type]:
    """The fields of a dataclass as a resource's schema."""
    simple = {str: STRING, bool: BOOL, int: NUMBER, float: NUMBER, Decimal: NUMBER, Duration: DURATION}

    def of(t: object) -> Type:
        if t in simple:
            return simple[t]
        origin, args = typing.get_origin(t), typing.get_args(t)
        if origin is list:
            return list_of(of(args[0]))
        if origin is dict:
            return map_of(of(args[1]))
        if origin in (typing.Union, types.UnionType):
            members = [of(a) for a in args if a is not type(None)]
            one = members[0] if len(members) == 1 else union_of(*members)
            return optional(one) if type(None) in args else one
        if dataclasses.is_dataclass(t):
            return struct_of(schema_of(t))
        return ANY

    hints = typing.get_type_hints(cls)
    return {f.name: of(hints[f.name]) for f in dataclasses.fields(cls)}


class Registry:
    def __init__(self) -> None:
        self._found: dict[tuple[str, str], Resource] = {}

    def add(self, provider: str, name: str, resource: Resource) -> None:
        self._found[provider, name] = resource

    def has(self, provider: str, name: str) -> bool:
        return (provider, name) in self._found

    def get(self, provider: str, name: str) -> Resource:
        if (provider, name) not in self._found:
            raise KeyError(f"unknown resource {provider}.{name}")
        return self._found[provider, name]

    def catalog(self, spark: SparkSession, like: str = "") -> DataFrame:
        """provider, resource, kind, side, field, type, required of all resources whose name contains like."""
        rows = [
            (p, r, x.kind, side, n, str(t), t.kind != "optional")
            for (p, r), x in sorted(self._found.items()) if like in f"{p}.{r}" for side, fields in (("input", x.inputs), ("output", x.outputs)) for n, t in fields.items()
        ]
        return spark.createDataFrame(rows, "provider string, resource string, kind string, side string, field string, type string, required boolean")


class Value(Resource):
    """Its outputs are its inputs."""

    inputs = {"*": ANY}

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        return Applied(dict(inputs))


class File(Resource):
    """Files of one format, read by Spark. Its sources are its folders, by the names, lengths and times of their files; with contents, the files by what is in them."""

    inputs = {"path": STRING, "format": optional(STRING), "contents": optional(BOOL)}
    outputs = {"path": STRING, "format": STRING}

    def resolve(self, ctx: Context, inputs: dict) -> dict[str, str]:
        found = files.tree_hashes(ctx.spark, inputs["path"]) if inputs.get("contents") else files.folder_hashes(ctx.spark, inputs["path"])
        return {r["path"]: r["hash"] for r in found.collect()}  # a row for each folder, or for each file that this block names

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        return Applied({"path": inputs["path"], "format": inputs.get("format") or "parquet"})


def interval(d: Duration) -> timedelta:
    """A duration as a query's value, to the microsecond."""
    return timedelta(microseconds=int(d) // 1_000)


class Sql(Resource):
    """A query over the files of other blocks, materialised as Parquet. args are the values of its :named markers, typed and never part of its text."""

    inputs = {"query": STRING, "args": optional(map_of(ANY)), "tables": optional(map_of(STRING)), "format": optional(STRING), "partition_by": optional(union_of(STRING, list_of(STRING)))}
    outputs = {"path": STRING, "columns": list_of(STRING)}

    def frame(self, ctx: Context, inputs: dict) -> DataFrame:
        session = ctx.spark.newSession()  # views of one block do not reach another
        for name, path in sorted((inputs.get("tables") or {}).items()):
            session.read.format(inputs.get("format") or "parquet").load(path).createOrReplaceTempView(name)
        return session.sql(inputs["query"], args={k: interval(v) if isinstance(v, Duration) else v for k, v in (inputs.get("args") or {}).items()})

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        df = self.frame(ctx, inputs)
        name = hashlib.sha256(repr((ctx.block, sorted(inputs.items(), key=lambda x: x[0]))).encode()).hexdigest()[:16]
        path = f"{ctx.folder}/{name}"
        writer = df.write.mode("overwrite")
        by = inputs.get("partition_by")
        if by:
            writer = writer.partitionBy(*([by] if isinstance(by, str) else by))
        writer.parquet(path)
        return Applied({"path": path, "columns": df.columns})

    def destroy(self, ctx: Context, prior: dict) -> None:
        files.delete(ctx.spark, prior["outputs"]["path"])


class Expect(Resource):
    """A data-quality gate: passes if no row breaks the condition."""

    kind = "test"
    inputs = {"path": STRING, "condition": STRING, "at_most": optional(NUMBER), "format": optional(STRING)}
    outputs = {"passed": BOOL, "broken": NUMBER}

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        df = ctx.spark.read.format(inputs.get("format") or "parquet").load(inputs["path"])
        broken = df.where(~F.coalesce(F.expr(inputs["condition"]), F.lit(False))).count()
        ok = broken <= (inputs.get("at_most") or 0)
        return Applied({"passed": ok, "broken": from_json_value(broken)}, passed=ok, message="" if ok else f"{broken} rows break: {inputs['condition']}")


class Exec(Resource):
    """A command's output, where the library's run_command allows it."""

    inputs = {"command": STRING, "inputs": optional(list_of(STRING)), "output": optional(union_of(STRING, list_of(STRING)))}
    outputs = {"stdout": STRING}

    def resolve(self, ctx: Context, inputs: dict) -> dict[str, str]:
        found: dict[str, str] = {}
        for pattern in inputs.get("inputs") or []:
            found |= files.glob_hashes(pattern)
        out = inputs.get("output") or []
        return found | files.list_hashes([out] if isinstance(out, str) else out)

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        if library.run_command is None:
            raise library.FunctionError("exec: running commands is switched off; set blockloom.functions.library.run_command")
        return Applied({"stdout": library.run_command(inputs["command"])})


class Custom(Resource):
    """A resource from a function of (context, inputs) that returns outputs."""

    def __init__(self, f: Callable[[Context, dict], dict], kind: str = "build", inputs: dict[str, Type] | None = None, outputs: dict[str, Type] | None = None) -> None:
        self.f, self.kind, self.inputs, self.outputs = f, kind, inputs or {"*": ANY}, outputs or {}

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        out = self.f(ctx, inputs)
        return Applied(out, passed=bool(out.get("passed")) if self.kind == "test" else None)


def default_registry() -> Registry:
    """All resources that come with the library."""
    from blockloom.plans.tools import add_tools

    r = Registry()
    for provider, name, resource in (("value", "value", Value()), ("module", "outputs", Value()), ("table", "file", File()), ("table", "sql", Sql()), ("table", "expect", Expect())):
        r.add(provider, name, resource)
    return add_tools(r)
