"""The command line: python -m blockloom.cli [options] [targets]"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from blockloom.operators import graph
from blockloom.plans.ast import Param
from blockloom.plans.engine import Engine
from blockloom.plans.loader import load
from blockloom.plans.parser import parse
from blockloom.plans.providers import default_registry
from blockloom.plans.state import ParquetStore, project_folder


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom", description="Make what a pipeline's targets need and what has changed.")
    p.add_argument("targets", nargs="*", help="targets or blocks; ... is all")
    p.add_argument("-C", "--file", default="pipeline.loom", help="the pipeline")
    p.add_argument("--state", help="the folder of states and tables (default: .blockloom beside the pipeline)")
    p.add_argument("-j", "--jobs", type=int, default=os.cpu_count() or 1, help="blocks that run at once")
    p.add_argument("-P", "--param", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("-f", "--force", action="store_true", help="with --clean: protected blocks too, and on after failures")
    p.add_argument("-D", "--debug", action="store_true", help="show every event")
    p.add_argument("--json", action="store_true", help="with --schema")
    mode = p.add_mutually_exclusive_group()
    for short, name, text in (("-p", "plan", "show what would be done"), ("-c", "clean", "take away blocks and what depends on them"), ("-t", "test", "run tests and what they need"), ("-d", "dump", "show stored inputs and outputs"), ("-i", "info", "show parameters, targets and outputs"), ("-l", "list", "show the tree of blocks"), ("-g", "graph", "draw the graph")):
        mode.add_argument(short, f"--{name}", action="store_true", help=text)
    mode.add_argument("-s", "--schema", nargs="?", const="", metavar="LIKE", help="show the resources' fields")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("blockloom").getOrCreate()
    registry = default_registry()
    if a.schema is not None:
        rows = [r.asDict() for r in registry.catalog(spark, a.schema).collect()]
        print(json.dumps(rows, indent=1) if a.json else "\n".join(f"{r['provider']}.{r['resource']} {r['side']} {r['field']} : {r['type']}" for r in rows))
        return 0
    with open(a.file, encoding="utf-8") as f:
        text = f.read()
    root = os.path.dirname(os.path.abspath(a.file))
    if a.info:
        m = parse(text)
        for s in m.statements:
            kind = type(s).__name__.lower()
            if kind in ("param", "target", "output"):
                print(f"{kind} {s.name}" + (f" : {s.type}" if isinstance(s, Param) else "") + (f"  # {s.doc}" if s.doc else ""))
        return 0
    params = dict(p.split("=", 1) for p in a.param)
    g = load(spark, text, registry, params, root)
    if a.list:
        print("\n".join(graph.tree(spark, g.nodes_df(spark), g.edges_df(spark))))
        return 0
    if a.graph:
        print(graph.drawn(g.nodes_df(spark), g.edges_df(spark)))
        return 0
    folder = a.state or project_folder(os.path.join(root, ".blockloom"), os.path.abspath(a.file))
    say = lambda e: print(f"{e.block}: {e.event}{' ' + e.message if e.message else ''}")
    engine = Engine(spark, g, registry, ParquetStore(spark, f"{folder}/state"), f"{folder}/tables", say if a.debug else None)
    if a.dump:
        print("\n".join(f"{r.block}.{r.field} ({r.side}) = {r.value}" for r in engine.dump().collect()))
    elif a.clean:
        print("\n".join(f"{n}: destroyed" for n in engine.destroy(*a.targets, force=a.force)))
    else:
        steps = engine.plan(*a.targets) if a.plan else engine.test(a.jobs) if a.test else engine.apply(*a.targets, jobs=a.jobs)
        print("\n".join(f"{s.block}: {s.action}{' (' + s.reason + ')' if s.reason else ''}" for s in steps))
        if not a.plan and not a.test:
            print("\n".join(f"{k} = {v}" for k, v in engine.outputs().items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
