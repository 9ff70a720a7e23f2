"""Resources whose work a program outside does: images, packages, scripts, builds, tests and formatting.

What such a block reads is chosen by Spark among the project's paths and sources, what its log says is worked out by Spark from the lines, and whether it is
stale is decided here. The program itself is run by the library's run_command, which is off until somebody sets it.
"""

from __future__ import annotations

import json
import os
import re
import shlex
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import library
from blockloom.functions.types import BOOL, NUMBER, STRING, Type, list_of, map_of, optional, struct_of, union_of
from blockloom.operators import logs
from blockloom.plans.providers import CREATE, NONE, UPDATE, Applied, Context, Exec, Registry, Resource
from blockloom.sources import code, dockerfile, files

TEXT, TEXTS, FLAG, PAIRS = optional(STRING), optional(union_of(STRING, list_of(STRING))), optional(BOOL), optional(map_of(STRING))


def listed(value: object) -> list:
    """A field that is one value or a list of them."""
    return [] if value is None else list(value) if isinstance(value, list) else [value]


class Failed(RuntimeError):
    """A program that ended badly; output is what it said."""

    def __init__(self, message: str, output: str = "") -> None:
        super().__init__(message)
        self.output = output


def run(args: list[str] | str, folder: str | None = None, env: dict[str, str] | None = None) -> str:
    """A command's output, by the library's run_command; Failed with the output if it ends badly."""
    if library.run_command is None:
        raise library.FunctionError("running commands is switched off; set blockloom.functions.library.run_command")
    command = args if isinstance(args, str) else shlex.join(args)
    command = " ".join([*(f"{k}={shlex.quote(v)}" for k, v in (env or {}).items()), command])
    try:
        return library.run_command(f"cd {shlex.quote(folder)} && {command}" if folder and folder != "." else command)
    except Exception as e:  # whatever the runner raises
        raise Failed(str(e), getattr(e, "output", None) or getattr(e, "stdout", None) or "") from e


def tried(args: list[str] | str, folder: str | None = None, env: dict[str, str] | None = None) -> tuple[bool, str]:
    """Whether a command ends well, and its output."""
    try:
        return True, run(args, folder, env)
    except Failed as e:
        return False, e.output


def lines_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(output.splitlines())), "seq long, line string")


# What blocks read.


#: Folders that hold what tools bring or make, never a project's own files; an image may copy them all the same.
NOT_SOURCES = ("node_modules", ".git")


def project(spark: SparkSession, root: str, texts: str | None = None, skipped: tuple[str, ...] = NOT_SOURCES) -> DataFrame:
    """path (from root) and text of a project's files on this machine, where its tools run; text only of names that end in texts."""
    rows = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(x for x in inner if x not in skipped)
        for name in sorted(names):
            path, text = os.path.join(folder, name), None
            if texts and name.endswith(texts):
                with open(path, encoding="utf-8", errors="replace") as f:
                    text = f.read()
            rows.append((os.path.relpath(path, root), text))
    return spark.createDataFrame(rows, "path string, text string")


def hashed(root: str, chosen: DataFrame) -> dict[str, str]:
    """path: hash of the chosen files, by their paths from root."""
    names = sorted({r["path"] for r in chosen.select("path").collect()})  # the files of one block
    found = files.list_hashes([os.path.join(root, p) for p in names])
    return {p: found[at] for p in names if (at := os.path.join(root, p)) in found}


def go_inputs(ctx: Context, package: str, tests: bool) -> dict[str, str]:
    """The files of a package and of what it imports from its module, with what they embed."""
    root = code.module_root(".")
    if root is None:
        raise ValueError("go: no go.mod in this folder or above")
    with open(os.path.join(root, "go.mod"), encoding="utf-8") as f:
        module = code.module_path(f.read())
    every = project(ctx.spark, root, ".go")
    needed = code.go_closure(every.select("path", "text"), module or "", package, tests)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "/")).otherwise(F.lit(""))
    wanted = code.go_embeds(every.join(needed, "path", "left_semi")).select(F.concat(folder, "pattern").alias("p")).distinct().collect()  # lines of the block's own sources
    for r in wanted:
        needed = needed.unionByName(files.expanded(every.select("path"), r["p"]))
    return hashed(root, needed)


def cargo_inputs(ctx: Context) -> dict[str, str]:
    """Rust files and manifests around all targets of the workspace's packages, with its lock file."""
    meta = run(["cargo", "metadata", "--format-version", "1", "--no-deps"])
    here = os.getcwd()
    relative = lambda c: F.regexp_replace(c, f"^{re.escape(here)}/?", "")
    packages = code.cargo_folders(ctx.spark.createDataFrame([(meta,)], "metadata string")).select("name", relative("folder").alias("folder"), relative("target").alias("target"))
    every = project(ctx.spark, here)
    inside = code.cargo_sources(every.select("path"), packages.where("folder <> ''"))  # what is built lies in the project's folder too
    own = every.where(F.col("path").isin("Cargo.toml", "Cargo.lock")).select("path").unionByName(packages.where("target IS NOT NULL").select(F.col("target").alias("path")))
    return hashed(here, inside.select("path").unionByName(own))


def workspace(folder: str) -> dict[str, str]:
    """name: folder of a workspace's packages, as its own files have them."""
    listing = os.path.join(folder, "pnpm-workspace.yaml")
    if not os.path.isfile(listing):
        return {}
    with open(listing, encoding="utf-8") as f:
        yaml = f.read()
    manifests = {}
    for path in files.driver_glob(os.path.join(folder, "**", "package.json")):
        inner = os.path.relpath(os.path.dirname(path), folder)
        if "node_modules" not in inner.split(os.sep):
            with open(path, encoding="utf-8") as f:
                manifests[inner] = f.read()
    return code.workspace_packages(yaml, manifests)


def script_inputs(ctx: Context, i: dict) -> dict[str, str]:
    folder, package = i.get("dir") or ".", i.get("package")
    inside = workspace(folder)
    if package and package not in inside:
        raise ValueError(f"pnpm: no package {package} in this workspace")
    every = project(ctx.spark, folder)
    found = code.run_sources(every.select("path"), inside.get(package) if package else None, tuple(listed(i.get("inputs"))), tuple(listed(i.get("output"))))
    return hashed(folder, found)


def install_inputs(ctx: Context, i: dict) -> dict[str, str]:
    folder = i.get("dir") or "."
    own = ["package.json", "pnpm-lock.yaml", "pnpm-workspace.yaml", "node_modules/.modules.yaml", *(os.path.join(f, "package.json") for f in workspace(folder).values())]
    return {os.path.relpath(p, folder): h for p, h in files.list_hashes([os.path.join(folder, p) for p in own]).items()}


def image_inputs(ctx: Context, i: dict) -> dict[str, str]:
    """The Dockerfile, and what it copies from the context, without what is ignored there."""
    context, name = i.get("context") or ".", i.get("dockerfile") or "Dockerfile"
    every = project(ctx.spark, context, skipped=())
    with open(os.path.join(context, name), encoding="utf-8") as f:
        text = f.read()
    ignore = os.path.join(context, ".dockerignore")
    rules = None
    if os.path.isfile(ignore):
        with open(ignore, encoding="utf-8") as f:
            rules = ctx.spark.createDataFrame(files.ignore_rules(f.read()), "seq int, pattern string, negate boolean")
    found = dockerfile.image_sources(every.select("path"), text, i.get("build_args"), rules)
    return hashed(context, found.unionByName(every.select("path").where(F.col("path") == name)))


# Commands.


def go_env(i: dict) -> dict[str, str]:
    out = {k.upper(): i[k] for k in ("goos", "goarch") if i.get(k)}
    return out | ({"CGO_ENABLED": "1" if i["cgo"] else "0"} if i.get("cgo") is not None else {})


def go_binary(i: dict) -> str:
    return i.get("output") or i["package"].rsplit("/", 1)[-1]


def cargo(i: dict, word: str, *more: str) -> list[str]:
    """A cargo command with toolchain, target, profile, package, features and flags; formatting knows only toolchain and package."""
    out = [f"cargo+{i['toolchain']}" if i.get("toolchain") else "cargo", word]
    for name in ("target", "profile") if word != "fmt" else ():
        out += [f"--{name}", i[name]] if i.get(name) else []
    out += ["--bin", i["bin"]] if i.get("bin") else []
    out += ["-p", i["package"]] if i.get("package") else []
    out += ["--all-features"] if i.get("all_features") else ["--features", ",".join(listed(i.get("features")))] if listed(i.get("features")) else []
    return [*out, *listed(i.get("flags")), *more]


def script(i: dict, word: str | None = None) -> list[str]:
    package, args = i.get("package"), listed(i.get("args"))
    return ["pnpm", *(["--filter", package] if package else []), "run", i.get("script") or word or "", *(["--", *args] if args else [])]


def image_build(i: dict) -> list[str]:
    platforms = listed(i.get("platform"))
    out = ["docker", "buildx", "build", "-t", i["tag"], "-f", i.get("dockerfile") or "Dockerfile"]
    out += ["--platform", ",".join(platforms)] if platforms else []
    out.append("--push" if len(platforms) > 1 else "--load")
    for k, v in sorted((i.get("build_args") or {}).items()):
        out += ["--build-arg", f"{k}={v}"]
    return [*out, i.get("context") or "."]


def container_run(i: dict, linux: bool = True) -> list[str]:
    out = ["docker", "run", "-d", "--name", i["name"]]
    for flag, values in (("-p", listed(i.get("ports"))), ("-v", listed(i.get("volumes"))), ("-e", [f"{k}={v}" for k, v in sorted((i.get("environment") or {}).items())])):
        for v in values:
            out += [flag, v]
    out += ["--entrypoint", i["entrypoint"]] if i.get("entrypoint") else []
    out += ["--restart", i.get("restart") or "no"]
    out += ["--network", i["network"]] if i.get("network") else []
    hosts = ({"host.docker.internal": "host-gateway"} if linux else {}) | (i.get("extra_hosts") or {})
    for k, v in sorted(hosts.items()):
        out += ["--add-host", f"{k}:{v}"]
    out += ["-w", i["working_dir"]] if i.get("working_dir") else []
    check = i.get("healthcheck")
    if check:
        check = {"test": check} if isinstance(check, str) else check
        out += ["--health-cmd", check["test"], "--health-interval", str(check.get("interval") or "1s"), "--health-timeout", str(check.get("timeout") or "5s"), "--health-retries", str(check.get("retries") or 3)]
        out += ["--health-start-period", str(check["start_period"])] if check.get("start_period") else []
    return [*out, i["image"], *(i.get("command") or "").split()]


# Resources.


class Tool(Resource):
    """A block that a program makes, or a test that it decides.

    inputs, outputs: its fields; same: those which make it another block when they change; reads: its sources; does: makes it;
    gone: whether what it had made is there no more; drifted: whether it must be made again; undoes: takes it away.
    """

    def __init__(
        self, kind: str, inputs: dict[str, Type], outputs: dict[str, Type], same: list[str], does: Callable[[Context, dict, dict | None], Applied], reads: Callable[[Context, dict], dict[str, str]] = lambda ctx, i: {},
        checks: Callable[[dict], None] = lambda i: None, gone: Callable[[dict], bool] = lambda state: False, drifted: Callable[[dict, dict], bool] = lambda i, state: False, undoes: Callable[[dict], None] = lambda state: None,
    ) -> None:
        self.kind, self.inputs, self.outputs, self.same, self.does, self.reads = kind, inputs, outputs, same, does, reads
        self.checks, self.gone, self.drifted, self.undoes = checks, gone, drifted, undoes

    def resolve(self, ctx: Context, inputs: dict) -> dict[str, str]:
        return self.reads(ctx, inputs)

    def plan(self, ctx: Context, inputs: dict, prior: dict | None) -> str:
        self.checks(inputs)
        if prior is None:
            return CREATE
        before = prior.get("inputs") or {}
        if any(before.get(k) != inputs.get(k) for k in self.same):
            return UPDATE
        if self.gone(prior):
            return CREATE
        return UPDATE if self.drifted(inputs, prior) else NONE

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        return self.does(ctx, inputs, prior)

    def destroy(self, ctx: Context, prior: dict) -> None:
        self.undoes(prior)


def tested(passed: bool, output: str = "") -> Applied:
    return Applied({"passed": passed}, passed=passed, message="" if passed else output[-2000:])


def by_exit(command: Callable[[dict], list[str]], env: Callable[[dict], dict] = lambda i: {}, folder: Callable[[dict], str | None] = lambda i: None, silent: bool = False) -> Callable:
    """A test that passes if the command ends well, and if silent, says nothing."""

    def does(ctx: Context, i: dict, prior: dict | None) -> Applied:
        ok, output = tried(command(i), folder(i), env(i))
        return tested(ok and not (silent and output.strip()), output)

    return does


def by_log(command: Callable[[dict], list[str]], verdict: Callable[[DataFrame, bool], DataFrame], env: Callable[[dict], dict] = lambda i: {}) -> Callable:
    """A test whose log decides, and how the command ends only where the log tells of no test."""

    def does(ctx: Context, i: dict, prior: dict | None) -> Applied:
        ok, output = tried(command(i), None, env(i))
        return tested(bool(verdict(lines_of(ctx.spark, output), ok).first()["passed"]), output)

    return does


def made(command: Callable[[dict], list[str]], outputs: Callable[[Context, dict, str], dict] = lambda ctx, i, said: {}, env: Callable[[dict], dict] = lambda i: {}, folder: Callable[[dict], str | None] = lambda i: None) -> Callable:
    def does(ctx: Context, i: dict, prior: dict | None) -> Applied:
        prepare(listed(i.get("output")))
        return Applied(outputs(ctx, i, run(command(i), folder(i), env(i))))

    return does


def prepare(outputs: list[str]) -> None:
    """The folders that outputs lie in, or are, if they end in a slash."""
    for path in outputs:
        if folder := path if path.endswith("/") else os.path.dirname(path):
            os.makedirs(folder, exist_ok=True)


def remove(paths: list[str]) -> None:
    for path in paths:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.isfile(path):
            os.remove(path)


def paths_of(outputs: list[str]) -> dict:
    """path for one output, paths for several."""
    return {} if not outputs else {"path": outputs[0]} if len(outputs) == 1 else {"paths": outputs}


def image_id(image: str) -> str:
    ok, found = tried(["docker", "inspect", "--format", "{{.Id}}", image])
    return found.strip().removeprefix("sha256:") if ok else ""


def _image(ctx: Context, i: dict, prior: dict | None) -> Applied:
    run(image_build(i))
    found = image_id(i["tag"])
    pinned = f"{i['tag'].split(':')[0]}:{found}"  # a name that always means this image
    run(["docker", "tag", i["tag"], pinned])
    return Applied({"ref": pinned, "image_id": found})


def _image_checks(i: dict) -> None:
    if len(listed(i.get("platform"))) > 1 and "/" not in i["tag"]:
        raise ValueError(f"an image for several platforms needs a tag with its registry, not {i['tag']}")


def _image_gone(state: dict) -> bool:
    return not tried(["docker", "image", "inspect", state["outputs"]["image_id"]])[0]


def _image_undone(state: dict) -> None:
    tried(["docker", "rmi", "-f", state["outputs"]["ref"]])
    run(["docker", "rmi", "-f", state["outputs"]["image_id"]])


def _container(ctx: Context, i: dict, prior: dict | None) -> Applied:
    tried(["docker", "rm", "-f", i["name"]])  # what is left of one with this name
    return Applied({"container_id": run(container_run(i)).strip(), "name": i["name"]})


def network_id(name: str) -> str:
    ok, found = tried(["docker", "network", "inspect", "--format", "{{.Id}}", name])
    return found.strip() if ok else ""


def _network(ctx: Context, i: dict, prior: dict | None) -> Applied:
    """One of this name is adopted; if this block had made it with another driver, it is made anew."""
    found = network_id(i["name"])
    if found and prior is not None and (prior.get("inputs") or {}).get("driver") != i.get("driver"):
        run(["docker", "network", "rm", i["name"]])
        found = ""
    if not found:
        found = run(["docker", "network", "create", *(["--driver", i["driver"]] if i.get("driver") else []), i["name"]]).strip()
    return Applied({"name": i["name"], "id": found})


def _network_undone(state: dict) -> None:
    if network_id(state["outputs"]["name"]):
        run(["docker", "network", "rm", state["outputs"]["name"]])


def _push(ctx: Context, i: dict, prior: dict | None) -> Applied:
    run(["docker", "tag", i["image"], i["tag"]])
    run(["docker", "push", i["tag"]])
    return Applied({"ref": i["tag"]}, state={"image_id": image_id(i["image"])})


def _install(ctx: Context, i: dict, prior: dict | None) -> Applied:
    folder = i.get("dir") or "."
    run(["pnpm", "install", *(["--frozen-lockfile"] if i.get("frozen") else [])], folder)
    return Applied({"path": os.path.join(folder, "node_modules")}, state={"folders": [folder, *(os.path.join(folder, f) for f in workspace(folder).values())]})


def _gofmt(flag: str) -> Callable[[dict], list[str]]:
    return lambda i: ["gofmt", flag, i["package"]]


class Command(Exec):
    """A command of one's own: its outputs, what takes them away, a command that tells the state of what lies outside, and one that tells more outputs as JSON."""

    inputs = {"command": STRING, "inputs": TEXTS, "output": TEXTS, "dir": TEXT, "clean": TEXT, "resolve": TEXT, "outputs": TEXT}
    outputs = {"stdout": STRING, "path": TEXT, "paths": optional(list_of(STRING))}
    same = ("command", "dir", "clean")

    def resolve(self, ctx: Context, inputs: dict) -> dict[str, str]:
        return super().resolve(ctx, inputs | {"inputs": listed(inputs.get("inputs"))})

    def plan(self, ctx: Context, inputs: dict, prior: dict | None) -> str:
        if prior is None:
            return CREATE
        if any((prior.get("inputs") or {}).get(k) != inputs.get(k) for k in self.same):
            return UPDATE
        if inputs.get("resolve"):
            ok, said = tried(inputs["resolve"], inputs.get("dir"))
            return CREATE if not ok else UPDATE if said != prior.get("resolved") else NONE
        return NONE

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        made_at, folder = listed(inputs.get("output")), inputs.get("dir")
        prepare(made_at)
        said = run(inputs["command"], folder)
        state = {"resolved": run(inputs["resolve"], folder)} if inputs.get("resolve") else {}
        more = {}
        if inputs.get("outputs"):
            more = json.loads(run(inputs["outputs"], folder))
            if not isinstance(more, dict):
                raise ValueError("exec: outputs must print a JSON object")
        return Applied({"stdout": said} | paths_of(made_at) | more, state)

    def destroy(self, ctx: Context, prior: dict) -> None:
        before = prior.get("inputs") or {}
        if before.get("clean"):
            run(before["clean"], before.get("dir"))
        else:
            remove(listed(before.get("output")))


class CommandTest(Command):
    kind = "test"
    inputs = {k: v for k, v in Command.inputs.items() if k not in ("resolve", "outputs")}
    outputs = {"passed": BOOL}

    def apply(self, ctx: Context, inputs: dict, prior: dict | None) -> Applied:
        prepare(listed(inputs.get("output")))
        return tested(*tried(inputs["command"], inputs.get("dir")))


_GO = {"package": STRING, "flags": TEXTS, "goos": TEXT, "goarch": TEXT, "cgo": FLAG}
_RUST = {"package": TEXT, "flags": TEXTS, "features": TEXTS, "all_features": FLAG, "target": TEXT, "profile": TEXT, "toolchain": TEXT}
_RUST_FORMAT = {"package": TEXT, "flags": TEXTS, "toolchain": TEXT}
_SCRIPT = {"script": TEXT, "package": TEXT, "args": TEXTS, "inputs": TEXTS, "dir": TEXT}
_PASSED = {"passed": BOOL}
_LINT_FILES = (".golangci.yml", ".golangci.yaml", ".golangci.toml", ".golangci.json")
_FORMAT_FILES = ("rustfmt.toml", ".rustfmt.toml")


def _go_reads(tests: bool = False, more: Callable[[dict], list[str]] = lambda i: []) -> Callable:
    return lambda ctx, i: go_inputs(ctx, i["package"], tests) | files.list_hashes(more(i))


def _cargo_reads(more: tuple[str, ...] = ()) -> Callable:
    return lambda ctx, i: cargo_inputs(ctx) | files.list_hashes(list(more))


def tools() -> dict[tuple[str, str], Resource]:
    """All resources of this module by provider and name."""
    go, rust, fmt = list(_GO), list(_RUST), list(_RUST_FORMAT)
    go_test = lambda lines, ok: logs.verdict(logs.test_events(lines), ok)
    binary = lambda ctx, i, said: {"path": logs.last_binary(lines_of(ctx.spark, said)).first()["executable"]}
    in_dir = lambda i: i.get("dir")
    written = lambda state: remove(listed((state.get("inputs") or {}).get("output")))
    built = lambda state: remove([state["outputs"]["path"]])
    health = union_of(STRING, struct_of({"test": STRING, "interval": TEXT, "timeout": TEXT, "retries": optional(NUMBER), "start_period": TEXT}))
    return {
        ("exec", "exec"): Command(), ("exec", "test"): CommandTest(),
        ("docker", "image"): Tool("build", {"tag": STRING, "context": TEXT, "dockerfile": TEXT, "build_args": PAIRS, "platform": TEXTS}, {"ref": STRING, "image_id": STRING}, ["tag", "platform"], _image, image_inputs, _image_checks, _image_gone, undoes=_image_undone),
        ("docker", "container"): Tool("build", {"image": STRING, "name": STRING, "ports": TEXTS, "volumes": TEXTS, "environment": PAIRS, "command": TEXT, "entrypoint": TEXT, "restart": TEXT, "network": TEXT, "working_dir": TEXT, "healthcheck": optional(health), "extra_hosts": PAIRS}, {"container_id": STRING, "name": STRING}, [], _container,
            gone=lambda state: tried(["docker", "inspect", "--format", "{{.State.Running}}", state["outputs"]["name"]])[1].strip() != "true", undoes=lambda state: run(["docker", "rm", "-f", state["outputs"]["name"]]) and None),
        ("docker", "network"): Tool("build", {"name": STRING, "driver": TEXT}, {"name": STRING, "id": STRING}, ["name", "driver"], _network, gone=lambda state: not network_id(state["outputs"]["name"]), undoes=_network_undone),
        ("docker", "push"): Tool("build", {"image": STRING, "tag": STRING}, {"ref": STRING}, ["tag"], _push, drifted=lambda i, state: image_id(i["image"]) != state.get("image_id")),
        ("go", "exe"): Tool("build", _GO | {"output": TEXT}, {"path": STRING}, [*go, "output"], made(lambda i: ["go", "build", "-o", go_binary(i), *listed(i.get("flags")), i["package"]], lambda ctx, i, said: {"path": go_binary(i)}, go_env), _go_reads(more=lambda i: [go_binary(i)]), undoes=built),
        ("go", "build"): Tool("build", _GO, {}, go, made(lambda i: ["go", "build", *listed(i.get("flags")), i["package"]], env=go_env), _go_reads()),
        ("go", "test"): Tool("test", _GO | {"verbose": FLAG}, _PASSED, go, by_log(lambda i: ["go", "test", "-json", *listed(i.get("flags")), i["package"]], go_test, go_env), _go_reads(True)),
        ("go", "lint"): Tool("test", {"package": STRING, "flags": TEXTS}, _PASSED, ["package", "flags"], by_exit(lambda i: ["golangci-lint", "run", *listed(i.get("flags")), i["package"]]), _go_reads(more=lambda i: list(_LINT_FILES))),
        ("go", "fmt"): Tool("build", {"package": STRING}, {}, ["package"], made(_gofmt("-w")), _go_reads()),
        ("go", "fmt-l"): Tool("test", {"package": STRING}, _PASSED, ["package"], by_exit(_gofmt("-l"), silent=True), _go_reads()),
        ("pnpm", "install"): Tool("build", {"dir": TEXT, "frozen": FLAG}, {"path": STRING}, ["dir", "frozen"], _install, install_inputs, undoes=lambda state: remove([os.path.join(f, "node_modules") for f in state.get("folders", [])])),
        ("pnpm", "run"): Tool("build", _SCRIPT | {"script": STRING, "output": TEXTS}, {"path": TEXT, "paths": optional(list_of(STRING))}, ["script", "package", "args", "output", "dir"], made(script, lambda ctx, i, said: paths_of(listed(i.get("output"))), folder=in_dir), script_inputs, undoes=written),
        ("pnpm", "test"): Tool("test", _SCRIPT, _PASSED, ["script", "package", "args", "dir"], by_exit(lambda i: script(i, "test"), folder=in_dir), script_inputs),
        ("rust", "build"): Tool("build", _RUST, {}, rust, made(lambda i: cargo(i, "build")), _cargo_reads()),
        ("rust", "exe"): Tool("build", _RUST | {"bin": TEXT}, {"path": STRING}, [*rust, "bin"], made(lambda i: cargo(i, "build", "--message-format", "json"), binary), _cargo_reads(), undoes=built),
        ("rust", "test"): Tool("test", _RUST | {"verbose": FLAG}, _PASSED, rust, by_log(lambda i: cargo(i, "test"), logs.cargo_verdict), _cargo_reads()),
        ("rust", "clippy"): Tool("test", _RUST, _PASSED, rust, by_exit(lambda i: cargo(i, "clippy")), _cargo_reads()),
        ("rust", "fmt"): Tool("build", _RUST_FORMAT, {}, fmt, made(lambda i: cargo(i, "fmt")), _cargo_reads(_FORMAT_FILES)),
        ("rust", "fmt-check"): Tool("test", _RUST_FORMAT, _PASSED, fmt, by_exit(lambda i: cargo(i, "fmt", "--check")), _cargo_reads(_FORMAT_FILES)),
    }


def add_tools(registry: Registry) -> Registry:
    for (provider, name), resource in tools().items():
        registry.add(provider, name, resource)
    return registry
