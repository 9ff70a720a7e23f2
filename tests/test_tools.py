"""Resources of outside programs: what they read, when they are stale, what they run and what the logs say. No program is run."""

import json
import os

import pytest

from blockloom.functions import library
from blockloom.plans.engine import ApplyError, Engine
from blockloom.plans.loader import load
from blockloom.plans.providers import CREATE, NONE, UPDATE, Context, default_registry
from blockloom.plans.state import MemoryStore
from blockloom.plans.tools import container_run, tools


class Runner:
    """Notes commands and answers them by their first match."""

    def __init__(self, answers=None):
        self.said, self.answers = [], answers or {}

    def __call__(self, command):
        self.said.append(command)
        for part, answer in self.answers.items():
            if part in command:
                if isinstance(answer, Exception):
                    raise answer
                return answer
        return ""


@pytest.fixture
def runner(monkeypatch):
    r = Runner()
    monkeypatch.setattr(library, "run_command", r)
    return r


@pytest.fixture
def ctx(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    return Context(spark, "b", str(tmp_path / "out"))


def put(**files):
    for name, text in files.items():
        path = name.replace("__", "/").replace("_DOT_", ".")
        if os.path.dirname(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def ended(output):
    e = RuntimeError("exit status 1")
    e.output = output
    return e


def again(tool, ctx, inputs, done):
    """The action with the state of what was done."""
    return tool.plan(ctx, inputs, {"inputs": inputs, "outputs": done.outputs} | done.state)


def test_all_are_registered(spark):
    r = default_registry()
    assert all(r.has(*k) for k in tools()) and len(tools()) == 21
    rows = r.catalog(spark, "docker.").where("side = 'input' AND required").collect()
    assert {(x.resource, x.field) for x in rows} == {("image", "tag"), ("container", "image"), ("container", "name"), ("network", "name"), ("push", "image"), ("push", "tag")}
    assert {k for k, x in tools().items() if x.kind == "test"} == {("exec", "test"), ("go", "test"), ("go", "lint"), ("go", "fmt-l"), ("pnpm", "test"), ("rust", "test"), ("rust", "clippy"), ("rust", "fmt-check")}


def test_commands_are_off(ctx):
    with pytest.raises(library.FunctionError, match="switched off"):
        tools()["go", "build"].apply(ctx, {"package": "."}, None)


GO = {"go_DOT_mod": "module ex.com/m\n", "cmd__app__main_DOT_go": 'package main\nimport (\n  "fmt"\n  "ex.com/m/lib"\n)\n', "cmd__app__main_test_DOT_go": "package main\n", "lib__lib_DOT_go": "package lib\n//go:embed t/*.txt\nvar x string\n", "lib__t__a_DOT_txt": "a", "lib__lib_test_DOT_go": "package lib\n", "other__o_DOT_go": "package o\n"}


def test_go(ctx, runner):
    put(**GO)
    t = tools()
    source = {"cmd/app/main.go", "lib/lib.go", "lib/t/a.txt"}
    assert set(t["go", "build"].resolve(ctx, {"package": "./cmd/app"})) == source
    assert set(t["go", "test"].resolve(ctx, {"package": "./cmd/app"})) == source | {"cmd/app/main_test.go"}
    put(**{"_DOT_golangci_DOT_yml": "x"})
    assert set(t["go", "lint"].resolve(ctx, {"package": "./cmd/app"})) == source | {".golangci.yml"}
    with pytest.raises(ValueError, match="not found"):
        t["go", "build"].resolve(ctx, {"package": "./none"})
    i = {"package": "./cmd/app", "goos": "linux", "cgo": False, "flags": ["-v"]}
    done = t["go", "exe"].apply(ctx, i, None)
    assert runner.said[-1] == "GOOS=linux CGO_ENABLED=0 go build -o app -v ./cmd/app" and done.outputs == {"path": "app"}
    put(app="binary")
    assert "app" in t["go", "exe"].resolve(ctx, i)
    assert again(t["go", "exe"], ctx, i, done) == NONE and t["go", "exe"].plan(ctx, i | {"goos": "darwin"}, {"inputs": i}) == UPDATE and t["go", "exe"].plan(ctx, i, None) == CREATE
    t["go", "exe"].destroy(ctx, {"outputs": done.outputs})
    assert not os.path.exists("app")


def test_go_test_and_format(ctx, runner):
    event = lambda **x: json.dumps({"Package": "p"} | x)
    t, i = tools(), {"package": "./..."}
    for answer, passed in (
        ("\n".join([event(Action="pass", Test="T"), event(Action="pass")]), True), ("\n".join([event(Action="skip", Test="T"), event(Action="skip")]), True), (ended("\n".join([event(Action="fail", Test="T"), event(Action="fail")])), False),
        (ended(event(Action="pass")), True), ("no events", True), (ended("does not compile"), False),
    ):
        runner.answers = {"go test": answer}
        done = t["go", "test"].apply(ctx, i, None)
        assert done.passed is passed and done.outputs == {"passed": passed}
    assert runner.said[-1] == "go test -json ./..."
    runner.answers = {"gofmt -l": "x.go\n"}
    assert not t["go", "fmt-l"].apply(ctx, i, None).passed and t["go", "fmt"].apply(ctx, i, None).outputs == {}
    runner.answers = {}
    assert t["go", "fmt-l"].apply(ctx, i, None).passed


def test_rust(ctx, runner):
    put(Cargo_DOT_toml="[workspace]", Cargo_DOT_lock="l", a__Cargo_DOT_toml="a", a__src__lib_DOT_rs="x", b__src__lib_DOT_rs="y", rustfmt_DOT_toml="f")
    meta = {"workspace_members": ["a"], "packages": [{"id": "a", "name": "a", "manifest_path": f"{os.getcwd()}/a/Cargo.toml", "targets": [{"name": "a", "kind": ["lib"]}]}]}
    runner.answers = {"cargo metadata": json.dumps(meta)}
    t = tools()
    assert set(t["rust", "build"].resolve(ctx, {})) == {"Cargo.toml", "Cargo.lock", "a/Cargo.toml", "a/src/lib.rs"}
    assert "rustfmt.toml" in t["rust", "fmt"].resolve(ctx, {})
    i = {"package": "a", "features": ["x", "y"], "target": "wasm", "toolchain": "nightly"}
    t["rust", "clippy"].apply(ctx, i, None)
    assert runner.said[-1] == "cargo+nightly clippy --target wasm -p a --features x,y"
    t["rust", "fmt-check"].apply(ctx, {"package": "a"}, None)
    assert runner.said[-1] == "cargo fmt -p a --check"
    log = "running 1 test\ntest a::t ... FAILED\ntest result: FAILED. 0 passed; 1 failed; 0 ignored; finished in 0.1s"
    for answer, passed in ((log.replace("FAILED", "ok"), True), (ended(log), False), (ended("error: could not compile"), False), ("", True)):
        runner.answers = {"cargo test": answer}
        assert t["rust", "test"].apply(ctx, {"all_features": True}, None).passed is passed
    assert runner.said[-1] == "cargo test --all-features"
    artifact = lambda kind, path: json.dumps({"reason": "compiler-artifact", "executable": path, "target": {"kind": [kind], "name": "a"}})
    runner.answers = {"--message-format json": "\n".join([artifact("bin", "/t/one"), "noise", artifact("bin", "/t/two"), artifact("lib", None)])}
    assert t["rust", "exe"].apply(ctx, {"bin": "a"}, None).outputs == {"path": "/t/two"}


def test_sources_of_all_targets(ctx, runner):
    put(Cargo_DOT_toml="[package]", Cargo_DOT_lock="l", build_DOT_rs="b", src__lib_DOT_rs="s", tests__a_DOT_rs="t", tests__common__mod_DOT_rs="m", examples__e_DOT_rs="e", target__debug__made_DOT_rs="no", other__main_DOT_rs="o")
    at = lambda *paths: [{"name": "x", "kind": ["test"], "src_path": f"{os.getcwd()}/{p}"} for p in paths]
    runner.answers = {"cargo metadata": json.dumps({"packages": [{"id": "a", "name": "a", "manifest_path": f"{os.getcwd()}/Cargo.toml", "targets": at("src/lib.rs", "tests/a.rs", "examples/e.rs", "other/main.rs", "build.rs")}]})}
    assert set(tools()["rust", "test"].resolve(ctx, {})) == {"Cargo.toml", "Cargo.lock", "build.rs", "src/lib.rs", "tests/a.rs", "tests/common/mod.rs", "examples/e.rs", "other/main.rs"}


def test_an_image_copies_what_nothing_ignores(ctx, runner):
    put(Dockerfile="FROM x\nCOPY . /app\n", main_DOT_js="m", node_modules__a__i_DOT_js="i", _DOT_git__HEAD="h", tmp__x="x", _DOT_dockerignore="tmp\n")
    assert set(tools()["docker", "image"].resolve(ctx, {"tag": "t"})) == {"Dockerfile", "main.js", "node_modules/a/i.js", ".git/HEAD", ".dockerignore"}


def test_workspace(ctx, runner):
    put(**{"package_DOT_json": '{"name": "root"}', "pnpm-lock_DOT_yaml": "l", "pnpm-workspace_DOT_yaml": "packages:\n  - 'apps/*'\n", "apps__web__package_DOT_json": '{"name": "web"}', "apps__web__src__x_DOT_ts": "x", "apps__web__dist__x_DOT_js": "o", "apps__web__vendor__v_DOT_ts": "v", "apps__api__package_DOT_json": '{"name": "api"}', "shared__s_DOT_css": "s"})
    t = tools()
    assert set(t["pnpm", "run"].resolve(ctx, {"script": "build", "package": "web", "inputs": "shared/*.css"})) == {"pnpm-lock.yaml", "apps/web/package.json", "apps/web/src/x.ts", "apps/web/vendor/v.ts", "shared/s.css"}
    assert set(t["pnpm", "test"].resolve(ctx, {})) == {"pnpm-lock.yaml", "package.json"}
    assert set(t["pnpm", "install"].resolve(ctx, {})) == {"package.json", "pnpm-lock.yaml", "pnpm-workspace.yaml", "apps/web/package.json", "apps/api/package.json"}
    with pytest.raises(ValueError, match="no package"):
        t["pnpm", "run"].resolve(ctx, {"script": "build", "package": "none"})
    i = {"script": "build", "package": "web", "args": ["--fast"], "output": ["apps/web/out/", "apps/web/made/a.js"]}
    done = t["pnpm", "run"].apply(ctx, i, None)
    assert runner.said[-1] == "pnpm --filter web run build -- --fast" and done.outputs == {"paths": i["output"]} and os.path.isdir("apps/web/out") and os.path.isdir("apps/web/made")
    t["pnpm", "run"].destroy(ctx, {"inputs": i})
    assert not os.path.exists("apps/web/out")
    os.makedirs("apps/web/node_modules")
    done = t["pnpm", "install"].apply(ctx, {"frozen": True}, None)
    assert runner.said[-1] == "pnpm install --frozen-lockfile" and done.outputs == {"path": "./node_modules"}
    t["pnpm", "install"].destroy(ctx, done.state)
    assert not os.path.exists("apps/web/node_modules")
    runner.answers = {"run unit": ended("bad")}
    assert not t["pnpm", "test"].apply(ctx, {"script": "unit"}, None).passed


def test_image(ctx, runner):
    put(Dockerfile="FROM x\nARG D=dist\nCOPY ${D}/a b /\nCOPY --from=x /y /z\n", dist__a="a", b__one="1", b__two_DOT_log="2", c="c", _DOT_dockerignore="*.log\n")
    t, i = tools()["docker", "image"], {"tag": "r.io/app:latest", "platform": "linux/amd64", "build_args": {"B": "2", "A": "1"}}
    assert set(t.resolve(ctx, i)) == {"Dockerfile", "dist/a", "b/one"}
    runner.answers = {"inspect --format": "sha256:77\n"}
    done = t.apply(ctx, i, None)
    assert done.outputs == {"ref": "r.io/app:77", "image_id": "77"} and "docker tag r.io/app:latest r.io/app:77" in runner.said
    assert runner.said[0] == "docker buildx build -t r.io/app:latest -f Dockerfile --platform linux/amd64 --load --build-arg A=1 --build-arg B=2 ."
    assert again(t, ctx, i, done) == NONE and t.plan(ctx, i | {"tag": "x"}, {"inputs": i}) == UPDATE
    runner.answers = {"image inspect": ended("")}
    assert again(t, ctx, i, done) == CREATE  # somebody has deleted it
    with pytest.raises(ValueError, match="registry"):
        t.plan(ctx, {"tag": "app", "platform": ["a", "b"]}, None)


def test_container_network_and_push(ctx, runner):
    t = tools()
    i = {"name": "c", "image": "im", "ports": ["80:80"], "environment": {"B": "2", "A": "1"}, "command": "run it", "healthcheck": {"test": "true", "retries": 5}}
    assert " ".join(container_run(i)) == "docker run -d --name c -p 80:80 -e A=1 -e B=2 --restart no --add-host host.docker.internal:host-gateway --health-cmd true --health-interval 1s --health-timeout 5s --health-retries 5 im run it"
    assert "--add-host" not in container_run(i, linux=False)
    runner.answers = {"docker run": "id7\n", "inspect": "true\n"}
    done = t["docker", "container"].apply(ctx, i, None)
    assert done.outputs == {"container_id": "id7", "name": "c"} and again(t["docker", "container"], ctx, i, done) == NONE
    runner.answers = {"inspect": "false\n"}
    assert again(t["docker", "container"], ctx, i, done) == CREATE
    net = {"name": "n", "driver": "bridge"}
    runner.answers = {"network inspect": "old\n"}
    adopted = t["docker", "network"].apply(ctx, net, None)
    assert adopted.outputs == {"name": "n", "id": "old"} and again(t["docker", "network"], ctx, net, adopted) == NONE
    runner.answers = {"network inspect": "old\n", "network create": "new\n"}
    assert t["docker", "network"].apply(ctx, net, {"inputs": {"name": "n", "driver": "overlay"}}).outputs["id"] == "new" and "docker network rm n" in runner.said
    runner.answers = {"network inspect": ended("")}
    assert again(t["docker", "network"], ctx, net, adopted) == CREATE
    push = {"image": "app:7", "tag": "r.io/app"}
    runner.answers = {"inspect --format": "sha256:7"}
    done = t["docker", "push"].apply(ctx, push, None)
    assert done.outputs == {"ref": "r.io/app"} and again(t["docker", "push"], ctx, push, done) == NONE
    runner.answers = {"inspect --format": "sha256:8"}
    assert again(t["docker", "push"], ctx, push, done) == UPDATE


def test_commands(ctx, runner):
    t = tools()["exec", "exec"]
    i = {"command": "make", "dir": "sub dir", "output": "built/x", "resolve": "ask", "outputs": "tell", "clean": "make clean"}
    runner.answers = {"ask": "state 1", "tell": '{"port": 80, "output": ["a"]}', "make": "said"}
    done = t.apply(ctx, i, None)
    assert runner.said[0] == "cd 'sub dir' && make" and done.outputs == {"stdout": "said", "path": "built/x", "port": 80, "output": ["a"]} and os.path.isdir("built")
    assert again(t, ctx, i, done) == NONE and t.plan(ctx, i | {"dir": "other"}, {"inputs": i} | done.state) == UPDATE
    runner.answers["ask"] = "state 2"
    assert again(t, ctx, i, done) == UPDATE  # it drifted
    runner.answers["ask"] = ended("")
    assert again(t, ctx, i, done) == CREATE  # it is not there
    t.destroy(ctx, {"inputs": i})
    assert runner.said[-1] == "cd 'sub dir' && make clean"
    put(built__x="x")
    t.destroy(ctx, {"inputs": {"command": "make", "output": "built/x"}})
    assert not os.path.exists("built/x")
    runner.answers = {"tell": "[1]"}
    with pytest.raises(ValueError, match="JSON object"):
        t.apply(ctx, {"command": "x", "outputs": "tell"}, None)
    runner.answers = {"false": ended("no")}
    test = tools()["exec", "test"]
    assert not test.apply(ctx, {"command": "false"}, None).passed and test.apply(ctx, {"command": "true"}, None).passed


def test_in_a_pipeline(spark, ctx, runner):
    put(a="1")
    text = 'made = exec.exec { command = "make", inputs = ["a"], outputs = "tell" }\ncheck = exec.test { command = "look ${made.port}" }\n'
    runner.answers = {"tell": '{"port": "80"}'}
    registry = default_registry()
    engine = Engine(spark, load(spark, text, registry), registry, MemoryStore(), ctx.folder)
    assert [s.action for s in engine.apply()] == ["create", "create"] and "look 80" in runner.said
    assert [s.action for s in engine.apply()] == ["none", "none"]
    put(a="2")
    assert [s.action for s in engine.apply()][0] == "update"
    runner.answers["look"] = ended("no")
    put(a="3")
    with pytest.raises(ApplyError):
        engine.apply()
