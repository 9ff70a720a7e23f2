import hashlib
import json

import pytest

from blockloom.sources import code, dockerfile, files, imports


def paths_of(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def names(df):
    return sorted(r[0] for r in df.select("path").collect())


def test_hashes(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for p in ("x.py", "a/y.py", "a/b/z.py", "a/b/z.md"):
        (tmp_path / p).write_text(p)
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in files.tree_hashes(spark, str(tmp_path), "a/**/*.py").collect()}
    assert got == {n: hashlib.sha256(p.encode()).hexdigest() for n, p in (("y.py", "a/y.py"), ("z.py", "a/b/z.py"))}
    assert len(files.glob_hashes(f"{tmp_path}/**/*.py")) == 3 and files.glob_hashes(f"{tmp_path}/[") == {}
    assert list(files.list_hashes([f"{tmp_path}/x.py", f"{tmp_path}/gone"])) == [f"{tmp_path}/x.py"]
    with pytest.raises(ValueError):
        files.driver_glob("[")
    assert files.tree(spark, str(tmp_path)).count() == 4


def test_ignore_rules(spark):
    p = paths_of(spark, "debug.log", "important.log", "sub/x.log", "src/build/out.js", "src/a.js")
    rules = lambda text: spark.createDataFrame(files.ignore_rules(text), "seq int, pattern string, negate boolean")
    hit = lambda text: sorted(r.path for r in files.ignored(p, rules(text)).where("ignored").collect())
    assert hit("# c\n\n*.log\n!important.log\n") == hit("!important.log\n*.log\n") == ["debug.log", "sub/x.log"]
    assert hit("src/build\n") == ["src/build/out.js"]
    assert names(files.expanded(p, "src", rules("src/build"))) == ["src/a.js"] and names(files.expanded(p, "*.log")) == ["debug.log", "important.log"]


DOCKER = """# syntax
ARG V=1.0
ARG NAME
ENV DIR=/app MODE="x y"
COPY --chown=a go.mod ${NAME}-$V.txt ./
COPY --from=build /out /out
ADD https://example.com/x /x
COPY ["src dir", "/d"]
COPY src \\
  lib /app/
"""


def test_dockerfile(spark):
    assert dockerfile.sources(DOCKER, {"NAME": "n", "V": "2.0"}) == ["go.mod", "n-2.0.txt", "src dir", "src", "lib"]
    with pytest.raises(dockerfile.UnresolvedError):
        dockerfile.sources(DOCKER)
    assert dockerfile.variables(DOCKER, {})["MODE"] == "x y"
    assert dockerfile.expand("${A:-d}${B:+w}$B", {"B": "b"}) == "dwb"
    assert dockerfile.platform_variables("x86_64", "Linux")["TARGETPLATFORM"] == "linux/amd64"
    assert dockerfile.platform_variables("arm64", "Darwin")["BUILDPLATFORM"] == "linux/arm64"
    assert {k: v for k, v in dockerfile.platform_variables("armv7l", "Linux").items() if k.startswith("TARGET")} == {"TARGETPLATFORM": "linux/arm/v7", "TARGETOS": "linux", "TARGETARCH": "arm", "TARGETVARIANT": "v7"}
    assert [dockerfile.platform_variables(m, "Linux")["TARGETARCH"] for m in ("s390x", "ppc64le", "riscv64")] == ["s390x", "ppc64le", "riscv64"]
    p = paths_of(spark, "go.mod", "src/a", "src/b.log", "lib/x", "other", "n-1.0.txt")
    rules = spark.createDataFrame([(0, "*.log", False)], "seq int, pattern string, negate boolean")
    assert names(dockerfile.image_sources(p, DOCKER, {"NAME": "n"}, rules)) == ["go.mod", "lib/x", "n-1.0.txt", "src/a"]


def test_containers():
    assert dockerfile.health_deadline() == 8_000_000_000 and dockerfile.health_deadline(1, 2, 3, 4) == 9
    assert dockerfile.extra_hosts({"b": "1"}, linux=True) == [("b", "1"), ("host.docker.internal", "host-gateway")]
    assert dockerfile.extra_hosts({}, linux=False) == []


def test_go(spark):
    src = spark.createDataFrame(
        [("main.go", 'package main\nimport "ex.com/m/a"\n// import "ex.com/m/none"\n'), ("main_test.go", 'import "ex.com/m/t"'), ("a/a.go", 'import (\n x "ex.com/m/b"\n "fmt"\n)\n//go:embed all:static "t.txt"\n'), ("a/a_test.go", 'import "ex.com/m/t"'), ("b/b.go", "package b"), ("t/t.go", "package t"), ("c/c.go", "package c"), ("vendor/v/v.go", "")],
        "path string, text string",
    )
    assert names(code.go_closure(src, "ex.com/m", ".")) == ["a/a.go", "b/b.go", "main.go"]
    assert names(code.go_closure(src, "ex.com/m", ".", tests=True)) == ["a/a.go", "b/b.go", "main.go", "main_test.go", "t/t.go"]
    assert sorted(r.pattern for r in code.go_embeds(src).collect()) == ["static", "t.txt"]
    folders = lambda p: sorted(r.folder for r in code.go_packages(src, p, "ex.com/m").collect())
    assert folders("./...") == ["", "a", "b", "c", "t"] and folders("./a") == ["a"] and folders("ex.com/m/b") == ["b"] and folders("./a/...") == ["a"]
    assert code.module_path("module ex.com/m\n\ngo 1.2\n") == "ex.com/m"
    df = spark.createDataFrame([("fmt",), ("ex.com/m",)], "p string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(code.is_standard(F.col("p"))).collect()] == [True, False]


def test_cargo_and_workspace(spark):
    meta = json.dumps({"workspace_members": ["x"], "packages": [{"id": "x", "name": "x", "manifest_path": "w/x/Cargo.toml", "targets": [{"name": "x", "kind": ["bin"]}]}, {"id": "dep", "name": "dep", "manifest_path": "d/Cargo.toml", "targets": []}]})
    p = code.cargo_packages(spark, meta)
    assert names(code.cargo_sources(paths_of(spark, "w/x/src/m.rs", "w/x/Cargo.toml", "w/x/a.txt", "d/l.rs"), p)) == ["w/x/Cargo.toml", "w/x/src/m.rs"]
    yaml = "packages:\n  - 'packages/*'\n  - apps/web\n  - '!packages/old'\n"
    manifests = {"packages/a": '{"name": "a"}', "packages/old": '{"name": "old"}', "apps/web": '{"name": "web"}', "packages/a/deep": '{"name": "deep"}'}
    assert code.workspace_packages(yaml, manifests) == {"web": "apps/web", "a": "packages/a"}
    files_ = paths_of(spark, "pnpm-lock.yaml", "package.json", "packages/a/src/x.ts", "packages/a/node_modules/y.js", "packages/a/dist/z.js", "packages/a/x.log", "packages/a/vendor/v.ts", "packages/a/.svelte-kit/k", "packages/a/t.tsbuildinfo", "packages/a/.DS_Store", "other/q.ts")
    assert names(code.run_sources(files_, "packages/a")) == ["packages/a/src/x.ts", "packages/a/vendor/v.ts", "packages/a/x.log", "pnpm-lock.yaml"]
    assert names(code.run_sources(files_, None, ("other/*.ts",), install=True)) == ["other/q.ts", "package.json", "pnpm-lock.yaml"]
    assert names(code.with_config(paths_of(spark, "rustfmt.toml", "a.rs"), paths_of(spark, "a.rs"))) == ["a.rs", "rustfmt.toml"]


def test_imports(tmp_path):
    a = imports.parse_url("github.com/o/r/sub/dir#v1")
    assert (a.owner, a.repository, a.folder, a.ref) == ("o", "r", "sub/dir", "v1")
    for bad in ("github.com/o", "example.com/a/b"):
        with pytest.raises(ValueError):
            imports.parse_url(bad)
    assert imports.is_local("./x") and not imports.is_local("github.com/a/b")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.loom").write_text("")
    assert list(imports.module_folders("./m", str(tmp_path))) == ["x"]
    with pytest.raises(ValueError):
        imports.module_folders("./gone", str(tmp_path))


def test_packages_of_a_tree(spark):
    tree = paths_of(spark, "_c/f.go", "a/f.go", "a/vendor/v.go", ".e/f.go", "a/testdata/t.go", "b/readme")
    assert sorted(r.folder for r in code.go_packages(tree, "./...").collect()) == ["_c", "a"]
    assert code.go_packages(tree, "./b").count() == 0
    with pytest.raises(ValueError, match="not found"):
        code.go_packages(tree, "./none")


def test_folder_hashes_follow_names_lengths_and_times(spark, tmp_path):
    for name, text in (("a/x", "1"), ("a/y", "2"), ("b/z", "3")):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    look = lambda: {r.path.rsplit("/", 1)[-1]: r.hash for r in files.folder_hashes(spark, str(tmp_path)).collect()}
    before = look()
    assert set(before) == {"a", "b"} and look() == before
    (tmp_path / "a/x").write_text("11")
    assert look()["a"] != before["a"] and look()["b"] == before["b"]


def test_digests_of_files_of_any_size(spark, tmp_path):
    """Equal to the driver's hashes, by patterns, and a file of over 2 GB without it being in memory."""
    import hashlib
    import resource

    from blockloom.sources import digests

    for name, text in {"a.go": "x", "in/b.go": "y", "in/deep/c.go": "", "in/d.txt": "z", ".git/e.go": "no", "in/_f.go": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    hashes = lambda *p, **k: {r.path: r.hash for r in digests.file_digests(spark, *p, **k).collect()}
    want = lambda *names: files.list_hashes([str(tmp_path / n) for n in names])
    assert hashes(str(tmp_path), "**/*.go") == want("a.go", "in/b.go", "in/deep/c.go")
    assert hashes(f"file://{tmp_path}", "in/*") == want("in/b.go", "in/d.txt")
    assert hashes(str(tmp_path), "**/*.go", hidden=True) == want("a.go", "in/b.go", "in/deep/c.go", ".git/e.go", "in/_f.go")
    assert hashes(str(tmp_path / "none")) == {}
    size = (2 << 30) + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    reader = digests.DigestReader({"path": str(tmp_path), "pattern": "*.bin"})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    [(path, length, found)] = [row for p in reader.partitions() for row in reader.read(p)]
    assert length == size and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    with open(path, "rb") as f:
        assert found == hashlib.file_digest(f, "sha256").hexdigest()
