"""What source files import, and which files a package, crate or workspace is made of."""

from __future__ import annotations

import fnmatch
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.graph import closure

# Folders, endings and file names that source walks pass by.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", ".turbo", ".vite", ".svelte-kit", "coverage", ".cache")
SKIPPED_ENDINGS = (".tsbuildinfo",)
SKIPPED_NAMES = (".DS_Store",)
SKIPPED_GO = r"(^|/)(\.[^/]+|vendor|testdata)/"


def module_path(go_mod: str) -> str | None:
    m = re.search(r"^\s*module\s+(\S+)", go_mod, re.M)
    return m[1].strip('"') if m else None


def module_root(folder: str) -> str | None:
    """The nearest folder at or above with a go.mod."""
    folder = os.path.abspath(folder)
    while not os.path.isfile(os.path.join(folder, "go.mod")):
        up = os.path.dirname(folder)
        if up == folder:
            return None
        folder = up
    return folder


def is_standard(path: Column) -> Column:
    """Whether an import is of the standard library: no dot in its first part."""
    return ~F.contains(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("."))


def go_imports(sources: DataFrame) -> DataFrame:
    """path, import of sources(path, text): single, grouped, aliased; comments do not count."""
    code = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:\"])//[^\n]*", "$1")
    grouped = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"(?ms)^\s*import\s*\(([^)]*)\)"), 1), lambda g: F.regexp_extract_all(g, F.lit(r'"([^"]+)"'), 1)))
    single = F.regexp_extract_all(code, F.lit(r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), 1)
    return sources.select("path", F.explode(F.array_distinct(F.concat(grouped, single))).alias("import"))


def go_embeds(sources: DataFrame) -> DataFrame:
    """path, pattern of the embed directives of sources(path, text)."""
    rows = F.regexp_extract_all("text", F.lit(r"(?m)^\s*//go:embed\s+(.+)$"), 1)
    each = F.filter(F.flatten(F.transform(rows, lambda r: F.split(F.trim(r), r"\s+"))), lambda p: p != "")
    return sources.select("path", F.explode(F.transform(each, lambda p: F.regexp_replace(F.regexp_replace(p, '^"|"$', ""), "^all:", ""))).alias("pattern"))


def go_packages(paths: DataFrame, package: str, module: str = "") -> DataFrame:
    """folder: the packages of paths(path), relative to the module's root, that ./..., ./x, or an import path means; an unknown folder is an error."""
    go = paths.where(F.endswith("path", F.lit(".go")) & ~F.col("path").rlike(SKIPPED_GO))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    folders = go.select(folder.alias("folder")).distinct()
    name = package.removeprefix(module).strip("/") if module and package.startswith(module) else package.removeprefix("./").strip("/")
    if name == "..." or name.endswith("/..."):
        base = name.removesuffix("...").strip("/")
        return folders if not base else folders.where((F.col("folder") == base) | F.startswith("folder", F.lit(f"{base}/")))
    name = "" if name == "." else name
    if name and paths.where(F.startswith("path", F.lit(f"{name}/"))).isEmpty():
        raise ValueError(f"package directory not found: {name}")
    return folders.where(F.col("folder") == name)


def go_closure(sources: DataFrame, module: str, package: str, tests: bool = False) -> DataFrame:
    """path: the files of sources(path, text) that a package needs in its module; test files only of the package itself."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    is_test = F.endswith("path", F.lit("_test.go"))
    named = sources.where(F.endswith("path", F.lit(".go"))).withColumn("folder", folder)
    root = go_packages(sources.select("path"), package, module)
    kept = named.where(~is_test) if not tests else named.where(~is_test).unionByName(named.where(is_test).join(root, "folder", "left_semi"))
    inside = go_imports(kept).where((F.col("import") == module) | F.startswith("import", F.lit(f"{module}/")))
    edges = inside.join(kept.select("path", "folder"), "path").select(F.regexp_replace(F.col("import"), rf"^{re.escape(module)}/?", "").alias("src"), F.col("folder").alias("dst")).distinct()
    needed = closure(edges, root.select(F.col("folder").alias("name"))).select(F.col("name").alias("folder")).distinct()
    return kept.join(needed, "folder", "left_semi").select("path")


def cargo_packages(spark: SparkSession, metadata: str) -> DataFrame:
    """name, folder, manifest, target, kind of the workspace's packages in `cargo metadata` output."""
    found = json.loads(metadata)
    members = set(found.get("workspace_members") or [p["id"] for p in found["packages"]])
    rows = [(p["name"], os.path.dirname(p["manifest_path"]), p["manifest_path"], t["name"], k) for p in found["packages"] if p["id"] in members for t in p.get("targets", []) for k in t.get("kind", [])]
    return spark.createDataFrame(rows, "name string, folder string, manifest string, target string, kind string")


_METADATA = "packages ARRAY<STRUCT<name: STRING, manifest_path: STRING, targets: ARRAY<STRUCT<name: STRING, src_path: STRING>>>>"


def cargo_folders(metadata: DataFrame) -> DataFrame:
    """name, folder, target: each package's own folder, and the folders of its targets' files with the files, of `cargo metadata` output in metadata(metadata).

    So integration tests, benches, examples and targets anywhere are sources, not only what lies in src.
    """
    package = metadata.select(F.inline(F.from_json("metadata", _METADATA)["packages"]))
    up = lambda path: F.regexp_replace(path, "/?[^/]*$", "")
    own = package.select("name", up(F.col("manifest_path")).alias("folder"), F.lit(None).cast("string").alias("target"))
    inner = package.select(F.col("name").alias("package"), F.inline("targets")).where("src_path IS NOT NULL")
    return own.unionByName(inner.select(F.col("package").alias("name"), up(F.col("src_path")).alias("folder"), F.col("src_path").alias("target"))).distinct()


def cargo_sources(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """path, name: Rust files and manifests of paths(path) in each package's folder, at any depth: joined by each folder around a file."""
    kept = paths.where(F.col("path").rlike(r"(\.rs|(^|/)Cargo\.(toml|lock))$"))
    parts = F.split("path", "/")
    around = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n - 1), "/")))
    return kept.select("path", around.alias("folder")).join(packages.select("name", "folder").distinct(), "folder").select("path", "name")


def workspace_packages(yaml: str, manifests: dict[str, str]) -> dict[str, str]:
    """name: folder of a workspace's packages. yaml lists folder patterns, ! takes away; manifests has each folder's package.json."""
    listed = re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", yaml.partition("packages:")[2], re.M)
    keep, drop = [p for p in listed if not p.startswith("!")], [p[1:] for p in listed if p.startswith("!")]
    hit = lambda folder, patterns: any(fnmatch.fnmatchcase(folder, p.rstrip("/")) and (folder.count("/") == p.rstrip("/").count("/") or "**" in p) for p in patterns)
    return {json.loads(text)["name"]: folder for folder, text in sorted(manifests.items()) if hit(folder, keep) and not hit(folder, drop)}


def source_walk(paths: DataFrame, root: str = "", excluded: tuple[str, ...] = ()) -> DataFrame:
    """The files of paths(path) below root, without skipped folders, endings and names, and without excluded paths."""
    skipped = rf"(^|/)({'|'.join(map(re.escape, SKIPPED_FOLDERS))})/"
    out = paths.where(~F.col("path").rlike(skipped))
    for ending in SKIPPED_ENDINGS:
        out = out.where(~F.endswith("path", F.lit(ending)))
    out = out.where(~F.regexp_extract("path", "([^/]*)$", 1).isin(*SKIPPED_NAMES))
    for e in excluded:
        out = out.where((F.col("path") != e) & ~F.startswith("path", F.lit(f"{e}/")))
    return out.where(F.startswith("path", F.lit(f"{root}/"))) if root else out


def run_sources(paths: DataFrame, package: str | None, globs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), install: bool = False) -> DataFrame:
    """path: what a workspace script depends on: the lock file, a package's tree or the root manifest, patterns and outputs."""
    from blockloom.sources.files import pattern_regex

    hit = F.col("path").isin("pnpm-lock.yaml", *outputs)
    if install:
        hit = hit | F.col("path").rlike(r"(^|/)package\.json$") | F.col("path").isin("pnpm-workspace.yaml", "node_modules/.modules.yaml")
    if not package:
        hit = hit | (F.col("path") == "package.json")
    for g in globs:
        hit = hit | F.col("path").rlike(pattern_regex(g))
    out = paths.where(hit)
    return out.unionByName(source_walk(paths, package, outputs)).distinct() if package else out


def with_config(paths: DataFrame, found: DataFrame, names: tuple[str, ...] = ("rustfmt.toml", ".rustfmt.toml")) -> DataFrame:
    """found and the optional configuration files."""
    return found.select("path").unionByName(paths.where(F.col("path").isin(*names)).select("path")).distinct()
