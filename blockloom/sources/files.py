"""Files as sources: found by patterns and hashed by their contents."""

from __future__ import annotations

import fnmatch
import glob as globs
import hashlib
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class HashCache:
    """SHA-256 of driver-side files, each read once until cleared."""

    def __init__(self) -> None:
        self._known: dict[str, str] = {}

    def of(self, path: str) -> str:
        if path not in self._known:
            with open(path, "rb") as f:
                self._known[path] = hashlib.file_digest(f, "sha256").hexdigest()
        return self._known[path]

    def clear(self) -> None:
        self._known.clear()


def driver_glob(pattern: str) -> list[str]:
    """Files and folders that match, in order; an unbalanced bracket is an error."""
    if pattern.count("[") != pattern.count("]"):
        raise ValueError(f"bad pattern: {pattern}")
    return sorted(globs.glob(pattern, recursive=True, include_hidden=True))


def glob_hashes(pattern: str, cache: HashCache | None = None) -> dict[str, str]:
    """path: hash of the files that match, in order; a bad pattern matches none."""
    cache = cache or HashCache()
    return {p: cache.of(p) for p in sorted(globs.glob(pattern, recursive=True, include_hidden=True)) if os.path.isfile(p)}


def list_hashes(paths: list[str], cache: HashCache | None = None) -> dict[str, str]:
    """path: hash of those that exist."""
    cache = cache or HashCache()
    return {p: cache.of(p) for p in sorted(paths) if os.path.isfile(p)}


def pattern_regex(pattern: str) -> str:
    """A path pattern as a regular expression: * and ? within a folder, ** across folders."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif pattern[k] == "?":
            out, k = out + "[^/]", k + 1
        elif pattern[k] == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out, k = out + fnmatch.translate(pattern[k : end + 1]).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z"), end + 1
        else:
            out, k = out + re.escape(pattern[k]), k + 1
    return f"^{out}$"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of all files below root, on any store that Spark reads; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", "length", F.col("modificationTime").alias("modified"))


def folder_hashes(spark: SparkSession, root: str) -> DataFrame:
    """path, hash of the folders below root that hold files: a digest of the names, lengths and times of these. No file is opened.

    Sums do not depend on the files' order, so a folder's files are added up where they are listed and none is sorted or gathered.
    """
    one = lambda seed: F.xxhash64("path", "length", "modified", F.lit(seed)).cast("decimal(38,0)")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    parts = [F.count(F.lit(1)), F.sum("length"), F.sum(one(1)), F.sum(one(2))]
    return tree(spark, root).groupBy(folder.alias("path")).agg(F.sha2(F.concat_ws(" ", *(p.cast("string") for p in parts)), 256).alias("hash"))


def tree_hashes(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, hash of the files below root whose path from root matches; contents are hashed by the executors."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if pattern:
        base = re.sub(r"^file:/*", "/", root.rstrip("/"))
        inner = F.regexp_replace("path", rf"^[a-z0-9]*:?/*{re.escape(base.lstrip('/'))}/", "")
        df = df.where(inner.rlike(pattern_regex(pattern)))
    return df.select("path", F.sha2("content", 256).alias("hash"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path) with ignored. rules(seq, pattern, negate): a path is ignored if any rule matches and no negated one does, whatever their order.

    A pattern without a slash matches in any folder, and every pattern what lies below what it matches. The rules
    are a file's own lines; they become one expression, so the paths are scanned once and not joined.
    """
    rows = rules.select("pattern", "negate").collect()  # an ignore file's lines
    hit = lambda negate: _any_of(F.col("path"), [r["pattern"] for r in rows if r["negate"] == negate])
    return paths.withColumn("ignored", hit(False) & ~hit(True))


def _any_of(path: Column, patterns: list[str]) -> Column:
    each = [x for p in patterns for q in [p if "/" in p.strip("/") else f"**/{p.strip('/')}"] for x in (q.strip("/"), f"{q.strip('/')}/**")]
    return path.rlike("|".join(pattern_regex(e) for e in each)) if each else F.lit(False)


def ignore_rules(text: str) -> list[tuple[int, str, bool]]:
    """(seq, pattern, negate) of an ignore file; blank lines and comments are left out."""
    out = []
    for n, line in enumerate(text.splitlines()):
        rule = line.strip()
        if rule and not rule.startswith("#"):
            out.append((n, rule.removeprefix("!").strip(), rule.startswith("!")))
    return out


def expanded(paths: DataFrame, source: str, rules: DataFrame | None = None) -> DataFrame:
    """The files of paths(path) that a name means: itself, all below it if it is a folder, or what it matches."""
    name = source.strip("/").removeprefix("./")
    hit = paths.where((F.col("path") == name) | F.startswith("path", F.lit(f"{name}/")) | F.col("path").rlike(pattern_regex(name))) if name not in ("", ".") else paths
    return ignored(hit, rules).where("NOT ignored").drop("ignored") if rules is not None else hit


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
