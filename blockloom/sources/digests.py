"""Digests of files of any size, as a data source: files are partitions, and are read in blocks.

    spark.dataSource.register(FileDigests)
    spark.read.format("file_digests").option("pattern", "**/*.go").load("s3://bucket/project")

A file is never in memory as a whole. Listings and reads go through Arrow's file systems, so root may be a folder of this machine and of all
executors alike, or of any store that Arrow opens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from blockloom.sources.files import pattern_regex

#: Bytes that are read at once, and bytes of a partition's files, if it has several.
BLOCK_BYTES, PARTITION_BYTES = 8 << 20, 256 << 20
SCHEMA = "path string, length long, hash string"


def opened(root: str):  # noqa: ANN201
    """Arrow's file system and path of a root."""
    from pyarrow import fs

    if re.match(r"file:/+", root) or "://" not in root:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", root).rstrip("/") or "/"
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


@dataclass
class Files(InputPartition):
    """Paths and lengths of a partition's files."""

    files: list[tuple[str, int]]


class DigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.pattern = pattern_regex(options.get("pattern", "**"))
        self.hidden = options.get("hidden", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        """The files that match, in order of their paths, packed up to PARTITION_BYTES; a longer file is a partition of its own."""
        from pyarrow import fs

        store, base = opened(self.root)
        matches = re.compile(self.pattern).match
        found = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            inner = info.path.removeprefix(base).lstrip("/")
            if info.type == fs.FileType.File and matches(inner) and (self.hidden or not any(x.startswith((".", "_")) for x in inner.split("/"))):
                found.append((info.path, info.size))
        out, held, size = [], [], 0
        for path, length in sorted(found):
            if held and size + length > PARTITION_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += length
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        store, _ = opened(self.root)
        for path, _ in partition.files:
            digest, length = hashlib.sha256(), 0
            with store.open_input_stream(path) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
                    length += len(block)
            yield path, length, digest.hexdigest()


class FileDigests(DataSource):
    """path, length, hash (SHA-256) of the files below a folder. Options: pattern (of paths from there, ** across folders), hidden (also what begins with . or _)."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DigestReader:
        return DigestReader(self.options)


def file_digests(spark: SparkSession, root: str, pattern: str = "**", hidden: bool = False) -> DataFrame:
    """path, length, hash of the files below root whose path from there matches."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("pattern", pattern).option("hidden", str(hidden).lower()).load(root)
