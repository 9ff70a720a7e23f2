"""Texts in chunks of a few megabytes, written once and read by every pass that needs them.

A pass over a chunk deals one packed array to each bucket of hashes; a bucket's task answers with one array for
each chunk. So what is shuffled are arrays of hashes, a few bytes for a word, whose rows are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import written

CHUNK_BYTES = 4 << 20
#: Stands for a null id, before all others; a real id of this value counts as null.
NO_ID = -(1 << 63)
#: A row's number is its chunk's and then its place there, in so many bits: a chunk has fewer rows, as each counts 16 bytes and more.
PLACE_BITS = 20
SCHEMA = "chunk long, ids binary, lengths binary, texts binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("texts", pa.large_binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, n, held, size = TaskContext.get().partitionId() << PLACE_BITS, 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal n, held, size
        held.sort()
        ids, texts = np.array([i for i, _ in held], np.int64), [t for _, t in held]
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        out = pa.record_batch([[base + n], [ids.tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], pa.array([blob], pa.large_binary())], schema=_ARROW)
        n, held, size = n + 1, [], 0
        return out.cast(pa.schema([*list(_ARROW)[:3], ("texts", pa.binary())]))

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for k, i in enumerate(ids):
            text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            held.append((i, text))
            size += len(text) + 16
            if size >= CHUNK_BYTES:
                yield flush()
    if held:
        yield flush()


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table of chunks, each of whole texts in ascending order of id; null texts are empty.

    Ids must be whole numbers; for others, number the rows first.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be a whole number, not {dict(docs.dtypes)[id_col]}")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_chunks, SCHEMA), "none")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a chunk."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = zstandard.ZstdDecompressor().decompress(row["texts"]) if offsets[-1] else b""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(data, np.uint8), offsets


def bucket_bits(total_bytes: int) -> int:
    """So many bits of a hash choose its bucket that a bucket gets the windows of 24 MB of text, a task's worth; 2**8 at least."""
    return max(8, int(np.ceil(np.log2(max(1, total_bytes) / 24e6))))
