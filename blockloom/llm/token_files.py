"""Token ids of documents in files of directly addressable codes, and their way back.

The text is cut where no token of a byte-level vocabulary can lie across (before a single space, around a single
line end, between a letter or digit and a mark, around the tokenizer's added tokens), each distinct piece is encoded once by the tokenizers library
and remembered by a hash and its bytes, and the ids are gathered by array operations.

A file is a Parquet file, so that Spark commits it as a whole on any store, with a row for each shard: its place in
the order, the documents' ids and token numbers, and the payload in the layout of blockloom.llm.codes.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.codes import Codes, encoded
from blockloom.llm.common import shared_folder
from blockloom.llm.hashing import joined, mixed
from blockloom.llm.token_counts import byte_alphabet

#: Ids in a shard, and bytes of text that are encoded at once.
SHARD_IDS, STEP_BYTES = 4 << 20, 4 << 20
#: Distinct pieces that a worker remembers at most, and their bytes: in texts without spaces a piece may be of any length.
REMEMBERED, REMEMBERED_BYTES = 2_000_000, 32 << 20
#: Shards up to which their directory (24 bytes each) is broadcast.
BROADCAST_SHARDS = 500_000

_INK, _DOUBT, _WORD, _MARK = 1, 2, 4, 8
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _INK
_KINDS[0x80:] = _INK
_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _WORD
_KINDS[[b for b in range(0x21, 0x7F) if not _KINDS[b] & _WORD and b != 0x27]] |= _MARK  # an apostrophe may be part of a contraction


def piece_starts(data: np.ndarray, offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Where the pieces of texts that lie one after another begin; spans (begin, end) are pieces of their own."""
    kind = _KINDS[data]
    for lead, more in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):  # Unicode's white space begins with these
        at = np.flatnonzero(data == lead)
        for k in range(more + 1):
            kind[np.minimum(at + k, len(data) - 1)] = 0
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # the letters of Latin-1, and two signs
    kind[latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]] |= _WORD
    ink = (kind & _INK) > 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    alone = before & after
    line = alone & (data == 0x0A)
    cut = line | (alone & (data == 0x20))
    cut[1:] |= line[:-1]
    cut[1:] |= ((kind[1:] & _MARK) > 0) & ((kind[:-1] & _WORD) > 0)
    starts = offsets[:-1]
    cut[starts[starts < len(data)]] = True
    for begin, end in spans:
        cut[begin] = True
        cut[begin + 1 : end] = False
        cut[end : end + 1] = True
    return np.flatnonzero(cut)


_BASE, _STEP = 0x9E3779B97F4A7C15, 1 << 20
_LETTER = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  a cache
    if base not in kept or len(kept[base]) < n:
        full = np.full(max(n, 1024), base, np.uint64)
        full[0] = 1
        kept[base] = np.cumprod(full, dtype=np.uint64)
    return kept[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cheap hash of the bytes of each span; spans ascend and do not overlap. Unequal spans may share it: bytes are compared as well."""
    out = np.empty(len(starts), np.uint64)
    i, inverse = 0, pow(_BASE, -1, 2**64)
    while i < len(out):  # in steps, which bounds the memory
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + _STEP)))
        n = int(ends[j - 1] - low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data[low : low + n]] * _powers(_BASE, n), out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mixed((total[e] - total[s]) * _powers(inverse, n + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


#: How the vocabulary writes each byte.
_LETTERS = {b: c for c, b in byte_alphabet().items()}


class Encoder:
    """Ids of many texts at once; equal to the library's ids of each text."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.names = {t.content for t in added}
        longest_first = sorted((x.encode() for x in self.names), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if self.names else None
        # Where tokens depend on what is around them or on each other, a text that has one is a piece.
        self.whole = any(t.single_word or t.lstrip or t.rstrip for t in added) or len({t.normalized for t in added}) > 1
        self.forget()

    def forget(self) -> None:
        """Entry 0 is the end of a document, id 0. Of each entry: its tokens in flat, and its bytes in raw."""
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.flat = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint32)
        self.raw_begin, self.raw_size, self.raw = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def learn(self, raw: list[bytes]) -> np.ndarray:
        """Encode pieces; their entries."""
        pieces = [p.decode("utf-8", "replace") for p in raw]
        found, rest, tokens = [None] * len(pieces), [], self.tokenizer.model.tokenize
        for k, piece in enumerate(pieces):
            if piece.removeprefix(" ").isalpha() and not self.whole and piece not in self.names:  # one word: the model alone gives its tokens, at half the cost
                found[k] = [t.id for t in tokens(piece.encode().decode("latin-1").translate(_LETTERS))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        size, long = np.array([len(x) for x in found], np.int64), np.array([len(x) for x in raw], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        new = len(self.begin) + np.arange(len(raw))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.raw_begin = np.concatenate([self.raw_begin, len(self.raw) + np.cumsum(long) - long])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.raw_size, self.raw = np.concatenate([self.raw_size, long]), np.concatenate([self.raw, np.frombuffer(b"".join(raw), np.uint8)])
        return new

    def unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which pieces have other bytes than their entries, by number: those whose hash met another's."""
        size = ends - starts
        other = size != self.raw_size[entry]
        if not other.any() and len(size):  # pieces lie one after another, so their entries' bytes laid out so must be the text
            at = self.raw_begin[entry] - starts
            differs = self.raw[np.repeat(at, size) + np.arange(starts[0], ends[-1])] != data[starts[0] : ends[-1]]
            if differs.any():
                other[np.unique(np.searchsorted(starts, np.flatnonzero(differs) + starts[0], "right") - 1)] = True
        elif len(size):
            raw, kept = data.tobytes(), self.raw.tobytes()
            begin = self.raw_begin[entry]
            other |= np.array([raw[a:z] != kept[b : b + z - a] for a, z, b in zip(starts.tolist(), ends.tolist(), begin.tolist(), strict=True)], bool)
        return np.flatnonzero(other)

    def added_spans(self, texts: list[bytes], offsets: list[int]) -> list[tuple[int, int]]:
        """Where added tokens begin and end in texts that lie one after another."""
        found = [(at + m.start(), at + m.end()) for at, text in zip(offsets, texts, strict=False) for m in self.added.finditer(text)]
        if self.whole:
            found = [(at, at + len(text)) for at, text in zip(offsets, texts, strict=False) if self.added.search(text)]
        return found

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with 0 after each text, and how many each text has."""
        data, offsets = joined(texts)
        spans = self.added_spans(texts, offsets.tolist()) if self.added else []
        starts = piece_starts(data, offsets, spans) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        distinct, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED or len(self.raw) + len(data) > REMEMBERED_BYTES:
            self.forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        new, raw = np.flatnonzero(~known), data.tobytes()
        if len(new):
            entries = self.learn([raw[starts[first[k]] : ends[first[k]]] for k in new.tolist()])
            at = np.searchsorted(self.keys, distinct[new])
            self.keys, self.entry = np.insert(self.keys, at, distinct[new]), np.insert(self.entry, at, entries)
            place = np.searchsorted(self.keys, distinct)
        entry = self.entry[place][of] if len(distinct) else np.zeros(0, np.int64)
        if len(lost := self.unlike(data, starts, ends, entry)):
            entry[lost] = self.learn([raw[starts[k] : ends[k]] for k in lost.tolist()])
        first_piece = np.searchsorted(starts, offsets)
        entry = np.insert(entry, first_piece[1:], 0)
        size = self.size[entry]
        ends_at = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[entry] - (ends_at - size), size) + np.arange(int(size.sum()))]
        last = first_piece[1:] + np.arange(len(texts))  # of each text, its entry for the end
        return ids, np.diff(ends_at[last], prepend=0)


_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])
_ENCODERS: dict[int, Encoder] = {}


def _shards(tokenizer_json: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = hash(tokenizer_json)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(tokenizer_json))
        part, seq = TaskContext.get().partitionId(), 0
        docs, texts, held, size, ids, counts = [], [], 0, 0, [], []

        def step() -> None:
            nonlocal texts, held, size
            if texts:
                i, n = encoder.encode(texts)
                ids.append(i)
                counts.append(n)
                size += len(i)
                texts, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, size, seq
            known = np.array([d is not None for d in docs])
            row = [part, seq, len(docs), size, np.array([d or 0 for d in docs], np.int64).tobytes(), known.tobytes(), np.concatenate(counts).astype(np.int64).tobytes(), encoded(np.concatenate(ids))]
            docs, size, seq = [], 0, seq + 1
            ids.clear()
            counts.clear()
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _SHARD, strict=True)], schema=_SHARD)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(d)
                texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                held += len(texts[-1]) + 64
                if held >= STEP_BYTES:
                    step()
                    if size >= SHARD_IDS:
                        yield flush()
        step()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every row's text, in ascending order of id, and write the files; returns their path.

    Every document ends with id 0. Null ids come first, null texts are empty, rows alike in id are in order of
    a hash of their texts, so that they may lie in several files. Ids must be whole numbers. Other columns are ignored; an empty table writes no rows. path defaults to a new folder in
    the cluster's shared one. The tokenizer's file is read by the driver and sent with the tasks.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be a whole number, not {dict(docs.dtypes)[id_col]}")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (32 << 20)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    kinds = "part int, seq int, n_docs long, n_ids long, ids binary, known binary, counts binary, codes binary"
    ordered.mapInArrow(_shards(tokenizer), kinds).write.option("compression", "zstd").parquet(path)
    return path


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, at, out = Codes(row["codes"]), 0, []
            known = np.frombuffer(row["known"], bool).tolist()
            for d, k, n in zip(np.frombuffer(row["ids"], np.int64).tolist(), known, np.frombuffer(row["counts"], np.int64).tolist(), strict=True):
                crc = zlib.crc32(codes.slice(at, at + n).astype("<u4").tobytes())
                out.append((d if k else None, row["start"] + at, n, crc))
                at += n
            yield pa.record_batch([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """The files' shards with start, the number of ids in all shards before."""
    shards = spark.read.parquet(path)
    order = shards.select("part", "seq", "n_ids").withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("n_ids")
    if shards.count() <= BROADCAST_SHARDS:
        order = F.broadcast(order)
    return shards.join(order, ["part", "seq"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files: where its ids begin among all, and their checksum as 32-bit numbers."""
    return shard_starts(spark, path).select("ids", "known", "counts", "codes", "start").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
