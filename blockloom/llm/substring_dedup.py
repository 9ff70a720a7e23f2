"""Removal of passages that occur earlier in the corpus, by fixed-block anchors.

Every text is cut into reference blocks that do not overlap, each of half a window. Any window contains a whole
block of the place where it occurred before, so:

1. the blocks are indexed by hash, and every rolling window of a block's length probes the index; a probe that
   meets a block elsewhere is an anchor;
2. around its anchors a text's windows of full length are compared with those around the anchors of all
   others, and of equal ones the first occurrence is found; the windows that occur earlier are joined
   to maximal repeats, whose words go.

Both steps send, from each chunk of texts to each bucket of hashes, one compressed sorted array of distinct hashes,
so a passage that a third of all documents share is one entry for each chunk, in one bucket. The answers are
bitmaps in the arrays' order. No pairs are made, and every window is seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.chunks import NO_ID, bucket_bits, chunked, opened
from blockloom.llm.common import checkpointed
from blockloom.llm.hashing import Words, pack, pack_sorted, unpack, unpack_sorted

_SENT = "bucket long, chunk long, step int, hashes binary, extra binary"
_ANSWERS = "chunk long, bucket long, step int, bits binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("step", pa.int32()), ("hashes", pa.binary()), ("extra", pa.binary())])
_ANSWERS_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("step", pa.int32()), ("bits", pa.binary())])


class _Chunk:
    """What every pass computes of a chunk."""

    def __init__(self, row: dict, window: int, bits: int) -> None:
        self.window, self.block, self.bits = window, window // 2, bits
        self.ids, self.data, offsets = opened(row)
        self.offsets = offsets
        self.words = Words(self.data, offsets)
        self.at, hashes = self.words.windows(self.block)
        self.probes, index, self.probe_of = np.unique(hashes, return_index=True, return_inverse=True)
        text = np.searchsorted(self.words.first, self.at, "right") - 1
        aligned = (self.at - self.words.first[text]) % self.block == 0
        self.is_block = np.zeros(len(self.probes), bool)
        self.is_block[self.probe_of[aligned]] = True
        self.is_multiple = np.bincount(self.probe_of, minlength=len(self.probes)) > 1

    def buckets(self, hashes: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The parts of an ascending array that go to each bucket, by the hashes' first bits."""
        found, start = np.unique(hashes >> np.uint64(64 - self.bits), return_index=True)
        for b, i, j in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(hashes)], strict=True):
            yield b, slice(i, j)

    def answered(self, hashes: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for b, part in self.buckets(hashes):
            if b in answers:
                out[part] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=part.stop - part.start).astype(bool)
        return out

    def candidates(self, answers: dict[int, bytes]) -> None:
        """The windows of full length that have an anchor, distinct ones with the number of the first."""
        anchors = np.zeros(len(self.words) + 1, np.int64)
        anchors[self.at + 1] = self.answered(self.probes, answers)[self.probe_of]
        upto = np.cumsum(anchors)
        start, hashes = self.words.windows(self.window)
        inner = self.window - self.block + 1  # so many probes lie in a window
        has = upto[start + inner] > upto[start]
        self.start = start[has]
        hashes, second = hashes[has], self.words.windows(self.window, second=True)[1][has]
        order = np.lexsort((second, hashes))  # stable, so the first of equal ones is that of the first window
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(second[order]) != 0)
        self.first = order[new]
        self.hashes, self.second = hashes[self.first], second[self.first]

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each word lies in a window that occurs earlier."""
        earlier = np.ones(len(self.start), bool)
        earlier[self.first] = self.answered(self.hashes, answers)
        step = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(step, self.start[earlier], 1)
        np.add.at(step, self.start[earlier] + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _probe(window: int, bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, window, bits)
            rest = (c.probes >> np.uint64(32 - bits)).astype(np.uint32)  # the 32 bits after the bucket's
            flags = np.stack([c.is_block, c.is_multiple])
            sent = [(b, row["chunk"], 1, pack_sorted(rest[p]), np.packbits(flags[:, p], axis=1).tobytes()) for b, p in c.buckets(c.probes)]
            yield pa.record_batch([list(x) for x in zip(*sent, strict=True)] if sent else [[]] * 5, schema=_SENT_ARROW)

    return run


def _met(table: pa.Table) -> pa.Table:
    """Step 1 in a bucket: which probes meet a block that is not themselves."""
    rows = table.to_pylist()
    each = [unpack_sorted(r["hashes"], np.uint32) for r in rows]
    sizes = [len(x) for x in each]
    flags = np.concatenate([np.unpackbits(np.frombuffer(r["extra"], np.uint8).reshape(2, -1), axis=1, count=n) for r, n in zip(rows, sizes, strict=True)], axis=1)
    key = np.sort((np.concatenate(each).astype(np.uint64) << np.uint64(32)) | np.arange(sum(sizes), dtype=np.uint64))
    order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    value = key >> np.uint64(32)
    group = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    blocks = np.bincount(group, flags[0, order]) > 0
    multiple = (np.bincount(group) > 1) | (np.bincount(group, flags[1, order]) > 0)
    hit = np.empty(len(order), bool)
    hit[order] = (blocks & multiple)[group]
    return _answers(rows, sizes, hit)


def _answers(rows: list[dict], sizes: list[int], hit: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    out = [(r["chunk"], r["bucket"], r["step"], np.packbits(part).tobytes()) for r, n, e in zip(rows, sizes, ends, strict=True) if (part := hit[e - n : e]).any()]
    return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _ANSWERS_ARROW, strict=True)] if out else [pa.array([], f.type) for f in _ANSWERS_ARROW], schema=_ANSWERS_ARROW)


def _of_step(answers: pa.Table, step: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in answers.to_pylist() if r["step"] == step}


def _extend(window: int, bits: int):  # noqa: ANN202
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        sent = []
        for row in chunk.to_pylist():
            c = _Chunk(row, window, bits)
            c.candidates(_of_step(answers, 1))
            text = np.searchsorted(c.words.first, c.start[c.first], "right") - 1
            ids = c.ids[text]
            sent += [(b, row["chunk"], 2, pack_sorted(c.hashes[p]), pack(np.concatenate([ids[p].view(np.uint64), c.second[p]]))) for b, p in c.buckets(c.hashes)]
        return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*sent, strict=True), _SENT_ARROW, strict=True)] if sent else [pa.array([], f.type) for f in _SENT_ARROW], schema=_SENT_ARROW)

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """Step 2 in a bucket: which windows have an equal one in a text with a smaller id, or in an earlier chunk with the same id."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    each = [unpack_sorted(r["hashes"], np.uint64) for r in rows]
    sizes = [len(x) for x in each]
    extra = [unpack(r["extra"], np.uint64) for r in rows]
    hashes, ids, second = np.concatenate(each), np.concatenate([x[:n] for x, n in zip(extra, sizes, strict=True)]).view(np.int64), np.concatenate([x[n:] for x, n in zip(extra, sizes, strict=True)])
    order = np.lexsort((ids, second, hashes))  # stable: by chunk at last
    same = lambda x: np.diff(x[order], prepend=x[order][:1] + np.uint64(1)) == 0
    hit = np.empty(len(order), bool)
    hit[order] = same(hashes) & same(second)
    return _answers(rows, sizes, hit)


_RESULT = pa.schema([("id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _cut(window: int, bits: int):  # noqa: ANN202
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            c = _Chunk(row, window, bits)
            c.candidates(_of_step(answers, 1))
            gone = c.repeated(_of_step(answers, 2))
            whole = c.data.tobytes()
            upto = np.concatenate([[0], np.cumsum(gone)])
            for k, i in enumerate(c.ids.tolist()):
                a, z = int(c.words.first[k]), int(c.words.first[k + 1])
                words = whole[c.offsets[k] : c.offsets[k + 1]].split()
                removed, spans = int(upto[z] - upto[a]), []
                if removed:
                    own = gone[a:z]
                    edge = np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))
                    spans = [{"start": s, "stop": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                    words = [words[j] for j in np.flatnonzero(~own).tolist()]
                out.append((i, b" ".join(words).decode("utf-8", "replace"), z - a, removed, spans))
        return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _RESULT, strict=True)] if out else [pa.array([], f.type) for f in _RESULT], schema=_RESULT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """id_col, kept_text, n_words, n_removed, spans: a row for each row of docs.

    spans are the maximal repeats that were cut, as ranges of word numbers: every word in a window of `window` words
    (an even number) that also starts earlier, in a document with a smaller id or before in the same one.
    kept_text is the other words, joined by a space. Windows are judged on the input. Of rows with the same id
    one counts as the earlier. A null text is empty; a null id sorts before all others. Texts shorter than
    a window lose nothing; other columns are ignored; an empty table gives an empty result.

    Words are told apart by 64 bits, windows of full length by two hashes of 64 bits each.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = bucket_bits(total)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks = chunked(docs, id_col, text_col)
    buckets = lambda df: df.repartition(max(parts, min(2**bits, 4 * parts)), "bucket").groupBy("bucket")
    anchors = checkpointed(buckets(chunks.mapInArrow(_probe(window, bits), _SENT)).applyInArrow(_met, _ANSWERS))
    sent = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_extend(window, bits), _SENT)
    repeats = buckets(sent).applyInArrow(_earlier, _ANSWERS)
    out = chunks.groupBy("chunk").cogroup(anchors.unionByName(repeats).groupBy("chunk")).applyInArrow(
        _cut(window, bits), "id long, kept_text string, n_words long, n_removed long, spans array<struct<start: long, stop: long>>"
    )
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "kept_text", "n_words", "n_removed", "spans")
