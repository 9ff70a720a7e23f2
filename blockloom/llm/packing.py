"""Best-fit packing of documents into bins of one capacity, under conflicts.

Pieces are dealt at random to shards of bounded size, and each shard is packed for itself: pieces by falling
size, each into the tightest bin that it fits and does not conflict with. A bin carries bitmaps of its sources
and duplicate clusters. Bins are ordered by residual; the search begins at the least residual that is large
enough and goes on to its successors until a compatible bin is found, and opens a new bin only if there is none.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import checkpointed

#: Pieces in a shard, about.
SHARD = 8192
_RESULT = "row long, part int, bin_id long, start long, length long, bin_used long"
_ARROW = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("bin_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin_used", pa.int64())])


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece (size, source, cluster), where sources and clusters are small numbers.

    No bin has two pieces of a cluster, or more than per_source of a source; cluster -1 conflicts with none.
    """
    sources: list[list[int]] = []  # of each bin, bitmaps: the sources it has once, twice, ...
    clusters: list[int] = []
    used: list[int] = []
    by_residual: dict[int, list[int]] = defaultdict(list)
    occupied = 0  # a bit for each residual that some bin has
    out: list[tuple[int, int]] = [(0, 0)] * len(pieces)
    for k in sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], k)):
        size, source, cluster = pieces[k]
        bit, own = 1 << source, 1 << cluster if cluster >= 0 else 0
        found, rest = -1, occupied >> size
        base = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            at = base + step
            for b in by_residual[at]:
                if not (sources[b][-1] & bit or clusters[b] & own):
                    found = b
                    break
            if found >= 0:
                by_residual[at].remove(found)
                if not by_residual[at]:
                    occupied &= ~(1 << at)
                break
            rest >>= step + 1
            base = at + 1
        if found < 0:
            found = len(used)
            used.append(0)
            clusters.append(0)
            sources.append([0] * per_source)
        out[k] = (found, used[found])
        used[found] += size
        clusters[found] |= own
        levels = sources[found]
        level = next(n for n, x in enumerate(levels) if not x & bit)
        levels[level] |= bit
        residual = capacity - used[found]
        if residual:
            by_residual[residual].append(found)
            occupied |= 1 << residual
    return out


def _pack(capacity: int, per_source: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["row"], r["part"]))
        shard = rows[0]["shard"]
        source = {s: n for n, s in enumerate(dict.fromkeys(r["source"] for r in rows))}
        again = Counter(r["cluster"] for r in rows)
        cluster = {c: n for n, c in enumerate(c for c, n in again.items() if n > 1 and c is not None)}
        placed = best_fit([(r["length"], source[r["source"]], cluster.get(r["cluster"], -1)) for r in rows], capacity, per_source)
        used = Counter()
        for r, (b, _) in zip(rows, placed, strict=True):
            used[b] += r["length"]
        first = shard << 32
        out = [(r["row"], r["part"], first + b, s, r["length"], used[b]) for r, (b, s) in zip(rows, placed, strict=True)]
        return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", size: str | None = None, source_col: str = "source", cluster_col: str | None = None, text_col: str = "text", capacity: int = 4096, per_source: int = 4) -> DataFrame:
    """id_col, part, bin_id, start, length, bin_used: a row for each piece of a document.

    size is a column of sizes (default: the number of words of text_col); cluster_col one of duplicate clusters
    (default: the text itself). Documents longer than capacity are cut into full pieces and a rest; part counts
    them. A bin's pieces lie one after another from start 0 and fill at most capacity. No bin has two pieces of
    one cluster, so neither two pieces of a document nor two copies, nor more than per_source of one
    source. Documents without words have one row of length 0 and no bin. Null sizes count as 0, a null source
    is a source, a null text is the empty text; repeated rows are packed each. An empty table gives an empty result.
    """
    words = F.col(size) if size else F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # The row's number deals equal rows to different shards; the checkpoint makes it lasting.
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(words.cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.monotonically_increasing_id().alias("row")))
    parts = F.ceil(F.col("size") / capacity).cast("int")
    pieces = rows.where("size > 0").select("row", "source", "cluster", "size", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pieces = pieces.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part") * capacity)).drop("size")
    n = rows.agg(F.sum(parts)).first()[0] or 0
    shards = max(1, math.ceil(n / SHARD))
    # A document's pieces go to shards that follow each other, so one very long document is spread as well.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row") + F.expr("part div 8"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(_pack(capacity, per_source), _RESULT)
    empty = rows.where("size = 0").select(F.col("id").alias(id_col), F.lit(0).alias("part"), F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("bin_used"))
    return packed.join(rows.select("row", F.col("id").alias(id_col)), "row").select(id_col, "part", "bin_id", "start", "length", "bin_used").unionByName(empty)
