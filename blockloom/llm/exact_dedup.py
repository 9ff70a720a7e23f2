"""Exact deduplication behind a two-pass Bloom filter.

A first scan writes every text's hash and digest with its id, so that texts are read once and never shuffled. Pass one
adds the hashes to a counting form of a blocked Bloom filter and keeps the bits that two rows have set. Pass two
probes it: a row that misses one of its bits is certainly unique and goes straight to the result; only the others
are shuffled, as a digest and an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import checkpointed, looked_up

#: Bits in a block of the filter: as many as one aggregate bitmap holds.
BLOCK_BITS = 32_768
BITS_PER_ROW = 16
#: Bytes up to which a filter is broadcast, and decisions on rows (some 100 bytes each) up to which they are.
FILTER_BYTES, BROADCAST_ROWS = 64 << 20, 200_000


def _positions(h: Column) -> list[Column]:
    """Two bits in a block for a hash whose remainder has already chosen the block."""
    mixed = F.xxhash64(h, F.lit(17))
    return [F.pmod(mixed, F.lit(BLOCK_BITS)), F.pmod(F.shiftrightunsigned(mixed, 20), F.lit(BLOCK_BITS))]


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def blocks_for(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))


def filter_bits(hashed: DataFrame, blocks: int, least: int = 2) -> DataFrame:
    """block, bitmap: the bits of the filter that at least so many rows have set. hashed has a column h."""
    where = F.pmod(F.col("h"), F.lit(blocks))
    bits = hashed.select(where.alias("block"), F.explode(F.array_distinct(F.array(*_positions(F.col("h"))))).alias("bit"))
    often = bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"))


def probed(rows: DataFrame, bits: DataFrame, blocks: int, max_filter_bytes: int) -> DataFrame:
    """rows, which have a column h, with maybe: whether the filter has all bits of h.

    Up to max_filter_bytes the filter is broadcast, and rows stay where they are. Beyond, they are joined by block.
    """
    if blocks * BLOCK_BITS // 8 <= max_filter_bytes:
        bits = F.broadcast(bits)
    found = rows.withColumn("block", F.pmod(F.col("h"), F.lit(blocks))).join(bits, "block", "left")
    first, second = (F.coalesce(_bit(F.col("bitmap"), p), F.lit(False)) for p in _positions(F.col("h")))
    return found.withColumn("maybe", first & second).drop("block", "bitmap")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are alone (id, sha), and of the others id, sha, c (rows alike in both), keep and n of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), _digest(text).alias("sha")))
    blocks = blocks_for(rows.count())
    found = probed(rows, filter_bits(rows.select("h"), blocks), blocks, max_filter_bytes)
    each = checkpointed(found.where("maybe").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("c")))
    groups = checkpointed(each.groupBy("sha").agg(F.max("id").alias("keep"), F.sum("c").alias("n")))
    return found.where(~F.col("maybe")).select("id", "sha"), looked_up(each, "sha", groups)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as the empty text. Of equal texts the row with the
    largest id stays. Rows that repeat both the id and the text are rows of the group, and exactly one of them
    stays; a null id is below all others. An empty table gives an empty result. Other columns are ignored.

    Two bytes of filter for each row are broadcast only up to max_filter_bytes; beyond that rows are joined with the filter by block, which moves
    a hash, a digest and an id per row but still no texts.
    """
    unique, groups = _grouped(docs, id_col, text_col, max_filter_bytes)
    alone = unique.select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("nth"))
    # Rows alike in id and text are counted and written out again, so that no task needs all rows of a text.
    found = groups.select("id", "sha", "keep", "n", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth"))
    return alone.unionByName(found).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows equal in id and text any one."""
    _, groups = _grouped(docs, id_col, text_col, max_filter_bytes)
    stays = F.col("id").eqNullSafe(F.col("keep"))
    return without(docs, groups.where(~stays | (F.col("c") > 1)).select("id", "sha", stays.alias("one")), id_col, text_col, max_filter_bytes=max_filter_bytes)


def without(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str, broadcast_rows: int = BROADCAST_ROWS, max_filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs without the rows of the ids and text digests of decided(id, sha, one), which are unique; where one, one row of those stays.

    Up to broadcast_rows decisions are broadcast. More go into a Bloom filter: rows that it does not know stay where they are,
    and only those that are decided on, and a percent more, are shuffled. A filter of over max_filter_bytes
    (of 32 million decisions) is not broadcast; then all rows are joined with the decisions.
    """
    decided = checkpointed(decided.select(F.struct("id", "sha").alias("key"), "one"))
    n, again = decided.count(), not decided.where("one").isEmpty()
    sha, kind = _digest(F.col(text_col)), decided.schema["key"].dataType["id"].dataType
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col(id_col).cast(kind).alias("id"), sha.alias("sha")).alias("key"))
    small, blocks = n <= broadcast_rows, blocks_for(n)
    straight = None
    if not small and blocks * BLOCK_BITS // 8 <= max_filter_bytes:
        hashed = rows.withColumn("h", F.xxhash64("key"))
        found = probed(hashed, checkpointed(filter_bits(decided.select(F.xxhash64("key").alias("h")), blocks, 1)), blocks, max_filter_bytes)
        straight, rows = found.where(~F.col("maybe")).select("row.*"), found.where("maybe").select("row", "key")
    met = rows.join(F.broadcast(decided) if small else decided, rows["key"] == decided["key"], "left").select("row", rows["key"], "one")
    out = met.where("one IS NULL").select("row.*")
    if again:
        out = out.unionByName(met.where("one").dropDuplicates(["key"]).select("row.*"))
    return out if straight is None else straight.unionByName(out)
