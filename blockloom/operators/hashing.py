"""Content hashes: of inputs, of blocks with their sources and parents, and up a graph level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.acyclic import depths
from blockloom.operators.common import checkpointed, deleted, written_by_depth
from blockloom.operators.graph import DEPENDENCY, MERGED_ROUNDS


def canonical(col: Column, t: T.DataType) -> Column:
    """A value that does not depend on the order of keys: map entries sorted, struct fields by name."""
    if isinstance(t, T.MapType):
        entries = F.array_sort(F.map_entries(col))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], t.valueType).alias("value")))
    if isinstance(t, T.StructType):
        fields = [canonical(col[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: canonical(x, t.elementType))
    return col


def input_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's fields as JSON with sorted keys; null fields are written."""
    fields = sorted((f for f in df.schema.fields if columns is None or f.name in columns), key=lambda f: f.name)
    packed = F.struct(*(canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def _ordered(pairs: DataFrame, by: str, key: str, value: str, between: str) -> DataFrame:
    each = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda p: F.concat(p["k"], F.lit(between), p["v"])), between)
    return pairs.groupBy(F.col(by).alias("block")).agg(text.alias("text"))


def content_hashes(blocks: DataFrame, resolved: DataFrame, parents: DataFrame, delimited: bool = True) -> DataFrame:
    """block, content_hash: of the input hash, the sorted sources and the sorted parents' content hashes.

    blocks(block, input_hash), resolved(block, key, hash), parents(block, parent, hash). delimited puts a
    separator between the parts, so that no two different inputs read alike; without it they stand side by side.
    """
    between = "\x1f" if delimited else ""
    sources = _ordered(resolved, "block", "key", "hash", between).withColumnRenamed("text", "sources")
    above = _ordered(parents, "block", "parent", "hash", between).withColumnRenamed("text", "above")
    joined = blocks.join(sources, "block", "left").join(above, "block", "left")
    return joined.select("block", _whole("input_hash", "sources", "above", delimited).alias("content_hash"))


def _whole(own: str, sources: str, above: str, delimited: bool) -> Column:
    """The content hash of a block's three parts."""
    parts = [F.col(own), F.coalesce(F.col(sources), F.lit("")), F.coalesce(F.col(above), F.lit(""))]
    return F.sha2(F.concat(parts[0], F.lit("\x1e"), parts[1], F.lit("\x1e"), parts[2]) if delimited else F.concat(*parts), 256)


def dependency_hashes(edges: DataFrame, state: DataFrame) -> DataFrame:
    """block, parent, hash: the stored content hashes of the blocks that a block's contents depend on; parents without state are left out."""
    stored = state.select(F.col("block").alias("parent"), F.col("content_hash").alias("hash"))
    return edges.where(F.col("kind") == DEPENDENCY).select(F.col("dst").alias("block"), F.col("src").alias("parent")).distinct().join(stored, "parent").select("block", "parent", "hash")


def merkle(blocks: DataFrame, resolved: DataFrame, nodes: DataFrame, edges: DataFrame, delimited: bool = True, level: DataFrame | None = None) -> DataFrame:
    """block, content_hash for a whole graph, level by level: one join and one aggregation for each depth.

    Sources are put in order once, for all blocks; blocks and edges lie in a folder for each depth, so a level reads its own.
    level(block, depth) is worked out where it is not given.
    """
    between = "\x1f" if delimited else ""
    spark = blocks.sparkSession
    if level is None:
        level = checkpointed(depths(nodes, edges).withColumnRenamed("name", "block"))
    deepest = level.agg(F.max("depth")).first()[0]
    if deepest is None:
        return blocks.select("block", F.col("input_hash").alias("content_hash")).limit(0)
    sources = _ordered(resolved, "block", "key", "hash", between).withColumnRenamed("text", "sources")
    at, own = written_by_depth(blocks.join(sources, "block", "left").join(level, "block").select("block", "input_hash", "sources", "depth"))
    ways = edges.where(F.col("kind") == DEPENDENCY).select(F.col("dst").alias("block"), F.col("src").alias("parent")).distinct()
    ways_at, ways = written_by_depth(ways.join(level, "block").select("block", "parent", "depth"))
    done = None
    for d in range(deepest + 1):
        here = own.where(F.col("depth") == d).drop("depth")
        if done is None:
            above = here.select("block", F.lit("").alias("above"))
        else:
            stored = ways.where(F.col("depth") == d).join(done.select(F.col("block").alias("parent"), F.col("content_hash").alias("hash")), "parent")
            above = _ordered(stored, "block", "parent", "hash", between).withColumnRenamed("text", "above")
        hashed = checkpointed(here.join(above, "block", "left").select("block", _whole("input_hash", "sources", "above", delimited).alias("content_hash")))
        done = hashed if done is None else done.unionByName(hashed)
        if (d + 1) % MERGED_ROUNDS == 0:
            done = checkpointed(done)
    deleted(spark, at)
    deleted(spark, ways_at)
    return done


def merkle_tree(blocks: DataFrame, resolved: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What merkle_changed starts from: state(block, depth, own, content_hash) and ways(block, parent, depth), depth that of block.

    own is the input hash and the sources, in order; keep both tables partitioned by depth.
    """
    level = checkpointed(depths(nodes, edges).withColumnRenamed("name", "block"))
    state = owned(blocks, resolved).join(level, "block").join(merkle(blocks, resolved, nodes, edges, level=level), "block")
    ways = edges.where(F.col("kind") == DEPENDENCY).select(F.col("dst").alias("block"), F.col("src").alias("parent")).distinct().join(level, "block")
    return state.select("block", "depth", "own", "content_hash"), ways.select("block", "parent", "depth")


def owned(blocks: DataFrame, resolved: DataFrame) -> DataFrame:
    """block, own: what a block's content hash is made of besides its parents."""
    sources = _ordered(resolved, "block", "key", "hash", "\x1f").withColumnRenamed("text", "sources")
    return blocks.join(sources, "block", "left").select("block", F.concat("input_hash", F.lit("\x1e"), F.coalesce("sources", F.lit("")), F.lit("\x1e")).alias("own"))


def merkle_changed(state: DataFrame, ways: DataFrame, changes: DataFrame) -> DataFrame:
    """block, own, old_hash, content_hash of the blocks that had to be hashed again after changes(block, own), those whose hash came out the same too.

    Level by level from the first change on: a level's blocks are hashed again if they changed themselves or the hash of one
    of their parents did, and only they; so what is hashed is bounded by what depends on the changes, and ends where nothing new
    comes out. Equal to merkle() over everything. The graph must be the one of state; blocks that are new or moved need merkle_tree().
    """
    spark = state.sparkSession
    own = checkpointed(changes.join(state.select("block", "depth"), "block").select("block", "own", "depth"))
    first, deepest = own.agg(F.min("depth")).first()[0], state.agg(F.max("depth")).first()[0]
    out = moved = None
    for d in range(first, deepest + 1) if first is not None else ():
        here = ways.where(F.col("depth") == d).select("block", "parent")
        dirty = own.where(F.col("depth") == d).select("block")
        if moved is not None:
            dirty = dirty.unionByName(here.join(moved.select(F.col("block").alias("parent")), "parent", "left_semi").select("block")).distinct()
        dirty = checkpointed(dirty)
        if dirty.isEmpty():
            continue
        mine = state.where(F.col("depth") == d).join(dirty, "block").select("block", F.col("own").alias("before"), F.col("content_hash").alias("old_hash"))
        wanted = here.join(dirty, "block")
        hashes = wanted.join(state.where(F.col("depth") < d).select(F.col("block").alias("parent"), F.col("content_hash").alias("was")), "parent")
        if moved is None:
            hashes = hashes.select("block", "parent", F.col("was").alias("hash"))
        else:
            hashes = hashes.join(moved.select(F.col("block").alias("parent"), F.col("content_hash").alias("now")), "parent", "left").select("block", "parent", F.coalesce("now", "was").alias("hash"))
        above = _ordered(hashes, "block", "parent", "hash", "\x1f").withColumnRenamed("text", "above")
        now = mine.join(own.select("block", "own"), "block", "left").select("block", F.coalesce("own", "before").alias("own"), "old_hash").join(above, "block", "left")
        done = checkpointed(now.select("block", "own", "old_hash", F.sha2(F.concat("own", F.coalesce("above", F.lit(""))), 256).alias("content_hash")))
        out = done if out is None else out.unionByName(done)
        new = done.where("content_hash <> old_hash").select("block", "content_hash")
        moved = new if moved is None else moved.unionByName(new)
        if (d + 1) % MERGED_ROUNDS == 0:
            out, moved = checkpointed(out), checkpointed(moved)
    return out if out is not None else spark.createDataFrame([], "block string, own string, old_hash string, content_hash string")
