"""What has changed, why, and what is to be done about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.graph import DEPENDENCY, closure

CREATE, UPDATE, NONE = "create", "update", "none"


def resolve_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """block, key, change: changed, new or removed; both sides have block, key and hash."""
    b = before.select("block", "key", F.col("hash").alias("old"), F.lit(True).alias("was"))
    a = after.select("block", "key", F.col("hash").alias("new"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return b.join(a, ["block", "key"], "full").select("block", "key", change.alias("change")).where("change IS NOT NULL")


def state_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (new, removed, changed or same), old, new for two snapshots."""
    b = before.select(key, F.col(value).alias("old"), F.lit(True).alias("was"))
    a = after.select(key, F.col(value).alias("new"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return b.join(a, key, "full").select(key, change.alias("change"), "old", "new")


def reasons(blocks: DataFrame, dirty_parents: DataFrame, diff: DataFrame, most: int = 3) -> DataFrame:
    """block, reason for each of blocks(block): changed parents first, then changed keys (up to `most` by name, else their number), then its inputs.

    dirty_parents(block, parent) and diff(block, key, change).
    """
    said = lambda items, many: F.when(F.size(items) <= most, F.array_join(items, ", ")).otherwise(F.concat(F.size(items).cast("string"), F.lit(many)))
    up = dirty_parents.groupBy("block").agg(F.array_sort(F.collect_set("parent")).alias("up"))
    keys = diff.groupBy("block").agg(F.array_sort(F.collect_set(F.concat("key", F.lit(" "), "change"))).alias("keys"))
    joined = blocks.select("block").join(up, "block", "left").join(keys, "block", "left")
    return joined.select("block", F.coalesce(F.concat(F.array_join("up", ", "), F.lit(" changed")), said(F.col("keys"), " sources changed"), F.lit("inputs changed")).alias("reason"))


def dirty(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """block: the changed ones and all whose contents depend on them."""
    return closure(edges.where(F.col("kind") == DEPENDENCY), changed.select(F.col("block").alias("name")), down=True).select(F.col("name").alias("block")).distinct()


def plan_actions(blocks: DataFrame, state: DataFrame, edges: DataFrame, rerun_failed: bool = False) -> DataFrame:
    """block, action, dirty: create without a state, update if its hash differs or a content parent is dirty, and else none.

    blocks(block, content_hash), state(block, content_hash[, passed]). With rerun_failed, a test that
    failed is run again although nothing changed.
    """
    failed = F.col("passed").eqNullSafe(F.lit(False)) if rerun_failed and "passed" in state.columns else F.lit(False)
    stored = state.select("block", F.col("content_hash").alias("stored"), failed.alias("failed"), F.lit(True).alias("known"))
    own = blocks.join(stored, "block", "left")
    differs = F.col("known").isNull() | ~F.col("content_hash").eqNullSafe(F.col("stored"))
    reached = dirty(edges, own.where(differs).select("block")).withColumn("dirty", F.lit(True))
    joined = own.join(reached, "block", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    action = F.when(F.col("known").isNull(), CREATE).when(F.col("dirty") | F.col("failed"), UPDATE).otherwise(NONE)
    return joined.select("block", action.alias("action"), "dirty")


def active_parameters(refs: DataFrame, active: DataFrame, given: DataFrame) -> DataFrame:
    """block, param: parameters that active blocks refer to and that have no value. refs(block, param), active(block), given(param)."""
    return refs.join(active, "block", "left_semi").join(given, "param", "left_anti").select("block", "param")
