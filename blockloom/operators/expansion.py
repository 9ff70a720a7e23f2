"""Matrix expansion as tables: a slice for every combination of key values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cartesian(spark: SparkSession, keys: dict[str, list[str]]) -> DataFrame:
    """A row for each combination, the first key's values outermost; place numbers them.

    The key lists are a pipeline's own, so their product is the number of slices asked for; it is generated
    by exploding one key after another, without a join.
    """
    df = spark.range(1).select()
    for key, values in keys.items():
        df = df.select("*", F.posexplode(F.array(*map(F.lit, values)).cast("array<string>")).alias(f"__{key}", key))
    order: Column = F.lit(0).cast("long")
    for key, values in keys.items():
        order = order * len(values) + F.col(f"__{key}")
    return df.select(*keys, order.alias("place"))


def slice_name(name: str | Column, *keys: Column) -> Column:
    """name[v1, v2]"""
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit("["), F.array_join(F.array(*keys), ", "), F.lit("]"))


def aligned(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Slices of two matrices that stand side by side: only matrices with the same keys in the same order align."""
    if left_keys != right_keys:
        raise ValueError(f"[{', '.join(left_keys)}] and [{', '.join(right_keys)}] do not align")
    return left.join(right, left_keys)


def slices_of(names: DataFrame, base: str) -> DataFrame:
    """The names that a dependency on base means: base itself, or its slices."""
    return names.where((F.col("name") == base) | F.startswith("name", F.lit(f"{base}[")))
