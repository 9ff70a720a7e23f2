"""Numbers and running values over rows in order, with no task that gets them all.

Rows are cut into ranges of about equal counts by quantiles of their order. Each range is worked out on its own, and starts from
what a small table, with a row for each range and key, says of the ranges before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.common import checkpointed, written

#: Rows of a range, and ranges at most: a running value's table has so many rows a key.
RANGE, RANGES = 1_000_000, 4_096
#: Bits of a row's place in its partition.
_PLACE = 33


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with the place of each row in an order, from 1: by its place in a range of the order and the counts of the ranges before."""
    at, part = f"__{name}_at", f"__{name}_part"
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(at, _PLACE))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(part, before.alias("__before"))
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col("__before") + F.col(at).bitwiseAND(F.lit((1 << _PLACE) - 1)) + 1).drop(at, part, "__before")


def _bounds(df: DataFrame, seq: str, size: int | None) -> list:
    """Where ranges of about size rows end; none if one is enough."""
    known = size is None and small(df)
    size = size or RANGE
    n = 1 if known else min(RANGES, math.ceil(df.count() / size))
    if n < 2:
        return []
    found = df.select(F.percentile_approx(seq, [k / n for k in range(1, n)], 4 * n)).first()[0]
    return sorted(set(found or []))


def in_ranges(df: DataFrame, seq: str, bounds: list) -> DataFrame:
    """df with __part, the range of seq that a row lies in; ranges ascend with seq. Null stands first."""
    wide = math.isqrt(len(bounds)) + 1  # two short searches in place of one long
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(seq)))
    coarse = F.size(F.filter(F.array(*(F.lit(g[-1]) for g in groups)), lambda b: b < F.col(seq)))
    fine = below(F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in [*groups, groups[-1]])), coarse + 1))
    return df.withColumn("__part", F.when(F.col(seq).isNull(), -1).when(coarse == len(groups), len(bounds)).otherwise(coarse * wide + fine))


def _bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size for: so few bytes are one range, and need no counting."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> bool:
    """Whether df is one range by what is known of its size."""
    return _bytes(df) <= 16 * RANGE


def _same(keys: list[str], start: Column | None = None) -> Column:
    """Whether each key equals the column of its name after two underscores, null as well."""
    out = F.lit(True) if start is None else start
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def _long(df: DataFrame, keys: list[str], size: int) -> DataFrame | None:
    """The keys of more than size rows, each after two underscores, and __long; so few that they are broadcast. None if there are none."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size)
    found = checkpointed(found.select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__long")))
    return None if found.isEmpty() else found


def _running(df: DataFrame, keys: list[str], seq: str, ends: Column, before: Column, here: Column, name: str, together, size: int | None) -> DataFrame:  # noqa: ANN001
    """A running value: of a range alone it is ends, of the ranges before it before, and of the rows in it here.

    Only keys of more rows than a range are cut into ranges; any other key is one window.
    """
    known = size is None and small(df)
    long = None if known or not keys else _long(df, keys, size or RANGE)
    if known or (keys and long is None):
        bounds = []
    elif keys:
        df = df.join(F.broadcast(long), _same(keys), "left").drop(*(f"__{k}" for k in keys))
        bounds = _bounds(df.where("__long"), seq, size or RANGE)
    else:
        bounds = _bounds(df, seq, size)
    if not bounds:
        return df.withColumn(name, together(here.over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(seq)), F.lit(None))).drop("__mark", "__long")
    df = in_ranges(df, seq, bounds)
    if keys:
        df = df.withColumn("__part", F.when(F.col("__long"), F.col("__part")))
    told = df.where("__part IS NOT NULL").groupBy(*keys, "__part").agg(ends.alias("__end"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__at"), before.over(earlier).alias("__before"))
    same = _same(keys, F.col("__part") == F.col("__at"))
    met = df.join(told, same, "left").drop(*(f"__{k}" for k in keys), "__at")
    return met.withColumn(name, together(here.over(Window.partitionBy(*keys, "__part").orderBy(seq)), F.col("__before"))).drop("__part", "__before", "__mark", "__long")


def carried(df: DataFrame, mark: Column, name: str, by: str | list[str] | None = None, seq: str = "seq", size: int | None = None) -> DataFrame:
    """df with a column: the last mark that is not null, so far by seq (among the rows of equal by)."""
    keys = [by] if isinstance(by, str) else by or []
    last = lambda c: F.last(c, ignorenulls=True)
    ends = F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col(seq)))
    return _running(df.withColumn("__mark", mark), keys, seq, ends, last("__end"), last("__mark"), name, F.coalesce, size)


def counted(df: DataFrame, mark: Column, name: str, by: str | list[str] | None = None, seq: str = "seq", size: int | None = None) -> DataFrame:
    """df with a column: how many rows before this one by seq (among the rows of equal by) have the mark. seq tells rows apart."""
    keys = [by] if isinstance(by, str) else by or []
    df = df.withColumn("__mark", F.coalesce(mark, F.lit(False)).cast("long"))
    return _running(df, keys, seq, F.sum("__mark"), F.sum("__end"), F.sum("__mark"), name, lambda here, before: here + F.coalesce(before, F.lit(0)) - F.col("__mark"), size)
