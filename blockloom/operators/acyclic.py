"""Depths and cycles of graphs of any size, as joins.

Nodes with one way in and one way out are left out first: each points to what is before it, pointers are doubled,
and a chain of any length is one edge with its length as weight. What is left is peeled: a node is done when
all that it waits for is. Nodes that never are done lie on cycles or behind them. Those behind are peeled from the other end,
and the rest falls into components: each takes the least name that reaches it, and of the nodes with one such
name those that reach it are one component.

Edges have src, dst and, if they like, weight (1 where it is missing): how much deeper dst is than src.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.common import checkpointed, dropped, written

#: Rounds after which what was found in all of them becomes one table.
MERGED_ROUNDS = 16
#: Names that a message tells.
NAMED = 10


class GraphError(ValueError):
    """A graph that is none: unknown names, names given twice, or a cycle."""


def steps(edges: DataFrame) -> DataFrame:
    """src, dst, weight of edges, each pair once."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    return edges.groupBy("src", "dst").agg(F.max(weight).alias("weight"))


def shortened(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges between the nodes that are no inner nodes of chains, and the inner nodes: name, head, first, weight, least, ring.

    head is the node before the chain, first the chain's first node, weight the way from the head. A chain that closes in
    itself is a ring: least is its least name. Edges have via, the first node of the chain that they stand for, or null.
    """
    ins, outs = (step.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("dst", "n_in"), ("src", "n_out")))
    middle = ins.join(outs, "name").where("n_in = 1 AND n_out = 1").select("name")
    hop = written(step.join(middle, step["dst"] == middle["name"]).select("name", F.col("src").alias("head"), F.col("name").alias("first"), "weight", F.col("name").alias("least"), F.lit(True).alias("ring")))
    n = hop.count()
    if not n:
        dropped(hop)
        return step.withColumn("via", F.lit(None).cast("string")), None
    for _ in range(math.ceil(math.log2(n)) + 1):
        before = hop.select(F.col("name").alias("at"), F.col("head").alias("b_head"), F.col("first").alias("b_first"), F.col("weight").alias("b_weight"), F.col("least").alias("b_least"))
        on = hop.where("ring").join(before, F.col("head") == F.col("at"), "left")
        on = on.select("name", F.coalesce("b_head", "head").alias("head"), F.coalesce("b_first", "first").alias("first"), (F.col("weight") + F.coalesce("b_weight", F.lit(0))).alias("weight"), F.least("least", F.coalesce("b_least", "least")).alias("least"), F.col("at").isNotNull().alias("ring"))
        old, hop = hop, written(on.unionByName(hop.where("NOT ring")))
        dropped(old)
        if hop.where("ring").isEmpty():
            break
    inner = hop.select(F.col("name").alias("src"), "head", F.col("first").alias("via"), F.col("weight").alias("before"))
    outer = step.join(hop.select(F.col("name").alias("dst")), "dst", "left_anti").join(inner, "src", "left")
    return outer.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("weight") + F.coalesce("before", F.lit(0))).alias("weight"), "via"), hop


def peeled(names: DataFrame, step: DataFrame) -> DataFrame:
    """name, depth of the nodes that are done in the end: those that no cycle leads to. A round is a job over what was newly done and what it leads to.

    step has src, dst and weight, each pair once.
    """
    need = step.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("needed"))
    step, need = written(step), written(need)
    front = checkpointed(names.join(need, "name", "left_anti").select("name", F.lit(0).alias("depth")))
    out, partly, n = front, None, 0
    while not front.isEmpty():
        got = front.join(step, F.col("name") == F.col("src")).select(F.col("dst").alias("name"), F.lit(1).alias("k"), (F.col("depth") + F.col("weight")).alias("depth"))
        got = got if partly is None else got.unionByName(partly)
        now = checkpointed(got.groupBy("name").agg(F.sum("k").alias("k"), F.max("depth").alias("depth")).join(need, "name"))
        front, partly = now.where("k = needed").select("name", "depth"), now.where("k < needed").select("name", F.col("k").cast("int").alias("k"), "depth")
        out, n = out.unionByName(front), n + 1
        if n % MERGED_ROUNDS == 0:
            out = checkpointed(out)
    out = written(out)
    dropped(step, need)
    return out


def _between(step: DataFrame) -> DataFrame:
    """The edges that lie on cycles or on ways from one to another: what peeling from both ends leaves."""
    for a, b in (("src", "dst"), ("dst", "src")):
        if step.isEmpty():
            return step
        way = step.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(0).alias("weight"))
        done = peeled(step.select(F.explode(F.array("src", "dst")).alias("name")).distinct(), way)
        old, step = step, written(step.join(done.select(F.col("name").alias("src")), "src", "left_anti").join(done.select(F.col("name").alias("dst")), "dst", "left_anti"))
        dropped(done, old)
    return step


def _reached(names: DataFrame, step: DataFrame) -> DataFrame:
    """name, least: the least name from which a node is reached, its own included. Only what changed goes on, in one job a round."""
    held = checkpointed(names.select("name", F.col("name").alias("least"), F.lit(True).alias("fresh")))
    while not held.where("fresh").isEmpty():
        new = held.where("fresh").join(step, F.col("name") == F.col("src")).groupBy(F.col("dst").alias("name")).agg(F.min("least").alias("least"))
        both = held.select("name", "least", F.col("least").alias("was")).unionByName(new.withColumn("was", F.lit(None).cast("string")))
        least, was = F.min("least"), F.max("was")
        held = checkpointed(both.groupBy("name").agg(least.alias("least"), (least < was).alias("fresh")))
    return held.select("name", "least")


def components(step: DataFrame) -> DataFrame:
    """name, cycle: of every node on a cycle the least name of its strongly connected component. No edge may lead to its own node."""
    found, step = None, _between(written(step.select("src", "dst").distinct()))
    while not step.isEmpty():
        color = _reached(step.select(F.explode(F.array("src", "dst")).alias("name")).distinct(), step)
        a, b = (color.select(F.col("name").alias(c), F.col("least").alias(k)) for c, k in (("src", "x"), ("dst", "y")))
        inside = checkpointed(step.join(a, "src").join(b, "dst").where("x = y").select("src", "dst", F.col("x").alias("cycle")))
        back = checkpointed(color.where("name = least").select("name", F.col("least").alias("cycle")))
        front, n = back, 0
        while not front.isEmpty():
            new = front.join(inside.select(F.col("dst").alias("name"), "src"), "name").select(F.col("src").alias("name"), "cycle").distinct()
            front, n = checkpointed(new.join(back, "name", "left_anti")), n + 1
            back = back.unionByName(front)
            if n % MERGED_ROUNDS == 0:
                back = checkpointed(back)
        back = checkpointed(back)
        many = back.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cycle")
        whole = back.join(many, "cycle").select("name", "cycle")
        found = checkpointed(whole if found is None else found.unionByName(whole))
        rest = step.join(back.select(F.col("name").alias("src")), "src", "left_anti").join(back.select(F.col("name").alias("dst")), "dst", "left_anti")
        rest = written(rest)
        dropped(step)
        step = _between(rest)
    found = found if found is not None else checkpointed(step.select(F.col("src").alias("name"), F.col("dst").alias("cycle")))
    dropped(step)
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """name, cycle: every node that a way leads from and back to, with the least name of those it shares such ways with.

    A node with an edge to itself is a cycle, if it lies on no other.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("name")).distinct()
    short, inner = shortened(steps(edges.where("src <> dst")))
    found = components(short.where("src <> dst"))
    if inner is not None:
        # a chain lies on a cycle if its ends are one node or share one; the least name may lie in a chain
        ends = short.where("via IS NOT NULL").join(found.select(F.col("name").alias("src"), "cycle"), "src", "left").join(found.select(F.col("name").alias("dst"), F.col("cycle").alias("to")), "dst", "left")
        ends = ends.where("src = dst OR cycle = to").select(F.col("via").alias("first"), F.coalesce("cycle", "src").alias("cycle"), "src")
        chains = inner.where("NOT ring").join(ends.select("first", "cycle"), "first").select("name", "cycle")
        heads = ends.where("cycle = src").select(F.col("src").alias("name"), "cycle").distinct().join(found.select("name"), "name", "left_anti")
        named = found.unionByName(chains).unionByName(heads)
        least = named.groupBy("cycle").agg(F.min("name").alias("least"))
        old, found = inner, written(named.join(least, "cycle").select("name", F.col("least").alias("cycle")).unionByName(inner.where("ring").select("name", F.col("least").alias("cycle"))))
        dropped(old)
    return found.unionByName(loops.join(found.select("name"), "name", "left_anti").select("name", F.col("name").alias("cycle")))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, depth: the longest way, by weight, from a node that nothing leads to. Raises where there is a cycle, and names its nodes."""
    short, inner = shortened(steps(edges))
    names = nodes.select("name") if inner is None else nodes.select("name").join(inner.select("name"), "name", "left_anti")
    out = peeled(names, short if inner is None else steps(short))
    if inner is not None:
        chains = inner.where("NOT ring").join(out.select(F.col("name").alias("head"), "depth"), "head").select("name", (F.col("depth") + F.col("weight")).alias("depth"))
        done, out = out, written(out.unionByName(chains))
        dropped(done, inner)
    if out.count() < nodes.count():
        raise GraphError(f"a cycle among {named_cycle(edges)}")
    return out.select("name", F.col("depth").cast("int").alias("depth"))


def named_cycle(edges: DataFrame) -> str:
    """The names of the cycle with the least name; the first NAMED of them."""
    found = cycles(edges)
    first = found.agg(F.min("cycle")).first()[0]
    names = [r[0] for r in found.where(F.col("cycle") == first).select("name").orderBy("name").limit(NAMED + 1).collect()]
    return ", ".join(names[:NAMED]) + (", …" if len(names) > NAMED else "")
