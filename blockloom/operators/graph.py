"""Dependency graphs as tables: nodes(name, phase, ...) and edges(src, dst, kind), dst depending on src.

kind is dependency (contents count) or ordering (order alone). Closures run as joins to a fixpoint over
checkpointed frontiers; nothing but counts comes to the driver, except in topological_order, whose
result is a list by nature.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.acyclic import GraphError, cycles, depths
from blockloom.operators.common import checkpointed, dropped, ready_to_checkpoint, written
from blockloom.operators.scans import numbered

__all__ = ["GraphError", "checkpointed", "cycles", "depths", "ready_to_checkpoint"]

DEPENDENCY, ORDERING = "dependency", "ordering"


#: Rounds after which what was found in all of them becomes one checkpoint.
MERGED_ROUNDS = 16
#: Rows that a task of a closure's round makes, about, and the tasks of a round at most.
CELL, MOST_TASKS = 1 << 18, 10_000


def tasks_of(spark: SparkSession, rows: int) -> int:
    """As many tasks as rows need, of about CELL each, but no fewer than run at once."""
    return max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, math.ceil(rows / CELL)))


def check_nodes(nodes: DataFrame) -> None:
    twice = nodes.groupBy("name").count().where("count > 1").select("name").limit(3).collect()
    if twice:
        raise GraphError(f"given twice: {', '.join(r[0] for r in twice)}")


def check_edges(nodes: DataFrame, edges: DataFrame) -> None:
    """Both ends of every edge must be nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    lost = ends.join(nodes.select("name"), "name", "left_anti").limit(3).collect()
    if lost:
        raise GraphError(f"unknown: {', '.join(r[0] for r in lost)}")


def check_targets(nodes: DataFrame, targets: DataFrame) -> None:
    """targets(target, block): a block's name up to the first dot must be a node's, or a module instance's."""
    lost = targets.select(F.substring_index("block", ".", 1).alias("name")).distinct().join(nodes.select("name"), "name", "left_anti").limit(3).collect()
    if lost:
        raise GraphError(f"unknown in a target: {', '.join(r[0] for r in lost)}")


def phase_edges(nodes: DataFrame) -> DataFrame:
    """Ordering edges from every node of a phase to those of later ones: pre, default, post."""
    rank = F.when(F.col("phase") == "pre", 0).when(F.col("phase") == "post", 2).otherwise(1)
    ranked = nodes.select("name", rank.alias("rank"))
    later = F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda r: r > F.col("rank")))
    before = ranked.select(F.col("name").alias("src"), later.alias("rank"))  # an equi-join in place of rank < rank
    return before.join(ranked.withColumnRenamed("name", "dst"), "rank").select("src", "dst", F.lit(ORDERING).alias("kind"))


#: Names of the two nodes that stand between the phases; no block's name has such a character.
BARRIERS = ("\x01pre", "\x01default")


def phase_barriers(nodes: DataFrame) -> DataFrame:
    """What phase_edges says by two nodes between the phases, in two edges a node: pre > first > default > second > post.

    Edges have a weight, 0 behind a barrier, so that depths are those of the pairs; closures and orders have the
    barriers' names besides, which without_barriers leaves out.
    """
    first, second = map(F.lit, BARRIERS)
    phase, name = F.coalesce("phase", F.lit("default")), F.col("name")
    edge = lambda a, b, weight: F.struct(a.alias("src"), b.alias("dst"), F.lit(weight).alias("weight"))
    ways = F.when(phase == "pre", F.array(edge(name, first, 1))).when(phase == "post", F.array(edge(second, name, 0))).otherwise(F.array(edge(first, name, 0), edge(name, second, 1)))
    between = nodes.sparkSession.createDataFrame([(*BARRIERS, 0)], "src string, dst string, weight int")
    return nodes.select(F.inline(ways)).unionByName(between).withColumn("kind", F.lit(ORDERING))


def barrier_nodes(nodes: DataFrame) -> DataFrame:
    """The names of nodes and of the barriers."""
    return nodes.select("name").unionByName(nodes.sparkSession.createDataFrame([(b,) for b in BARRIERS], "name string"))


def without_barriers(df: DataFrame) -> DataFrame:
    """df without the rows in which a barrier is name or root."""
    for c in {"name", "root"} & set(df.columns):
        df = df.where(~F.col(c).isin(*BARRIERS))
    return df


def order_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, depth, number: an order with parents first, by depth and name, numbered from 1 without a list on the driver."""
    return numbered(depths(nodes, edges), "depth", "name")


def closure(edges: DataFrame, start: DataFrame | None = None, down: bool = False, most: int = 10_000) -> DataFrame:
    """root, name: what each start(name) depends on (or, down, what depends on it), itself included.

    Without start, of every node that has edges. A round joins the newest pairs to the edges and keeps what is
    new, so diamonds are not walked twice and cycles end. A name that many reach, or that leads to many, is dealt to many tasks.
    """
    a, b = ("src", "dst") if down else ("dst", "src")
    if start is None:
        start = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    step = written(edges.select(F.col(a).alias("name"), F.col(b).alias("next")).distinct())
    fans = step.groupBy("name").agg(F.count(F.lit(1)).alias("fan"))
    widest = fans.agg(F.max("fan")).first()[0] or 0
    front = checkpointed(start.select(F.col("name").alias("root"), "name").distinct())
    found, rows = front, front.count()
    for n in range(most):
        if rows * widest <= CELL:
            new = front.join(step, "name").select("root", F.col("next").alias("name")).distinct()
        else:
            new = _dealt(front, step, fans).repartition("root", "name").distinct()
        front = checkpointed(new.join(found, ["root", "name"], "left_anti"))
        rows = front.count()
        if not rows:
            dropped(step)
            return found
        found = found.unionByName(front)
        if (n + 1) % MERGED_ROUNDS == 0:
            found = checkpointed(found)
    raise GraphError(f"the graph is deeper than {most}")


def _dealt(front: DataFrame, step: DataFrame, fans: DataFrame) -> DataFrame:
    """root, name: front(root, name) joined to step(name, next), in tasks of about CELL rows.

    A name that makes more rows is cut into cells: its roots are dealt to parts, its next names to pieces, and each
    part meets each piece.
    """
    load = front.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(fans, "name").withColumn("made", F.col("n") * F.col("fan"))
    heavy = F.col("made") > CELL
    made, many = load.agg(F.sum("made"), F.count_if(heavy)).first()
    tasks = max(1, min(MOST_TASKS, math.ceil((made or 0) / CELL)))
    if not many:
        met = front.repartition(tasks, "name").join(step.repartition(tasks, "name"), "name")
        return met.select("root", F.col("next").alias("name"))
    roots = F.least("n", F.lit(CELL) / F.least("fan", F.lit(math.isqrt(CELL))))  # of a cell
    cut = load.where(heavy).select("name", F.ceil(F.col("n") / roots).alias("parts"), F.ceil(F.col("fan") * roots / CELL).alias("pieces"))
    cut = F.broadcast(checkpointed(cut))  # as many rows as the round makes, by CELL, at most
    cells = lambda c: F.coalesce(c, F.lit(1))
    one = lambda c, of: F.pmod(F.xxhash64(c), cells(of))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), cells(c) - 1))
    left = front.join(cut, "name", "left").select("root", "name", one("root", F.col("parts")).alias("part"), each(F.col("pieces")).alias("piece"))
    right = step.join(cut, "name", "left").select("name", "next", one("next", F.col("pieces")).alias("piece"), each(F.col("parts")).alias("part"))
    keys = ["name", "part", "piece"]
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).select("root", F.col("next").alias("name"))


def transitive_dependencies(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start).select("name").distinct()


def transitive_dependents(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start, down=True).select("name").distinct()


def topological_order(names: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Names with parents first, and of those that are ready the least first. On the driver, for a pipeline's blocks."""
    waits, children = dict.fromkeys(names, 0), defaultdict(list)
    for src, dst in set(edges):
        waits[dst] += 1
        children[src].append(dst)
    ready, out = [n for n, k in waits.items() if not k], []
    heapq.heapify(ready)
    while ready:
        name = heapq.heappop(ready)
        out.append(name)
        for child in children[name]:
            waits[child] -= 1
            if not waits[child]:
                heapq.heappush(ready, child)
    if len(out) < len(waits):
        raise GraphError(f"a cycle among {', '.join(sorted(n for n, k in waits.items() if k))}")
    return out


def order_of(nodes: DataFrame, edges: DataFrame, start: DataFrame | None = None) -> list[str]:
    """The topological order, of all nodes or of what start depends on."""
    names = [r[0] for r in nodes.select("name").collect()]
    order = topological_order(names, [(r[0], r[1]) for r in edges.select("src", "dst").collect()])
    if start is None:
        return order
    wanted = {r[0] for r in transitive_dependencies(edges, start).collect()}
    return [n for n in order if n in wanted]


def target_members(nodes: DataFrame, targets: DataFrame, target: str | None = None) -> DataFrame:
    """target, name: the nodes that a target's members mean; one that is a module instance or a matrix stands for all its blocks.

    A name is met by each of its beginnings that a dot or a bracket ends, so members and names join by equality.
    """
    parts = F.split("name", r"(?=[.\[])")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))
    named = nodes.select("name", F.explode(beginnings).alias("block"))
    wanted = targets if target is None else targets.where(F.col("target") == target)
    return named.join(wanted.select("target", "block").distinct(), "block").select("target", "name").distinct()


def target_order(nodes: DataFrame, edges: DataFrame, targets: DataFrame, target: str) -> list[str]:
    """The order of what a target needs."""
    return order_of(nodes, edges, target_members(nodes, targets, target).select("name"))


def test_order(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """The order of what test nodes need."""
    return order_of(nodes, edges, nodes.where("kind = 'test'").select("name"))


def parents(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("dst") == name).select(F.col("src").alias("name")).distinct()


def content_parents(edges: DataFrame, name: str) -> DataFrame:
    return parents(edges.where(F.col("kind") == DEPENDENCY), name)


def children(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("src") == name).select(F.col("dst").alias("name")).distinct()


def primary_parents(edges: DataFrame) -> DataFrame:
    """name, parent: the least parent by dependency, and where there is none the least by ordering."""
    rank = F.when(F.col("kind") == DEPENDENCY, 0).otherwise(1)
    return edges.groupBy(F.col("dst").alias("name")).agg(F.min(F.struct(rank.alias("rank"), "src")).alias("p")).select("name", F.col("p.src").alias("parent"))


def tree(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> list[str]:
    """Lines of the tree of primary parents: each block with its type and the first line of its doc, if nodes has these, and its other parents by content."""
    primary = {r[0]: r[1] for r in primary_parents(edges).collect()}
    others = defaultdict(list)
    for r in edges.where(F.col("kind") == DEPENDENCY).select("src", "dst").distinct().collect():
        if primary.get(r[1]) != r[0]:
            others[r[1]].append(r[0])
    below, told = defaultdict(list), {}
    for r in nodes.select("name", *(c for c in ("provider", "resource", "doc") if c in nodes.columns)).collect():
        below[primary.get(r["name"])].append(r["name"])
        told[r["name"]] = r.asDict()
    out = []

    def walk(name: str, indent: int) -> None:
        first, *more = (told[name].get("doc") or "").splitlines() or [""]
        kind = f" ({told[name]['provider']}.{told[name]['resource']})" if told[name].get("provider") else ""
        doc = f" — {first}{'…' if more else ''}" if first else ""
        also = f" (also: {', '.join(sorted(others[name]))})" if others[name] else ""
        out.append("  " * indent + name + kind + doc + also)
        for child in sorted(below[name]):
            walk(child, indent + 1)

    for root in sorted(below[None]):
        walk(root, 0)
    return out


def layout(nodes: DataFrame, edges: DataFrame, sweeps: int = 6) -> dict[str, tuple[int, int]]:
    """A column and a row for every node: columns by longest path, rows by sweeps that move nodes to their neighbours' middle."""
    depth = {r[0]: r[1] for r in depths(nodes, edges).collect()}
    pairs = [(r[0], r[1]) for r in edges.select("src", "dst").distinct().collect()]
    columns = defaultdict(list)
    for name in sorted(depth):
        columns[depth[name]].append(name)
    near = defaultdict(list)
    for k, (src, dst) in enumerate(pairs):  # an edge over several columns gets a waypoint in each
        chain = [src, *(f"\0{k}:{d}" for d in range(depth[src] + 1, depth[dst])), dst]
        for d, way in enumerate(chain[1:-1], depth[src] + 1):
            columns[d].append(way)
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            near[a].append(b)
            near[b].append(a)
    row = {n: k for names in columns.values() for k, n in enumerate(names)}
    for sweep in range(sweeps):
        order = sorted(columns, reverse=sweep % 2 == 1)
        for d in order:
            middle = {n: sum(row[x] for x in near[n]) / len(near[n]) if near[n] else row[n] for n in columns[d]}
            columns[d].sort(key=lambda n: (middle[n], n))
            row |= {n: k for k, n in enumerate(columns[d])}
    return {n: (depth[n], row[n]) for n in depth}


def drawn(nodes: DataFrame, edges: DataFrame) -> str:
    """The layout as text: a line for each row, with a node's children after an arrow."""
    at = layout(nodes, edges)
    after = defaultdict(list)
    for r in edges.select("src", "dst").distinct().collect():
        after[r[0]].append(r[1])
    wide = max((len(n) for n in at), default=0) + 2
    out = []
    for name, (column, _) in sorted(at.items(), key=lambda x: (x[1][1], x[1][0])):
        arrow = f" -> {', '.join(sorted(after[name]))}" if after[name] else ""
        out.append(" " * (wide * column) + name + arrow)
    return "\n".join(out)
