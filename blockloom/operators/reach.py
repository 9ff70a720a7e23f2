"""An index that answers "does a depend on b" for many pairs at once, without a table of all pairs.

Every node hangs on its primary parent, so the nodes are a forest; a walk around each tree gives a node an interval of places that
holds those of all below it. What a node reaches by the other edges is a few intervals more, its hops: intervals of one
forest are nested or apart, so only the outermost are kept. A question is one look at an interval and one at the hops.

The walk's places are found by doubling pointers along it, ancestors by doubling pointers to parents: rounds grow with the
logarithm of the number of nodes and of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators import graph
from blockloom.operators.common import checkpointed, dropped, written
from blockloom.operators.graph import closure, primary_parents
from blockloom.operators.scans import numbered


def intervals(names: DataFrame, parents: DataFrame) -> DataFrame:
    """name, root, low, high of a forest parents(name, parent): a is below b, or b, if their roots are one and a.low is between b.low and b.high."""
    order = numbered(parents, "parent", "name")
    after = order.select("parent", (F.col("number") - 1).alias("number"), F.col("name").alias("sibling"))
    tree = names.select("name").join(order.join(after, ["parent", "number"], "left").select("name", "parent", "sibling"), "name", "left")
    tree = tree.join(parents.groupBy(F.col("parent").alias("name")).agg(F.min("name").alias("child")), "name", "left")
    arc = lambda name, up: F.struct(name.alias("name"), F.lit(up).alias("up"))
    down = F.when(F.col("child").isNotNull(), arc(F.col("child"), False)).otherwise(arc(F.col("name"), True))
    up = F.when(F.col("sibling").isNotNull(), arc(F.col("sibling"), False)).when(F.col("parent").isNotNull(), arc(F.col("parent"), True))
    each = F.array(F.struct(arc(F.col("name"), False).alias("arc"), down.alias("to")), F.struct(arc(F.col("name"), True).alias("arc"), up.alias("to")))
    way = tree.select(F.inline(each)).withColumn("n", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")).withColumn("root", F.when(F.col("to").isNull(), F.col("arc.name")))
    way = written(way)
    while not way.where("to IS NOT NULL").isEmpty():
        on = way.select(F.col("arc").alias("at"), F.col("to").alias("then"), F.col("n").alias("more"), F.col("root").alias("end"))
        far = way.where("to IS NOT NULL").join(on, F.col("to") == F.col("at")).select("arc", F.col("then").alias("to"), (F.col("n") + F.col("more")).alias("n"), F.col("end").alias("root"))
        old, way = way, written(way.where("to IS NULL").unionByName(far))
        dropped(old)
    places = written(way.groupBy("arc.name", "root").agg(F.min(F.when(~F.col("arc.up"), -F.col("n"))).alias("low"), F.max(F.when(F.col("arc.up"), -F.col("n"))).alias("high")))
    dropped(way)
    return places


def ancestors(start: DataFrame, parents: DataFrame) -> DataFrame:
    """name, above: of each start(name) itself and all above it in the forest."""
    found, jump = written(start.select("name", F.col("name").alias("above")).distinct()), written(parents.select("name", "parent"))
    while not jump.isEmpty():
        more = found.join(jump.select(F.col("name").alias("above"), "parent"), "above").select("name", F.col("parent").alias("above"))
        old, found = found, written(found.unionByName(more))
        before, jump = jump, written(jump.join(jump.select(F.col("name").alias("parent"), F.col("parent").alias("far")), "parent").select("name", F.col("far").alias("parent")))
        dropped(old, before)
    dropped(jump)
    return found


def reach_index(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """places(name, root, low, high) and hops(name, root, low, high) of an acyclic graph; src and dst of all edges are nodes.

    hops are the outermost intervals that a node reaches by edges outside the forest. Their number is bounded by that of such edges times the depth of the forest,
    and is small where most ways follow primary parents.
    """
    parents = checkpointed(primary_parents(edges))
    places = intervals(nodes, parents)
    inside = lambda a, b: (F.col(f"{a}.root") == F.col(f"{b}.root")) & F.col(f"{a}.low").between(F.col(f"{b}.low"), F.col(f"{b}.high"))
    ways = edges.select("src", "dst").distinct().join(parents.select(F.col("name").alias("dst"), F.col("parent").alias("src")), ["src", "dst"], "left_anti")
    ways = ways.join(places.alias("s"), F.col("src") == F.col("s.name")).join(places.alias("d"), F.col("dst") == F.col("d.name")).where(~inside("d", "s")).select("src", "dst")
    ways = written(ways)  # without those that the forest has anyway
    above = ancestors(ways.select(F.col("src").alias("name")), parents)
    led = above.join(ways.withColumnRenamed("src", "name"), "name").select(F.col("above").alias("src"), "dst").distinct()
    led = written(led)  # by a way below it or its own
    on = led.join(ways.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    then = closure(on, ways.select(F.col("dst").alias("name")).distinct(), down=True)
    reached = led.join(then.select(F.col("root").alias("dst"), F.col("name").alias("to")), "dst").select(F.col("src").alias("name"), "to").distinct()
    found = reached.alias("r").join(places.alias("d"), F.col("r.to") == F.col("d.name")).join(places.alias("s"), F.col("r.name") == F.col("s.name")).where(~inside("d", "s"))
    found = found.select("r.name", "d.root", "d.low", "d.high")
    outer = Window.partitionBy("name", "root").orderBy("low", F.col("high").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hops = written(found.withColumn("before", F.max("high").over(outer)).where("before IS NULL OR high > before").drop("before"))
    dropped(ways, above, led)
    return places, hops


def _shared(asked: DataFrame, tasks: int) -> DataFrame | None:
    """name, parts of the names in more questions than a task gets, so few that they are broadcast. None if there are none."""
    found = asked.select(F.explode(F.array("a", "b")).alias("name")).repartition(tasks, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = checkpointed(found.where(F.col("n") > graph.CELL).select("name", F.ceil(F.col("n") / graph.CELL).alias("parts")))
    return None if found.isEmpty() else F.broadcast(found)


def _parted(df: DataFrame, by: str, shared: DataFrame | None, part: Column) -> DataFrame:
    """df with __part, made of parts, which is 1 for names that are not shared; df as it is where none are."""
    if shared is None:
        return df
    cut = shared.select(F.col("name").alias("__shared"), "parts")
    df = df.join(cut, F.col(by).eqNullSafe(F.col("__shared")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return df.withColumn("__part", part).drop("__shared", "parts")


def depends(index: tuple[DataFrame, DataFrame], questions: DataFrame) -> DataFrame:
    """questions(a, b) with depends: whether a is b or a way leads from b to a. Null where one of them is no node; other columns stay.

    Questions are dealt to tasks of about CELL rows, whatever the session's number of partitions; a name in more of them is shared by tasks.
    """
    places, hops = index
    asked = written(questions)
    tasks = graph.tasks_of(asked.sparkSession, asked.count())
    shared = _shared(asked, tasks)
    if shared is not None:
        asked = asked.withColumn("__row", F.monotonically_increasing_id())
    part = [] if shared is None else ["__part"]
    asks = lambda df, by: _parted(df, by, shared, F.pmod("__row", "parts"))
    each = lambda df, by: _parted(df, by, shared, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = lambda df, keys: df.repartition(tasks, *keys)
    a = places.select(F.col("name").alias("a"), F.col("root").alias("__of"), F.col("low").alias("__at"))
    b = places.select(F.col("name").alias("b"), F.col("root").alias("__root"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    hop = hops.select(F.col("name").alias("b"), F.col("root").alias("__of"), F.col("low").alias("__from"), F.col("high").alias("__until"))
    on_a, on_b, on_hop = ["a", *part], ["b", *part], ["b", *part, "__of"]
    met = dealt(asks(asked, "a"), on_a).join(dealt(each(a, "a"), on_a), on_a, "left").drop(*part)
    met = dealt(asks(met, "b"), on_b).join(dealt(each(b, "b"), on_b), on_b, "left")
    # outermost intervals are apart, so a question meets one at most
    met, hop = dealt(met, on_hop).alias("m"), dealt(each(hop, "b"), on_hop).alias("h")
    same = [F.col(f"m.{c}") == F.col(f"h.{c}") for c in on_hop]
    met = met.join(hop, [*same, F.col("__at").between(F.col("__from"), F.col("__until"))], "left")
    below = (F.col("m.__of") == F.col("__root")) & F.col("__at").between(F.col("__low"), F.col("__high"))
    known = F.col("m.__of").isNotNull() & F.col("__root").isNotNull()
    return met.select(*(F.col(f"m.{c}") for c in questions.columns), F.when(known, below | F.col("h.b").isNotNull()).alias("depends"))
