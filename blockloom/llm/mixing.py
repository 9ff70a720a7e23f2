"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by the set of sources they belong to. The flow takes each set's words, at a cost for
each further repetition that grows, to the quotas of its sources. Its result says how many words of each set
are taken; whole repetitions go to all its documents and the rest, in the order of a seeded hash, to each document
that fits into what is left. When none fits any more, the one that comes nearest closes the gap, if it does any good.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import checkpointed, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: What the first, second, ... copy of a document costs; it must grow.
COPY_COST = (0, 1, 3)
#: Sets of sources that the driver holds at most: they are as many as configured sources and overlaps, not as documents.
MAX_PATTERNS = 200_000
_BITS = 12
#: Documents up to which an edge's bucket is put in order, and repeated ids up to which their sizes are broadcast.
ORDERED_ROWS, BROADCAST_IDS = 100_000, 200_000


def targets(sizes: dict, weights: dict, total: float, times: int = len(COPY_COST)) -> dict:
    """Each source's share of total by weight; what exceeds times its size goes to the others by weight, until none exceeds."""
    out, free, left = {}, set(sizes), float(total)
    while free:
        whole = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / whole > times * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / whole for s in free}
        out |= {s: float(times * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def cycled_weights(sources: list, cycle: tuple[int, ...] = (1, 2, 3)) -> dict:
    """Weights by rank: sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sources)
    return {s: cycle[k % len(cycle)] for k, s in enumerate(ordered)}


def min_cost_flow(words: dict[tuple, int], quotas: dict, costs: tuple[int, ...] = COPY_COST) -> dict[tuple[tuple, object], int]:
    """Words that go from each pattern (a tuple of sources) to each of its sources.

    As much of the quotas as can be is met, at the least cost: words of a pattern that are taken for the k-th
    time cost costs[k]. By successive cheapest paths, in each group of patterns that share sources alone.
    """
    group = {s: {s} for s in quotas}
    for pattern in words:
        joined = set().union(*(group[s] for s in pattern)) if pattern else set()
        for s in joined:
            group[s] = joined
    out: dict = {}
    done = set()
    by_group = defaultdict(list)
    for p in words:
        if p:
            by_group[id(group[p[0]])].append(p)
    for s in quotas:
        if id(group[s]) not in done:
            done.add(id(group[s]))
            out |= _flow(by_group[id(group[s])], words, {x: quotas[x] for x in group[s]}, costs)
    return out


def _flow(patterns: list[tuple], words: dict[tuple, int], quotas: dict, costs: tuple[int, ...]) -> dict:
    """Cheapest paths from the patterns' words to the quotas until none is left; an arc's cost is that of the copy that it stands for."""
    start, end = ("start",), ("end",)
    arcs: list[list] = []  # head, room, cost; an arc's reverse is its neighbour
    leaving = defaultdict(list)

    def arc(a: tuple, b: tuple, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            leaving[x].append(len(arcs))
            arcs.append([y, r, c])

    for p in patterns:
        for c in costs:
            arc(start, ("pattern", p), words[p], c)
        for s in p:
            arc(("pattern", p), ("source", s), sum(quotas.values()), 0)
    for s, q in quotas.items():
        arc(("source", s), end, q, 0)
    while True:
        cost, came, queue = {start: 0}, {}, deque([start])
        while queue:
            a = queue.popleft()
            for k in leaving[a]:
                b, room, c = arcs[k]
                if room and cost[a] + c < cost.get(b, math.inf):
                    cost[b], came[b] = cost[a] + c, k
                    queue.append(b)
        if end not in cost:
            break
        path, at = [], end
        while at != start:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        most = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= most
            arcs[k ^ 1][1] += most
    return {(p, arcs[k][0][1]): arcs[k ^ 1][1] for p in patterns for k in leaving["pattern", p] if arcs[k][0][0] == "source" and arcs[k ^ 1][1]}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """docs with size, source_size, target and taken; keep names the columns of docs to return (default: all).

    source_col is a string, or an array of strings for sources that overlap. size is a document's number of
    words (null: 0), source_size the words of its source's documents, target the words that its source gets
    (of overlapping sources: sums), taken the words that the mix takes of the document, a multiple of its
    size of at most 3 times. Null is a source of its own, after all others; weights default to 1, 2, 3 by rank.
    Rows alike in id are taken alike, documents without words never. The choice depends on seed and id alone,
    not on partitions. An empty table gives an empty result. Columns of these four names are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken")]
    many = dict(docs.dtypes)[source_col].startswith("array")
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(source_col), F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(source_col).cast("string"))
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    sized = docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names) if c != text_col), *([F.col(text_col).alias("_text")] if text_col in names else []), pattern.alias("pattern"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("h"), F.col(id_col).alias("id"))
    if text_col in names:  # texts are not written again; their words are counted once more at the end
        narrow = checkpointed(sized.select("pattern", "size", "h", "id"))
    else:
        sized = checkpointed(sized)
        narrow = sized.select("pattern", "size", "h", "id")

    totals = narrow.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} sets of sources; merge small sources first")
    words = {tuple(r["pattern"]): r["words"] for r in totals}
    of_source: dict = defaultdict(int)
    for p, n in words.items():
        for s in p:
            of_source[s] += n
    weights = weights or cycled_weights(list(of_source))
    goal = targets(of_source, {s: weights[s] for s in of_source}, sum(words.values()))
    flow = min_cost_flow(words, {s: round(t) for s, t in goal.items()})
    taken: dict = defaultdict(int)
    for (p, _), n in flow.items():
        taken[p] += n
    spark = docs.sparkSession
    rows = [(list(p), sum(of_source[s] for s in p), float(sum(goal[s] for s in p)), taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in words.items()]
    plan = F.broadcast(checkpointed(spark.createDataFrame(rows, "pattern array<string>, source_size long, target double, times long, rest long")))  # a row for each set of sources

    own = F.struct("h", F.col("id").cast("string").alias("i"))
    units = narrow.where("size > 0").join(plan.select("pattern", "rest").where("rest > 0"), "pattern").groupBy("pattern", "rest", own.alias("hi")).agg(F.sum("size").alias("unit"), F.count(F.lit(1)).alias("rows"))
    units = checkpointed(units)  # rows alike in id are one
    chosen = F.broadcast(_chosen(units).withColumnRenamed("pattern", "cp"))
    limits = plan.join(chosen, F.col("pattern") == F.col("cp"), "left").drop("cp")
    out = sized.join(F.broadcast(limits.withColumnRenamed("pattern", "p")), F.col("pattern") == F.col("p"), "left").withColumn("hi", own)
    many_rows = units.where("rows > 1").select(F.col("pattern").alias("up"), F.col("hi").alias("uh"), "unit")
    if n := many_rows.count():
        out = out.join(F.broadcast(many_rows) if n <= BROADCAST_IDS else many_rows, (F.col("pattern") == F.col("up")) & (F.col("hi") == F.col("uh")), "left").withColumn("unit", F.coalesce("unit", "size"))
    else:
        out = out.withColumn("unit", F.col("size"))
    back = [F.col("_text" if c == text_col else f"_{k}").alias(c) for k, c in enumerate(names)]
    out = out.withColumn("_taken", F.col("size") * (F.col("times") + _more().cast("long")))  # before names of docs come back
    return out.select(*back, "size", "source_size", "target", F.col("_taken").alias("taken"))


def _more() -> Column:
    """Whether hi of size unit gets one copy more by its pattern's rounds and pick."""
    inside = lambda x: (x["after"].isNull() | (F.col("hi") > x["after"])) & (x["end"].isNull() | (F.col("hi") < x["end"])) & (F.col("unit") <= x["most"])
    return F.coalesce(F.exists("rounds", inside), F.lit(False)) | F.coalesce(F.col("hi") == F.col("pick"), F.lit(False))


def _chosen(units: DataFrame) -> DataFrame:
    """pattern, rounds, pick: which documents get one copy more, so that their words come as near to rest as they can.

    In a round all documents between after and end that are no longer than most are taken; end is the first
    that no longer fits. It and all that are longer than what is then left are passed over for good. pick is the
    document that overshoots least, if that is nearer to rest than to go without.
    """
    kinds = "array<struct<after: struct<h: bigint, i: string>, end: struct<h: bigint, i: string>, most: bigint>>"
    nowhere = F.lit(None).cast("struct<h: bigint, i: string>")
    state = checkpointed(units.select("pattern", "rest").distinct().select("pattern", F.col("rest").alias("gap"), nowhere.alias("after"), F.array().cast(kinds).alias("rounds"), F.lit(True).alias("open")))  # a row for each set of sources
    while state.where("open").limit(1).count():
        free = units.drop("rest").join(F.broadcast(state.where("open").select("pattern", "gap", "after")), "pattern").where((F.col("unit") <= F.col("gap")) & (F.col("after").isNull() | (F.col("hi") > F.col("after"))))
        edge = _first_not_fitting(free).withColumnRenamed("pattern", "ep")
        after = state.join(F.broadcast(edge), F.col("pattern") == F.col("ep"), "left")
        rounds = F.when(F.col("ep").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(F.struct("after", "end", F.col("gap").alias("most")))))
        state = checkpointed(after.select("pattern", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.col("end").alias("after"), rounds.alias("rounds"), F.col("end").isNotNull().alias("open")))
    near = units.drop("rest").join(F.broadcast(state.select("pattern", "gap", "rounds").withColumn("pick", nowhere)), "pattern").where((F.col("unit") < 2 * F.col("gap")) & ~_more())
    pick = near.groupBy("pattern").agg(F.min(F.struct("unit", "hi")).alias("m")).select(F.col("pattern").alias("pp"), F.col("m.hi").alias("pick"))
    return checkpointed(state.join(F.broadcast(pick), F.col("pattern") == F.col("pp"), "left").select("pattern", "rounds", "pick"))


def _first_not_fitting(free: DataFrame) -> DataFrame:
    """pattern, end, used: the least hi with which documents pass gap, and the words before it; no end if all fit. A pattern without documents is absent.

    The hashes' first bits narrow it to one bucket of documents for each pattern and then to a bucket of that one,
    by sums; only the few documents there are put in order.
    """
    left, whole = free.select("pattern", "gap", "hi", "unit").withColumn("before", F.lit(0).cast("long")), None
    for level in range(2):
        bucket = F.shiftright("hi.h", 64 - _BITS * (level + 1))
        sums = left.groupBy("pattern", "gap", "before", bucket.alias("bucket")).agg(F.sum("unit").alias("words"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")))
        edge = upto.groupBy("pattern").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("sofar")))).alias("e"), F.max("upto").alias("used"))
        edge = checkpointed(edge)  # a row for each set of sources
        whole = edge.where("e IS NULL").select("pattern", "used") if level == 0 else whole
        edge = F.broadcast(edge.where("e IS NOT NULL").select(F.col("pattern").alias("ep"), F.col("e.bucket").alias("eb"), F.col("e.sofar").alias("sofar")))
        left = checkpointed(left.join(edge, (F.col("pattern") == F.col("ep")) & (bucket == F.col("eb"))).withColumn("before", F.col("sofar")).drop("ep", "eb", "sofar"))
        if left.count() <= ORDERED_ROWS:
            break
    run = Window.partitionBy("pattern").orderBy("hi").rowsBetween(Window.unboundedPreceding, 0)
    near = left.withColumn("upto", F.col("before") + F.sum("unit").over(run))
    passed = F.col("upto") > F.col("gap")
    ends = near.groupBy("pattern").agg(F.min(F.when(passed, F.col("hi"))).alias("end"), F.coalesce(F.max(F.when(~passed, F.col("upto"))), F.min("before")).alias("used"))
    return checkpointed(ends.unionByName(whole, allowMissingColumns=True))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed rows, each as often as it is taken, without the mix's own columns."""
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0)).cast("int")
    names = [F.col(f"`{c}`") for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    (copy,) = fresh(mixed, "copy")
    return mixed.where(times > 0).select("*", F.explode(F.sequence(F.lit(1), times)).alias(copy)).select(*names)
