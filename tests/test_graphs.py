"""Cycles, depths, barriers, numbers and running values against plain walks."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import acyclic, graph, hashing, scans
from blockloom.operators.reach import depends, reach_index


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs or [("", "")], "src string, dst string").where("src <> ''")


def reach_of(pairs):
    after = collections.defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    out = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        out[a] = seen
    return out


def components_of(pairs):
    reach = reach_of(pairs)
    return {a: min(b for b in reach if b in reach[a] and a in reach[b]) for a in reach if a in reach[a]}


#: Cycles that share nodes, that hang on each other, that are whole chains, and nodes with an edge to themselves.
KNOTS = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x"), ("y", "a"), ("x", "z"), ("z", "x"), ("q", "q"), ("b", "b"), ("m", "n"), ("n", "m"), ("z", "k"), ("k", "l")]


def test_cycles(spark):
    for pairs in (KNOTS, [(f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)]):
        assert {x.name: x.cycle for x in acyclic.cycles(edges_of(spark, pairs)).collect()} == components_of(pairs)
    assert acyclic.cycles(edges_of(spark, [])).count() == 0


def test_a_cycle_is_named(spark):
    names = spark.range(2000).selectExpr("concat('n', id) AS name")
    ways = spark.range(1, 2000).selectExpr("concat('n', id div 10) AS src", "concat('n', id) AS dst").unionByName(edges_of(spark, [("n500", "n50")]))
    with pytest.raises(graph.GraphError, match="a cycle among n50, n500$"):
        graph.depths(names, ways)


def test_depths_are_longest_ways(spark):
    r = random.Random(2)
    pairs = [(f"v{a:02}", f"v{b:02}") for a, b in (sorted(r.sample(range(20), 2)) for _ in range(30))] + [(f"w{i}", f"w{i + 1}") for i in range(9)]
    names = sorted({x for p in pairs for x in p} | {"alone"})
    want = {}
    for n in names:  # names ascend along edges
        want[n] = max((want[a] + 1 for a, b in pairs if b == n), default=0)
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    assert {x.name: x.depth for x in graph.depths(nodes, edges_of(spark, pairs)).collect()} == want
    numbers = graph.order_numbers(nodes, edges_of(spark, pairs)).orderBy("number").collect()
    assert [x.number for x in numbers] == list(range(1, len(names) + 1))
    assert [x.name for x in numbers] == sorted(names, key=lambda n: (want[n], n))


@pytest.mark.parametrize("phases", [["pre", "pre", "default", "post", None], ["pre", "post", "post"]])
def test_barriers_say_what_pairs_say(spark, phases):
    nodes = spark.createDataFrame([(f"b{k}", p) for k, p in enumerate(phases)], "name string, phase string")
    for down in (False, True):
        pairs, short = (graph.closure(e, nodes.select("name"), down) for e in (graph.phase_edges(nodes), graph.phase_barriers(nodes)))
        assert sorted(map(tuple, graph.without_barriers(short).collect())) == sorted(map(tuple, pairs.collect()))
    depth = graph.without_barriers(graph.depths(graph.barrier_nodes(nodes), graph.phase_barriers(nodes)))
    assert sorted(map(tuple, depth.collect())) == sorted(map(tuple, graph.depths(nodes, graph.phase_edges(nodes)).collect()))


def test_numbers_and_running_values(spark):
    r = random.Random(9)
    rows = [(r.choice(["a", "a", "a", "b", None]), s * 10**9, r.choice([None, None, "x", "y"])) for s in r.sample(range(5000), 700)]  # sparse seq
    df = spark.createDataFrame(rows, "k string, seq long, m string").repartition(5)
    ranges = scans.in_ranges(df, "seq", scans._bounds(df, "seq", 50))
    sizes = [x["count"] for x in ranges.groupBy("__part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 120
    for by in (None, "k", ["k", "m"]):
        keys = [by] if isinstance(by, str) else by or []
        last, n, want = {}, collections.Counter(), []
        for k, s, m in sorted(rows, key=lambda x: x[1]):
            key = tuple({"k": k, "m": m}[c] for c in keys)
            last[key] = m or last.get(key)
            want.append((s, last[key], n[key]))
            n[key] += m == "x"
        out = scans.counted(scans.carried(df, F.col("m"), "last", by, size=50), F.col("m") == "x", "n", by, size=50)
        assert sorted(map(tuple, out.select("seq", "last", "n").collect())) == want
    number = {x.seq: x.number for x in scans.numbered(df, "seq").collect()}
    assert number == {s: i for i, s in enumerate(sorted(s for _, s, _ in rows), 1)}


def test_reach_index_answers_like_walks(spark):
    r = random.Random(4)
    names = [f"v{k:02}" for k in range(24)]
    pairs = sorted({tuple(sorted(r.sample(names, 2))) for _ in range(40)}) + [("alone1", "alone2")]
    edges = edges_of(spark, pairs).withColumn("kind", F.when(F.col("src") < "v12", "dependency").otherwise("ordering"))
    nodes = spark.createDataFrame([(n,) for n in [*names, "alone1", "alone2"]], "name string")
    asked = spark.createDataFrame([(a, b) for a in [*names, "alone2", "none"] for b in [*names, "alone1"]], "a string, b string")
    reach = reach_of(pairs)
    got = {(x.a, x.b): x.depends for x in depends(reach_index(nodes, edges), asked).collect()}
    assert len(got) == 26 * 25
    assert got == {(a, b): None if a == "none" else a == b or a in reach.get(b, ()) for a, b in got}


def test_changed_hashes_equal_all_hashes(spark):
    r = random.Random(8)
    names = [f"v{k:02}" for k in range(16)]
    pairs = sorted({tuple(sorted(r.sample(names, 2))) for _ in range(22)})
    nodes, edges = spark.createDataFrame([(n,) for n in names], "name string"), edges_of(spark, pairs).withColumn("kind", F.lit("dependency"))
    rows = lambda change: spark.createDataFrame([(n, change.get(n, "1")) for n in names], "block string, input_hash string")
    sources = spark.createDataFrame([("v03", "k", "h")], "block string, key string, hash string")
    state, ways = map(graph.checkpointed, hashing.merkle_tree(rows({}), sources, nodes, edges))
    change = {"v05": "2", "v06": "1", "v11": "3"}  # v06 stays as it was: nothing above it is hashed again for its sake
    again = hashing.merkle_changed(state, ways, hashing.owned(rows(change).where(F.col("block").isin(*change)), sources.where("block IN ('v05', 'v06', 'v11')")))
    now = {x.block: x.content_hash for x in state.collect()} | {x.block: x.content_hash for x in again.collect()}
    assert now == {x.block: x.content_hash for x in hashing.merkle(rows(change), sources, nodes, edges).collect()}
    reach = reach_of(pairs)
    assert {x.block for x in again.collect()} == {"v05", "v06", "v11"} | reach.get("v05", set()) | reach.get("v11", set())
    assert hashing.merkle_changed(state, ways, hashing.owned(rows({}).limit(0), sources)).count() == 0
