"""Inputs beyond what the supplied tables have: long durations, hubs, long logs."""

from collections import Counter
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from blockloom import catalogue
from blockloom.functions.types import duration_column, duration_text, format_duration
from blockloom.operators import graph, scans
from blockloom.operators.reach import depends, reach_index
from blockloom.streaming.failures import _Failures

UNIT = [1, 1000, 10**6, 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9]


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _nanoseconds(event, user):
    return (2 * user + 1) * UNIT[event % 7] // 2


def test_totals_of_durations_beyond_a_bigint(spark, tmp_path):
    rows = [(6 + 7 * k, 100_000) for k in range(3)] + [(k, 5) for k in range(7)] + [(13, 900_000)]
    out = catalogue.duration_total(spark, _events(spark, tmp_path, rows))
    want = {u: sum(_nanoseconds(e, u) for e, v in rows if v == u) for _, u in rows}
    assert max(want.values()) > 1 << 63
    assert {r.user_id: int(r.ns) for r in out.collect()} == want


def test_totals_that_fit_are_bigints(spark, tmp_path):
    out = catalogue.duration_total(spark, _events(spark, tmp_path, [(6, 100_000), (13, 5)]))
    assert dict(out.dtypes)["ns"] == "bigint"
    assert {tuple(r) for r in out.collect()} == {(100_000, _nanoseconds(6, 100_000)), (5, _nanoseconds(13, 5))}


def test_durations_beyond_a_bigint_are_parsed(spark, tmp_path):
    rows = [(6, 900_000), (0, 3)]
    out = catalogue.duration_parse(spark, _events(spark, tmp_path, rows))
    assert {r.event_id: int(r.ns) for r in out.collect()} == {e: _nanoseconds(e, u) for e, u in rows}
    assert spark.range(1).select(duration_column(F.lit("1.5h"))).first()[0] == 5400 * 10**9


def test_long_durations_keep_all_digits(spark, tmp_path):
    rows = [(event, user) for event in (1, 7, 2_562_048, 6_000_001, 10**12 + 1) for user in range(3)]
    out = catalogue.duration_format(spark, _events(spark, tmp_path, rows)).collect()
    assert sorted((r.event_id, r.shown) for r in out) == sorted((e, format_duration(e * 1500 * (1, 60_000, 2_400_000_000)[u % 3])) for e, u in rows)
    longs = [(1 << 63) - 1, (1 << 53) + 1]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in longs], "n long").select(duration_text(F.col("n"))).collect()] == [f"{n}ns" for n in longs]
    assert spark.createDataFrame([(Decimal(10**28),)], "n decimal(38,0)").select(duration_text(F.col("n"))).first()[0] == format_duration(10**28)


def _through_a_hub(spark, ins, outs):
    return spark.createDataFrame([(f"a{k}", "hub") for k in range(ins)] + [("hub", f"z{k}") for k in range(outs)], "src string, dst string")


def test_closures_through_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 50)
    for ins, outs in ((300, 3), (3, 300), (60, 70)):
        edges = _through_a_hub(spark, ins, outs)
        a, z = [f"a{k}" for k in range(ins)], [f"z{k}" for k in range(outs)]
        want = sorted([(x, x) for x in [*a, *z, "hub"]] + [(x, "hub") for x in a] + [("hub", x) for x in z] + [(x, y) for x in a for y in z])
        assert sorted(map(tuple, graph.closure(edges, down=True).collect())) == want
        assert sorted((y, x) for x, y in graph.closure(edges).collect()) == want


def test_a_hub_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 1000)
    for ins, outs in ((20_000, 3), (3, 20_000), (250, 240)):
        front = spark.range(ins).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("root"), F.lit("hub").alias("name"))
        step = spark.range(outs).select(F.lit("hub").alias("name"), F.col("id").cast("string").alias("next"))
        met = graph._dealt(front, step, step.groupBy("name").agg(F.count(F.lit(1)).alias("fan")))
        tasks = [r[1] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == ins * outs == met.distinct().count()
        assert max(tasks) <= 8 * 1000


def _ordered(spark, counts):
    """(seq, key, mark) in rows dealt to the keys by turns, as long as each has some left."""
    left, rows = dict(counts), []
    while any(left.values()):
        for k in [k for k, n in left.items() if n]:
            left[k] -= 1
            rows.append((len(rows), k, len(rows) % 3 == 0))
    return rows, spark.createDataFrame(rows, "seq long, key string, mark boolean")


def test_keys_that_are_short_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(scans, "in_ranges", lambda *_: 1 / 0)
    rows, df = _ordered(spark, {f"k{k}": 10 for k in range(30)})
    want = {s: sum(m for t, j, m in rows if j == k and t < s) for s, k, _ in rows}
    assert {r.seq: r.n for r in scans.counted(df, F.col("mark"), "n", "key", size=20).collect()} == want


def test_long_keys_beside_short_ones(spark):
    rows, df = _ordered(spark, {"long": 200, None: 90, "a": 5, "b": 1})
    out = scans.carried(scans.counted(df, F.col("mark"), "n", "key", size=20), F.when(F.col("mark"), F.col("seq")), "last", "key", size=20)
    assert sorted(out.columns) == ["key", "last", "mark", "n", "seq"]
    got = {r.seq: (r.n, r["last"]) for r in out.collect()}
    assert got == {s: (sum(m for t, j, m in rows if j == k and t < s), max((t for t, j, m in rows if j == k and m and t <= s), default=None)) for s, k, _ in rows}


class _State(dict):
    """A map state that counts the calls."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey", "iterator", "clear"):
            type(self).calls += 1
        return super().__getattribute__(name)

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(self.items())


class _Handle:
    def getMapState(self, *_):  # noqa: N802
        return _State()


def test_a_package_without_open_tests_asks_its_state_once(monkeypatch):
    monkeypatch.setattr(_State, "calls", 0)
    work = _Failures(None)
    work.init(_Handle())
    lines = [("output", "A", "x"), ("fail", "A", None), ("pass", "B", None), ("pass", None, None)] * 20
    rows = pd.DataFrame([(k, *x) for k, x in enumerate(lines)], columns=["seq", "Action", "Test", "text"])
    out = pd.concat(work.handleInputRows(("p",), iter([rows]), None))
    assert list(out["output"]) == ["x"] * 20
    assert _State.calls == 1


def test_questions_are_dealt_to_bounded_tasks(spark, monkeypatch):
    ways = [(f"v{k}", f"v{k + d}") for k in range(40) for d in ((1, 7) if k % 5 else (3,)) if k + d < 40]
    edges = spark.createDataFrame(ways, "src string, dst string").withColumn("kind", F.lit("dependency"))
    nodes = spark.createDataFrame([(f"v{k}",) for k in range(40)], "name string")
    below = {k: {k} for k in range(40)}
    for k in reversed(range(40)):
        below[k] |= {x for s, d in ways if s == f"v{k}" for x in below[int(d[1:])]}
    pairs = [(f"v{k % 41}", "v2") for k in range(1000)] + [("v39", f"v{k % 41}") for k in range(1000)] + [("v39", "v2")] * 1000 + [(None, "v2")] * 1000
    asked = spark.createDataFrame([(*p, n) for n, p in enumerate(pairs)], "a string, b string, n int").coalesce(1)
    index = reach_index(nodes, edges)
    monkeypatch.setattr(graph, "CELL", 200)
    out = depends(index, asked).withColumn("task", F.spark_partition_id()).collect()
    known = {f"v{k}" for k in range(40)}
    want = [(a, b, n, None if not {a, b} <= known else int(a[1:]) in below[int(b[1:])]) for n, (a, b) in enumerate(pairs)]
    assert sorted(((x.a, x.b, x.n, x.depends) for x in out), key=lambda x: x[2]) == want
    assert max(Counter(x.task for x in out).values()) <= 4 * graph.CELL
    few = depends(index, asked.where("n % 200 = 0")).collect()  # no name is in more than a task gets
    assert sorted(((x.a, x.b, x.n, x.depends) for x in few), key=lambda x: x[2]) == want[::200]
