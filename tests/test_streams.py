"""Streams in several micro-batches, with rows in any order inside each, against the batch forms; and types over columns against those on the driver."""

import json
import random

import pytest
from pyspark.sql import functions as F

from blockloom.functions import checks, types
from blockloom.operators import logs
from blockloom.streaming.failures import stream_attributed, stream_failures, with_state_store


def run(spark, base, rows, schema, work, batches=4):
    """The output of work over rows, cut into micro-batches in order, each shuffled."""
    session, r = with_state_store(spark), random.Random(1)
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    size = -(-len(rows) // batches)
    query = None
    for k in range(batches):
        part = rows[k * size : (k + 1) * size]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{k}")
        query = work(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/at").option("path", f"{base}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    return sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()), key=repr)


def test_failures_across_batches(spark, tmp_path):
    rows = []
    for s, (action, test, text) in enumerate([("output", "A", "=== RUN A\n"), ("output", "A", "one\n"), ("output", "B", "b\n"), ("output", "A", "two\n\n"), ("output", "A", None), ("fail", "A", None), ("output", "A", "three\n"), ("pass", "B", None), ("output", "C", "lost\n"), ("fail", None, None), ("fail", "C", None), ("output", "A", "--- FAIL\n"), ("fail", "A", None), ("output", "B", "\n"), ("output", "B", "x\n"), ("fail", "B", None)]):
        rows.append((s, action, "p", test, 0.1, text))
        rows.append((100 + s, action, "q", test, 0.1, text))
    rows.sort(key=lambda x: x[0] % 100)
    schema = "seq long, Action string, Package string, Test string, Elapsed double, Output string"
    want = sorted(map(tuple, logs.failure_output(spark.createDataFrame(rows, schema)).select("Package", "Test", "seq", "output").collect()), key=repr)
    assert len(want) == 8
    assert run(spark, tmp_path, rows, schema, stream_failures) == want


def test_attribution_across_batches(spark, tmp_path):
    lines = ["running 1 test", "     Running src/a.rs (x)", "test t ... ok", "noise", "noise", "   Doc-tests a", "test u ... FAILED", "noise"]
    rows = [(k, line, "l1" if k % 3 else "l2") for k, line in enumerate(lines * 2)]
    schema = "seq long, line string, log string"
    want = logs.attributed(spark.createDataFrame(rows, schema), "log").select("log", "seq", "suite")
    assert run(spark, tmp_path, rows, schema, lambda s: stream_attributed(s, "log").select("log", "seq", "suite")) == sorted(map(tuple, want.collect()), key=repr)


VALUES = [1, 2.5, "x", "", True, None, [], [1, "y"], [[1], [2, None]], {}, {"a": 1}, {"b": "s", "a": 1}, {"a": {"b": [1, True]}}, {"a": None}]
N, S = types.NUMBER, types.STRING
TYPES = [N, S, types.BOOL, types.NULL, types.ANY, types.DURATION, types.PATH, types.list_of(N), types.list_of(types.list_of(types.optional(N))), types.map_of(N), types.map_of(types.ANY), types.optional(S), types.struct_of({"a": N}), types.struct_of({"a": types.optional(N), "b": types.optional(S)}), types.struct_of({"a": types.struct_of({"b": types.list_of(N)})}), types.union_of(N, types.list_of(types.union_of(N, S)), types.struct_of({"a": N})), types.list_of(types.union_of(N, types.BOOL))]


@pytest.mark.parametrize("t", TYPES, ids=str)
def test_types_over_columns_are_those_of_the_driver(spark, t):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(VALUES)], "k int, v string")
    got = {r.k: r.found for r in df.select("k", checks.violation(F.parse_json("v"), t).alias("found")).collect()}
    for k, v in enumerate(VALUES):
        try:
            types.validate(types.from_json_value(v), t)
            want = None
        except types.ValueTypeError as e:
            want = str(e)
        assert (got[k] is None) == (want is None), (v, str(t))
        if want:
            path, _, rest = want.rpartition(": expected ")
            assert got[k].path == path and got[k].expected == rest.removeprefix("expected ").split(", got ")[0], (v, want)


def test_departures_keep_the_row(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "no json"), (3, None), (4, '{"a": "x"}')], "k int, v string")
    got = checks.departures(df, "v", types.struct_of({"a": N})).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(2, "no json", "", "{a = number}", "null"), (3, None, "", "{a = number}", "null"), (4, '{"a": "x"}', ".a", "number", "string")]
