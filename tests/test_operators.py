import pytest

from blockloom.operators import expansion, graph, hashing, logs, planning, scans
from blockloom.plans.engine import content_hash


def edges_of(spark, *pairs, kind="dependency"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, kind string")


def nodes_of(spark, *names):
    return spark.createDataFrame([(n, "default", "build") for n in names], "name string, phase string, kind string")


def names(df):
    return sorted(r[0] for r in df.collect())


def test_diamond_and_deep_chain(spark):
    e = edges_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    n = nodes_of(spark, "a", "b", "c", "d")
    assert graph.order_of(n, e) == ["a", "b", "c", "d"]
    assert dict(map(tuple, graph.depths(n, e).collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.closure(e).count() == 4 + 2 + 3
    assert names(graph.children(e, "a")) == ["b", "c"] and names(graph.parents(e, "d")) == ["b", "c"]


def test_cycle(spark):
    e, n = edges_of(spark, ("a", "b"), ("b", "a"), ("b", "c")), nodes_of(spark, "a", "b", "c")
    assert graph.closure(e).count() == 2 + 2 + 3  # ends, although it goes round
    with pytest.raises(graph.GraphError):
        graph.depths(n, e)
    with pytest.raises(graph.GraphError):
        graph.topological_order(["a", "b"], [("a", "b"), ("b", "a")])


def test_alphabetical_ties():
    assert graph.topological_order(["zebra", "apple", "mango"], []) == ["apple", "mango", "zebra"]


def test_checks(spark):
    n = nodes_of(spark, "a", "b", "b")
    with pytest.raises(graph.GraphError):
        graph.check_nodes(n)
    with pytest.raises(graph.GraphError):
        graph.check_edges(nodes_of(spark, "a"), edges_of(spark, ("a", "x")))
    with pytest.raises(graph.GraphError):
        graph.check_targets(nodes_of(spark, "a"), spark.sql("SELECT 't' AS target, 'x.y' AS block"))


def test_targets_and_tests(spark):
    n = spark.createDataFrame([("m", "default", "build"), ("m.a", "default", "build"), ("x", "default", "test")], "name string, phase string, kind string")
    e = edges_of(spark, ("m.a", "m"), ("m.a", "x"))
    t = spark.sql("SELECT 'go' AS target, 'm' AS block")
    assert graph.target_order(n, e, t, "go") == ["m.a", "m"]
    assert graph.test_order(n, e) == ["m.a", "x"]


def test_tree_and_layout(spark):
    e, n = edges_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")), nodes_of(spark, "a", "b", "c", "d")
    assert graph.tree(spark, n, e) == ["a", "  b", "    d (also: c)", "  c"]
    at = graph.layout(n, e)
    assert [at[x][0] for x in "abcd"] == [0, 1, 1, 2] and at["b"][1] != at["c"][1]
    assert "a -> b, c" in graph.drawn(n, e)


def test_hashes_ignore_key_order(spark):
    a = spark.sql("SELECT map('x', 1, 'y', 2) AS m, named_struct('p', 1, 'q', 2) AS s")
    b = spark.sql("SELECT named_struct('q', 2, 'p', 1) AS s, map('y', 2, 'x', 1) AS m")
    assert a.select(hashing.input_hash(a)).first() == b.select(hashing.input_hash(b)).first()


def test_engine_and_table_hashes_agree(spark):
    blocks = spark.sql("SELECT 'b' AS block, 'ih' AS input_hash")
    resolved = spark.createDataFrame([("b", "y", "2"), ("b", "x", "1")], "block string, key string, hash string")
    parents = spark.createDataFrame([("b", "p", "h")], "block string, parent string, hash string")
    assert hashing.content_hashes(blocks, resolved, parents).first()[1] == content_hash("ih", {"x": "1", "y": "2"}, {"p": "h"})
    assert hashing.content_hashes(blocks, resolved, parents, delimited=False).first()[1] != content_hash("ih", {"x": "1", "y": "2"}, {"p": "h"})


def test_one_leaf_dirties_its_dependents_only(spark):
    e, n = edges_of(spark, ("a", "b"), ("b", "c"), ("x", "y")), nodes_of(spark, "a", "b", "c", "x", "y")
    none = spark.createDataFrame([], "block string, key string, hash string")
    of = lambda change: {r[0]: r[1] for r in hashing.merkle(spark.createDataFrame([(k, "2" if k == change else "1") for k in "abcxy"], "block string, input_hash string"), none, n, e).collect()}
    before, after = of(None), of("b")
    assert {k for k in before if before[k] != after[k]} == {"b", "c"}


def test_plan_actions(spark):
    blocks = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("t", "1")], "block string, content_hash string")
    state = spark.createDataFrame([("a", "0", None), ("b", "1", None), ("t", "1", False)], "block string, content_hash string, passed boolean")
    e = edges_of(spark, ("a", "b"))
    got = lambda **k: {r[0]: r[1] for r in planning.plan_actions(blocks, state, e, **k).collect()}
    assert got() == {"a": "update", "b": "update", "c": "create", "t": "none"}
    assert got(rerun_failed=True)["t"] == "update"


def test_matrix(spark):
    rows = expansion.cartesian(spark, {"arch": ["amd64", "arm64"], "os": ["linux", "darwin"]}).orderBy("place").collect()
    assert [(r.arch, r.os) for r in rows] == [("amd64", "linux"), ("amd64", "darwin"), ("arm64", "linux"), ("arm64", "darwin")]
    assert expansion.cartesian(spark, {"arch": []}).count() == 0
    with pytest.raises(ValueError):
        expansion.aligned(spark.range(1), spark.range(1), ["a", "b"], ["b", "a"])


GO = """{"Action":"output","Package":"p","Test":"A","Output":"=== RUN A\\n"}
{"Action":"output","Package":"p","Test":"A","Output":"bad\\n"}
{"Action":"output","Package":"p","Test":"A","Output":"worse\\n"}
{"Action":"fail","Package":"p","Test":"A","Elapsed":0.1}
{"Action":"pass","Package":"p","Test":"B"}
broken
{"Action":"fail","Package":"p","Elapsed":1.5}
{"Action":"pass","Package":"empty"}
{"Action":"skip","Package":"q","Test":"C"}
{"Action":"pass","Package":"q"}
{"Action":"pass","Package":"open","Test":"D"}"""


def lines_of(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "seq long, line string")


def test_go_log(spark):
    e = logs.test_events(lines_of(spark, GO))
    got = {r.Package: (r.passed, r.failed, r.skipped, r.elapsed, r.ok) for r in logs.suite_summary(e).collect()}
    assert got == {"p": (1, 1, 0, 1.5, False), "q": (0, 0, 1, 0.0, True)}
    assert [tuple(r) for r in logs.failure_output(e).select("Test", "output").collect()] == [("A", "bad\nworse")]
    assert tuple(logs.verdict(e).first()) == (False, True)
    assert tuple(logs.verdict(e.limit(0), exit_ok=True).first()) == (True, False)


CARGO = """     Running unittests src/lib.rs (x)
running 3 tests
test foo ... ok
test bar ... FAILED
test baz ... ignored

failures:

---- bar stdout ----
assertion failed

failures:
    bar

test result: FAILED. 1 passed; 1 failed; 1 ignored; finished in 0.5s
{"reason":"compiler-artifact","executable":"/t/a","target":{"kind":["bin"],"name":"a"}}
{"reason":"compiler-artifact","executable":"/t/b","target":{"kind":["bin"],"name":"b"}}
{"reason":"compiler-artifact","executable":null,"target":{"kind":["lib"],"name":"l"}}"""


def test_cargo_log(spark):
    lines = lines_of(spark, CARGO)
    r = logs.cargo_summary(lines).first()
    assert (r.suite, r.ok, r.passed, r.failed, r.ignored, r.seconds) == ("src/lib.rs", False, 1, 1, 1, 0.5)
    assert [tuple(x) for x in logs.cargo_failures(lines).collect()] == [("bar", "assertion failed\n")]
    assert tuple(logs.cargo_verdict(lines).first()) == (False, True)
    assert logs.last_binary(lines).first()[0] == "/t/b"
    assert "FAIL" in logs.rendered(logs.cargo_summary(lines).select("suite", "ok", "passed", "failed")).first().text


def events_of(spark, *rows):
    return spark.createDataFrame(rows, "seq long, Action string, Package string, Test string, Elapsed double, Output string")


def test_a_skipped_package_ends_its_run(spark):
    e = events_of(spark, (1, "pass", "p", "A", 0.1, None), (2, "skip", "p", None, 0.2, None), (3, "output", "p", "B", None, "old\n"), (4, "fail", "p", None, 0.3, None), (5, "output", "p", "B", None, "new\n"), (6, "fail", "p", "B", 0.1, None), (7, "fail", "p", None, 0.4, None))
    got = [(r.run, r.passed, r.failed, r.skipped, r.ok) for r in logs.suite_summary(e).orderBy("run").collect()]
    assert got == [(0, 0, 0, 0, None), (1, 0, 0, 0, False), (2, 0, 1, 0, False)]
    assert [r.text for r in logs.rendered(logs.suite_summary(e)).orderBy("run").collect()] == ["skip p: ", "FAIL p: ", "FAIL p: 1 failed"]
    assert [(r.seq, r.output) for r in logs.failure_output(e).collect()] == [(6, "new")]  # what it printed before its package ended is gone
    only = logs.verdict(e.where("seq < 3"), exit_ok=False).first()
    assert only.passed and only.had_events


def test_logs_are_told_apart_and_carried_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "RANGE", 3)
    lines = ["Running unittests src/lib.rs (target/x)", "test a ... ok", "running 1 test", "test result: ok. 1 passed; 0 failed; 0 ignored; finished in 0.1s", "   Doc-tests crate", "x", "y", "z", "test result: FAILED. 0 passed; 1 failed; 2 ignored"]
    one = [(k, x, "one") for k, x in enumerate(lines)]
    two = [(k, x.replace("src/lib.rs", "tests/it.rs"), "two") for k, x in enumerate(lines[:4])]
    df = spark.createDataFrame([*one, *two, (9, lines[3], None)], "seq long, line string, log string")
    got = sorted(((r.log or "", r.seq, r.suite, r.ok, r.failed) for r in logs.cargo_summary(df, "log").collect()))
    assert got == [("", 9, None, True, 0), ("one", 3, "src/lib.rs", True, 0), ("one", 8, "doc-tests crate", False, 1), ("two", 3, "tests/it.rs", True, 0)]
    alone = logs.cargo_summary(df.where("log = 'one'").drop("log")).orderBy("seq").collect()
    assert [r.suite for r in alone] == ["src/lib.rs", "doc-tests crate"]
    part = ["failures:", "---- a stdout ----", "l1", "l2", "l3", "l4", "---- b stdout ----", "failures:", "    a"]
    found = logs.cargo_failures(spark.createDataFrame(list(enumerate(part)), "seq long, line string")).collect()
    assert {(r["name"], r["output"]) for r in found} == {("a", "l1\nl2\nl3\nl4"), ("b", "")}


def test_a_stream_sorts_what_arrow_has_cut():
    import pandas as pd

    from blockloom.streaming.suites import _reduce

    class State:
        exists, hasTimedOut = False, False

        def update(self, value):
            self.value = value

    names = ["seq", "Action", "Package", "Test", "Elapsed"]
    a = pd.DataFrame([(1, "pass", "p", "A", 0.1), (4, "pass", "p", None, 0.4), (5, "fail", "p", "B", 0.1)], columns=names)
    b = pd.DataFrame([(2, "pass", "p", "C", 0.1), (3, "skip", "p", "D", 0.1), (6, "fail", "p", None, 0.6), (7, "skip", "p", None, 0.0)], columns=names)
    out = pd.concat(_reduce(("p",), iter([b, a]), State(), None))
    assert out.drop(columns="Package").astype(object).where(out.drop(columns="Package").notna(), None).values.tolist() == [[2, 0, 1, 0.4, True], [0, 1, 0, 0.6, False], [0, 0, 0, 0.0, None]]
