import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from blockloom.operators.graph import GraphError
from blockloom.plans.engine import ApplyError, Engine
from blockloom.plans.loader import LoadError, load, statements_df
from blockloom.plans.providers import Custom, default_registry
from blockloom.plans.state import BlockState, MemoryStore, ParquetStore, from_json, state_frame, to_json


def engine(spark, text, store=None, registry=None, tmp=".", **params):
    r = registry or default_registry()
    return Engine(spark, load(spark, text, r, params, root=str(tmp)), r, store if store is not None else MemoryStore(), f"{tmp}/data")


def actions(steps):
    return {s.block: s.action for s in steps}


def test_second_apply_does_nothing(spark):
    store, text = MemoryStore(), 'a = value { x = "1" }\nb = value { y = a.x }\n'
    assert actions(engine(spark, text, store).apply()) == {"a": "create", "b": "create"}
    assert actions(engine(spark, text, store).apply()) == {"a": "none", "b": "none"}
    assert actions(engine(spark, 'b = value { y = a.x }\na = value { x = "1" }\n', store).apply()) == {"a": "none", "b": "none"}  # order of statements


def test_depends_on_couples_and_after_does_not(spark):
    for field, expected in (("depends_on", "update"), ("after", "none")):
        store = MemoryStore()
        text = f'p = value {{ x = "%s" }}\nc = value {{ {field} = [p], k = "k" }}\n'
        engine(spark, text % "1", store).apply()
        steps = engine(spark, text % "2", store).apply()
        assert actions(steps) == {"p": "update", "c": expected}
    assert steps[0].reason == "inputs changed"


def test_plan_reads_what_is_missing_as_text(spark):
    e = engine(spark, 'a = value { x = "1" }\nb = value { y = "at ${a.x}" }\n')
    steps = {s.block: s for s in e.plan()}
    assert steps["b"].inputs == {"y": "at ${a.x}"} and steps["b"].action == "create"
    assert e.store.all() == {}


def test_matrix_aligns(spark):
    e = engine(spark, 'let arch = ["amd64", "arm64"]\nbin[arch] = value { a = arch }\nimg[arch] = value { r = "i-${bin.a}" }\nall = value { x = bin["arm64"].a, depends_on = [img] }\n')
    e.apply()
    got = {k: s.outputs for k, s in e.store.all().items()}
    assert got["img[amd64]"] == {"r": "i-amd64"} and got["all"] == {"x": "arm64"}
    assert {(a, b) for a, b, _ in e.graph.edges if b == "img[arm64]"} == {("bin[arm64]", "img[arm64]")}


def test_modules(spark, tmp_path):
    (tmp_path / "mods").mkdir()
    (tmp_path / "mods" / "app.loom").write_text('param env : string\nparam n = 2\nlet tag = "t-${env}"\nserver = value { a = tag, n = n }\nimage = value { ref = "img:${server.a}" }\noutput endpoint = image.ref\n')
    text = 'import "./mods"\nstaging = app { env = "st" }\nend = value { e = staging.endpoint }\noutput o = end.e\n'
    e = engine(spark, text, tmp=tmp_path)
    e.apply("end")
    assert e.outputs() == {"o": "img:t-st"} and "staging.server" in e.store.all()
    with pytest.raises(LoadError):
        engine(spark, 'import "./mods"\nx = app {}\n', tmp=tmp_path)
    with pytest.raises(LoadError):
        engine(spark, 'import "./mods"\nx = app { env = "a", zzz = 1 }\n', tmp=tmp_path)


def test_phases_targets_and_params(spark):
    text = 'param need : string\npost z = value {}\nb = value {}\npre y = value {}\nuses = value { n = need }\ntarget default = [b]\ntarget all = [uses]\n'
    e = engine(spark, text)
    assert e.order() == ["y", "b"] and e.order("...")[0] == "y" and e.order("...")[-1] == "z"
    with pytest.raises(LoadError, match="need"):
        e.apply("all")
    assert actions(engine(spark, text, need="v").apply("all"))["uses"] == "create"
    with pytest.raises(LoadError, match="unknown parameters"):
        engine(spark, text, nope="1")
    with pytest.raises(LoadError):
        engine(spark, 'param n : number\n', n="x")


@pytest.mark.parametrize("text", ["a = value { x = gone.y }", "a = nope.nope {}", "target t = [zz]", "a = value { depends_on = [zz] }", 'let a : number = "x"'])
def test_load_errors(spark, text):
    with pytest.raises(LoadError):
        load(spark, text)


def test_cycles(spark):
    for text in ("a = value { x = b.x }\nb = value { x = a.x }\n", "a = value { x = a.x }\n"):
        with pytest.raises(GraphError):
            load(spark, text)


def failing(registry, fails):
    registry.add("t", "test", Custom(lambda ctx, inputs: {"passed": not fails}, kind="test"))
    return registry


def test_failed_test_is_kept_and_run_again(spark):
    store, fails = MemoryStore(), [1]
    r = failing(default_registry(), fails)
    text = "a = t.test {}\nb = value { depends_on = [a] }\n"
    with pytest.raises(ApplyError):
        engine(spark, text, store, r).apply()
    assert store.load("a").passed is False and store.load("b") is None
    assert actions(engine(spark, text, store, r).plan())["a"] == "none"
    fails.clear()
    steps = engine(spark, text, store, r).apply()
    assert steps[0].reason == "failed before" and store.load("a").passed is True
    assert [s.block for s in engine(spark, text, store, r).test()] == ["a"]


def test_parallel_equals_serial(spark):
    text = "".join(f'n{k} = value {{ x = "{k}"{", y = n" + str(k // 2) + ".x" if k else ""} }}\n' for k in range(12))
    one, many = MemoryStore(), MemoryStore()
    engine(spark, text, one).apply()
    engine(spark, text, many).apply(jobs=4)
    assert one.all() == many.all()


def test_parallel_failure_drains(spark):
    r = failing(default_registry(), [1])
    store = MemoryStore()
    with pytest.raises(ApplyError):
        engine(spark, "a = t.test {}\nb = value {}\nc = value { depends_on = [a] }\n", store, r).apply(jobs=2)
    assert store.load("c") is None and store.load("a").passed is False


def test_tables_and_gate(spark, small, tmp_path):
    text = 'param least = 1000\norders = table.file { path = "%s/orders.parquet" }\nbig = table.sql { query = "SELECT * FROM o WHERE o_totalprice > ${least}", tables = { o = orders.path } }\ngate = table.expect { path = big.path, condition = "o_totalprice > 1000" }\n' % small
    store = MemoryStore()
    e = engine(spark, text, store, tmp=tmp_path)
    e.apply()
    assert spark.read.parquet(store.load("big").outputs["path"]).count() > 0 and store.load("gate").passed
    with pytest.raises(ApplyError):
        engine(spark, text, store, tmp=tmp_path, least="0").apply() if spark.read.parquet(f"{small}/orders.parquet").where("o_totalprice <= 1000").count() else (_ for _ in ()).throw(ApplyError())
    assert engine(spark, text, store, tmp=tmp_path).destroy("orders")[-1] == "orders" and not store.all()


def test_arguments_of_a_query_are_no_text(spark, small, tmp_path):
    """Strings with quotes, numbers and durations come in as values."""
    text = 'param name = "x"\nq = table.sql { query = "SELECT :name AS name, :least + 1 AS more, :wait > INTERVAL 1 SECOND AS late, count(*) AS n FROM o WHERE o_totalprice > :least", args = { name = name, least = 1000.5, wait = 2s }, tables = { o = "%s/orders.parquet" } }\n' % small
    e = engine(spark, text, tmp=tmp_path, name="it's \"one\" -- :least")
    e.apply()
    row = spark.read.parquet(e.store.all()["q"].outputs["path"]).first()
    assert row.name == "it's \"one\" -- :least" and float(row.more) == 1001.5 and row.late
    assert row.n == spark.read.parquet(f"{small}/orders.parquet").where("o_totalprice > 1000.5").count()


def test_destroy(spark):
    store = MemoryStore()
    e = engine(spark, "a = value {}\nprotected b = value { depends_on = [a] }\nc = value { depends_on = [b] }\nd = value {}\n", store)
    e.apply()
    assert e.destroy("a") == ["c", "a"]
    assert set(store.all()) == {"b", "d"}
    assert e.destroy("b", force=True) == ["b"]


def test_parquet_store(spark, tmp_path):
    text = 'a = value { x = 1.5, d = 5s, l = ["x"], n = null }\n'
    store = ParquetStore(spark, str(tmp_path / "s"))
    engine(spark, text, store).apply()
    again = ParquetStore(spark, str(tmp_path / "s"))
    assert again.all() == store.all()
    assert actions(engine(spark, text, again).apply()) == {"a": "none"}
    (tmp_path / "s" / "commits" / "000000000009.json.x.part").write_text('{"block": "a"')  # as a crash within a change leaves it
    assert ParquetStore(spark, str(tmp_path / "s")).all() == store.all()
    (tmp_path / "s" / "commits" / f"{again.commits + 1:012d}.json").write_text('{"block": "z"\n')  # what cannot be decoded is no state
    assert ParquetStore(spark, str(tmp_path / "s")).all() == store.all()
    again.remove("a")
    assert ParquetStore(spark, str(tmp_path / "s")).all() == {}


def test_a_change_of_state_is_a_small_file(spark, tmp_path):
    store, at = ParquetStore(spark, str(tmp_path / "s")), tmp_path / "s"
    for k in range(12):
        store.save(BlockState(f"b{k}", {"x": "é"}, {"y": k}, f"h{k}", resolve_map={"p": "q"}, passed=k % 2 == 0))
    store.remove("b3")
    store.save(BlockState("b4", content_hash="new"))
    assert not (at / "base").exists() and len(list((at / "commits").glob("*.json"))) == 14
    again = ParquetStore(spark, str(at))
    said = lambda s: {k: (v.content_hash, v.state, v.resolve_map, v.dep_hashes, v.passed) for k, v in s.all().items()}
    assert said(again) == said(store) and "b3" not in again.all()
    assert again.base == 14 and {r.block: r.content_hash for r in state_frame(spark, str(at)).collect()} == {k: v.content_hash for k, v in store.all().items()}
    for k in range(10):
        again.save(BlockState("b0", content_hash=f"again{k}"))
    third = ParquetStore(spark, str(at))
    store.save(BlockState("late", content_hash="late"))  # whose next number others have merged and taken away
    assert store.commits == 25 and said(ParquetStore(spark, str(at)))["late"][0] == "late"
    store.remove("late")
    (at / "commits" / "000000000025.json").unlink()
    (at / "commits" / "000000000026.json").unlink()
    assert third.base == 24 and third.load("b0").content_hash == "again9" and len(third.all()) == 11
    assert sorted(int(p.stem) for p in (at / "commits").glob("*.json")) == list(range(15, 25))  # those of the base before are gone


def test_two_writers_lose_nothing(spark, tmp_path):
    """Two engines on one folder: each takes up what the other has written, and the later change of a block holds."""
    first, second = (ParquetStore(spark, str(tmp_path / "s")) for _ in range(2))
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(store.save, BlockState(f"{name}{k}", content_hash=f"{name}{k}")) for k in range(8) for name, store in (("x", first), ("y", second))]
        [j.result() for j in jobs]
    second.save(BlockState("x0", content_hash="by the second"))
    first.remove("y1")
    want = {f"{n}{k}": f"{n}{k}" for n in "xy" for k in range(8)} | {"x0": "by the second"}
    del want["y1"]
    assert {k: v.content_hash for k, v in first.all().items()} == want and first.commits == 18
    assert {k: v.content_hash for k, v in ParquetStore(spark, str(tmp_path / "s")).all().items()} == want
    assert {r.block: r.content_hash for r in state_frame(spark, str(tmp_path / "s")).collect()} == want


def test_json_keeps_types():
    from decimal import Decimal

    from blockloom.functions.types import Duration

    value = {"n": Decimal("1.50"), "d": Duration(5), "s": "5", "l": [Decimal(1)], "b": True, "z": None}
    assert from_json(to_json(value)) == value and type(from_json(to_json(value))["d"]) is Duration


def test_listings(spark):
    e = engine(spark, 'a = value { x = "1" }\n')
    e.apply()
    assert e.dump().count() == 2 and e.events_df().count() == 2
    assert e.graph.nodes_df(spark).count() == 1 and e.plan_df().first().action == "none"
    assert default_registry().catalog(spark, "table").count() > 5
    assert [r.kind for r in statements_df(spark, "# d\na = value {}\noutput o = a.x\n").collect()] == ["block", "output"]


def test_command_line(spark, tmp_path, capsys):
    from blockloom.cli import main

    file = tmp_path / "p.loom"
    file.write_text('param n = 1\na = value { x = n }\nb = value { y = a.x }\ntarget default = [b]\noutput o = b.y\n')
    run = lambda *args: (main(["-C", str(file), "--state", str(tmp_path / "s"), *args], spark), capsys.readouterr().out)[1]
    assert "a: create" in run("--plan") and "b: create" in run("-P", "n=2", "-j", "2")
    assert "b: none" in run("-P", "n=2") and '"2"' in run("--dump")
    assert "a" in run("--list").split() and "a -> b" in run("--graph")
    assert "param n" in run("--info") and "table.sql" in run("--schema", "table") and json.loads(run("--schema", "table", "--json"))
    assert "b: destroyed" in run("--clean", "a")
    with pytest.raises(SystemExit):
        main(["-C", str(file), "--plan", "--test"], spark)


def test_reflected_schema():
    from dataclasses import dataclass, field

    from blockloom.plans.providers import schema_of

    @dataclass
    class Inputs:
        path: str = field(metadata={"doc": "where"})
        tags: list[str] = field(default_factory=list)
        limit: int | None = None
        both: str | bool = ""
        env: dict[str, str] = field(default_factory=dict)

    got = {n: str(t) for n, t in schema_of(Inputs).items()}
    assert got == {"path": "string", "tags": "[string]", "limit": "number?", "both": "string | bool", "env": "{string = string}"}
