from decimal import Decimal as D

import pytest

from blockloom.functions.types import BOOL, NUMBER, STRING, Duration, ValueTypeError, display, format_duration, list_of, map_of, optional, parameter, parse_duration, struct_of, union_of, validate
from blockloom.plans.compiler import Scope, evaluate, literal
from blockloom.plans.parser import ParseError, parse, parse_expression

VALUES = [
    ('"a\\nb\\n\\nc" | lines', ["a", "b", "c"]),
    ('"a\\r\\nb\\r" | lines', ["a", "b\r"]),
    ('"a:b:c" | split(":")', ["a", "b", "c"]),
    ('"a.b" | split(".")', ["a", "b"]),
    ('"abc" | split("")', ["", "a", "b", "c", ""]),
    ('"x\\\\Ey" | split("\\\\E")', ["x", "y"]),
    ('["a", "b", "a"] | uniq', ["a", "b"]),
    ('["/a", "a", "/", "a/b/", "/a/.", "..", "", "a//b"] | dirname', ["/", "", "", "a", "/", "", "", "a"]),
    ('["/a", "a", "/", "a/b/", "/a/.", "..", "", "a/.."] | basename', ["a", "a", "", "b", "a", "", "", ""]),
    ('"hello" | sha256', "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"),
    ('"\\t x\\n" | trim', "x"),
    ('[" a ", "b"] | trim | prefix("<") | suffix(">")', ["<a>", "<b>"]),
    ("1 + 2", D(3)),
    ("0.1 + 0.2", D("0.3")),
    ("[1] + [2]", [D(1), D(2)]),
    ("[] + [1]", [D(1)]),
    ('"a" + "b"', "ab"),
    ("null == null", True),
    ('1 == "1"', False),
    ("1 != 2", True),
    ("{ a = 1, b = 2 } == { b = 2, a = 1 }", True),
    ("1.5h == 90m", True),
    ("5s", Duration(5_000_000_000)),
    ('if 1 == 1 then "a" else "b"', "a"),
    ('"n=${1.50} l=${[1, 2]} m=${{ b = 1, a = "x" }} d=${90m} ${null} ${true}"', "n=1.5 l=[1, 2] m={a = x, b = 1} d=90m null true"),
    ("'no $escapes \\here'", "no $escapes \\here"),
    ("<<-T\n    a\n      b ${1 + 1}\n    T\n", "a\n  b 2"),
    ("<<T\n a\nT\n", " a"),
    ('"\\q\\$"', "\\q$"),
]


@pytest.mark.parametrize(("text", "value"), VALUES)
def test_value(spark, text, value):
    assert evaluate(spark, parse_expression(text)) == value


@pytest.mark.parametrize("text", ['1 + "x"', "nope", '"a" | nope', '"a" | split', "if 1 then 2 else 3", 'if true then 1 else "a"', "1 + 2 == 3", '[1, "a"]', 'env("BLOCKLOOM_UNSET")', 'exec("true")', "[1] | trim"])
def test_error(spark, text):
    with pytest.raises(ValueError):
        evaluate(spark, parse_expression(text))


def test_pipe_binds_tighter_than_plus(spark):
    with pytest.raises(ValueError):
        evaluate(spark, parse_expression('"a" + "b" | lines'))


def test_strict_and_lenient(spark):
    scope = Scope()
    scope.define("image", {"id": literal("x")}, "block")
    text = parse_expression('"at ${image.ref}"')
    assert evaluate(spark, text, scope, strict=False) == "at ${image.ref}"
    with pytest.raises(ValueError):
        evaluate(spark, text, scope)
    with pytest.raises(ValueError):
        evaluate(spark, parse_expression("gone.ref"), scope, strict=False)
    with pytest.raises(ValueError):
        scope.define("image", {}, "let")


def test_null_condition_raises(spark):
    df = spark.sql("SELECT CAST(NULL AS BOOLEAN) AS c")
    from blockloom.plans.compiler import select

    with pytest.raises(Exception, match="condition is null"):
        select(df, {"x": parse_expression('if c then "a" else "b"')}).collect()


def test_env(spark, monkeypatch):
    monkeypatch.setenv("BLOCKLOOM_SET", "v")
    assert evaluate(spark, parse_expression('env("BLOCKLOOM_SET")')) == "v"
    assert evaluate(spark, parse_expression('env("BLOCKLOOM_UNSET", "d")')) == "d"
    assert evaluate(spark, parse_expression('secret("BLOCKLOOM_SET")')) == "v"


def test_glob(spark, tmp_path):
    for n in ("b.txt", "a.txt", "c.md"):
        (tmp_path / n).write_text(n)
    assert evaluate(spark, parse_expression(f'glob("{tmp_path}/*.txt") | basename')) == ["a.txt", "b.txt"]


@pytest.mark.parametrize(("text", "ns", "shown"), [("1.5h", 5_400_000_000_000, "90m"), ("0s", 0, "0s"), ("1ns", 1, "1ns"), ("1500us", 1_500_000, "1500us"), ("48h", 172_800_000_000_000, "2d")])
def test_durations(text, ns, shown):
    assert parse_duration(text) == ns
    assert format_duration(ns) == shown


def test_bad_durations():
    for bad in ("-1s", "1x", "s", "99999999999d"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_validate():
    validate(["a"], list_of(STRING))
    validate(None, optional(STRING))
    validate(D(1), union_of(STRING, NUMBER))
    validate({"k": True}, map_of(BOOL))
    for value, t, where in ((["a", D(1)], list_of(STRING), r"\[1\]"), ({"k": D(1)}, map_of(STRING), r"\.k"), ("x", BOOL, "expected bool"), (None, STRING, "null"), ({"a": D(1)}, struct_of({"a": STRING}), r"\.a"), (True, union_of(STRING, NUMBER), r"string \| number")):
        with pytest.raises(ValueTypeError, match=where):
            validate(value, t)


def test_parameters_and_display():
    assert [parameter(x) for x in ("true", "3", "1.5", "x")] == [True, D(3), D("1.5"), "x"]
    assert display({"b": [D("1.0")], "a": None}) == "{a = null, b = [1]}"


def test_statements():
    m = parse('# about\n\nimport "./mods"\n# p\nparam n = 3\nlet x : [string] = ["a"]\npre protected f[a, b] = go.fmt { k = a, j = { "x y" = 1 } }\nd = exec {}\ntarget default = [f, m.d]\noutput o = d.x\n')
    kinds = [type(s).__name__ for s in m.statements]
    assert m.doc == "about" and kinds == ["Import", "Param", "Let", "Block", "Block", "Target", "Output"]
    block = m.statements[3]
    assert (block.phase, block.protected, block.keys, block.provider, block.resource) == ("pre", True, ("a", "b"), "go", "fmt")
    assert m.statements[1].doc == "p" and m.statements[4].resource == "exec"


@pytest.mark.parametrize("text", ["let x =", "x = a.b {", 'let x = "a', "param p", "param p = []", "let x = <<E\nabc", "a = b { k = 1 k = 2 }", "let x : int = 1"])
def test_parse_errors(text):
    with pytest.raises(ParseError, match=r"^\d+:\d+: "):
        parse(text)


def test_error_shows_the_place():
    with pytest.raises(ParseError) as e:
        parse("let a = 1\nlet b = }")
    assert str(e.value).endswith("let b = }\n        ^") and e.value.line == 2
