"""The registered queries of the engine's own operators over the supplied tables, with their SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import types
from blockloom.functions.checks import departures
from blockloom.functions.types import duration_column, duration_text
from blockloom.operators import expansion, graph, hashing, logs, planning, reach
from blockloom.plans.compiler import select
from blockloom.plans.engine import Engine
from blockloom.plans.loader import load
from blockloom.plans.parser import parse_expression
from blockloom.plans.providers import Registry, default_registry
from blockloom.plans.state import MemoryStore
from blockloom.sources import code, digests, dockerfile, files, imports
from blockloom.streaming.failures import stream_attributed, stream_failures, with_state_store
from blockloom.streaming.suites import stream_suites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expressions(df: DataFrame, **texts: str) -> DataFrame:
    return select(df, {k: parse_expression(t) for k, t in texts.items()})


# Expressions.


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def expr_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", "text").transform(lambda d: select(d, {"digest": parse_expression("text | sha256"), "doc_id": parse_expression("doc_id")})).select(F.col("doc_id").cast("long"), "digest")


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: x <> ''), '|') AS lines FROM documents")
def expr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "documents"), doc_id="doc_id", lines="text | lines")
    return out.select(F.col("doc_id").cast("long"), F.array_join("lines", "|").alias("lines"))


@query("SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n FROM documents")
def expr_uniq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "documents"), doc_id="doc_id", words='text | split(" ") | uniq')
    return out.select(F.col("doc_id").cast("long"), F.size("words").cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_replace(chr(9) || ' ' || chr(10) || text || chr(13) || chr(10), '^\s+|\s+$', '', 'g') AS trimmed FROM documents")
def expr_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "documents"), doc_id="doc_id", trimmed='"\\t \\n${text}\\r\\n" | trim')
    return out.select(F.col("doc_id").cast("long"), "trimmed")


@query("SELECT p_partkey, p_brand || ': ' || p_name || '!' AS label FROM part")
def expr_add_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "part"), p_partkey="p_partkey", label='p_brand + ": " + p_name + "!"')
    return out.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT n_nationkey, (n_regionkey = 1 OR n_name = 'CHINA') AS known, CASE WHEN n_regionkey = 1 THEN 'R' ELSE 'other' END AS label FROM nation")
def expr_bool_and_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "nation"), n_nationkey="n_nationkey", known='if n_regionkey == 1 then true else n_name == "CHINA"', label="if n_regionkey == 1 then 'R' else 'other'")
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT page_id, array_to_string(string_split(url, '/'), '|') AS parts FROM pages")
def expr_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "pages"), page_id="page_id", parts='url | split("/")')
    return out.select(F.col("page_id").cast("long"), F.array_join("parts", "|").alias("parts"))


_STRIPPED = r"regexp_replace(url, '(/+\.?)+$', '')"


@query(rf"SELECT page_id, CASE WHEN b IN ('.', '..') THEN '' ELSE b END AS base FROM (SELECT page_id, regexp_replace({_STRIPPED}, '^.*/', '') AS b FROM pages)")
def expr_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "pages"), page_id="page_id", base="url | basename")
    return out.select(F.col("page_id").cast("long"), "base")


@query(rf"SELECT page_id, CASE WHEN t NOT LIKE '%/%' THEN '' WHEN u = '' THEN '/' ELSE u END AS dir FROM (SELECT page_id, {_STRIPPED} AS t, regexp_replace(regexp_replace({_STRIPPED}, '/+[^/]*$', ''), '(/+\.)+$', '') AS u FROM pages)")
def expr_dirname(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "pages"), page_id="page_id", dir="url | dirname")
    return out.select(F.col("page_id").cast("long"), "dir")


@query("SELECT p_partkey, 'part:' || p_name AS before, p_name || '.txt' AS after FROM part")
def expr_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "part"), p_partkey="p_partkey", before='p_name | prefix("part:")', after='p_name | suffix(".txt")')
    return out.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT p_partkey, p_brand || '/' || CAST(p_size AS VARCHAR) || ' [' || p_type || ', ' || p_name || ']' AS label FROM part")
def expr_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "part"), p_partkey="p_partkey", label='"${p_brand}/${p_size} ${[p_type, p_name]}"')
    return out.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE 'later' END END AS todo FROM orders")
def expr_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "orders"), o_orderkey="o_orderkey", todo='if o_orderstatus == "F" then "done" else if o_orderpriority == "1-URGENT" then "now" else "later"')
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT l_returnflag = l_linestatus AS same, l_returnflag <> 'N' AS returned, false AS mixed, count(*) AS n FROM lineitem GROUP BY 1, 2")
def expr_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "lineitem"), same="l_returnflag == l_linestatus", returned='l_returnflag != "N"', mixed="l_linenumber == l_returnflag")
    return out.groupBy("same", "returned", "mixed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey + o_custkey + 1 AS total FROM orders")
def expr_add_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "orders"), o_orderkey="o_orderkey", total="o_orderkey + o_custkey + 1")
    return out.select(F.col("o_orderkey").cast("long"), F.col("total").cast("long"))


@query("SELECT c_custkey, array_to_string(list_concat([c_name], [c_mktsegment, 'x']), '|') AS parts FROM customer")
def expr_add_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions(table(spark, sf_dir, "customer"), c_custkey="c_custkey", parts='[c_name] + [c_mktsegment, "x"]')
    return out.select(F.col("c_custkey").cast("long"), F.array_join("parts", "|").alias("parts"))


@query("SELECT n_nationkey, 'A' AS picked, n_name = 'x' AS hit FROM nation")
def expr_map_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").withColumn("m", F.create_map(F.lit("a"), F.lit("A"), F.lit("n"), F.col("n_name")))
    out = expressions(df, n_nationkey="n_nationkey", picked="m.a", hit='m == { a = "A", n = "x" }')
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def expr_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k STRING"))
    out = expressions(df, event_id="event_id", k="p.k")
    return out.withColumn("event_id", F.col("event_id").cast("long"))


@query("""SELECT p_partkey, 'part: ' || p_name || chr(10) || '  of ' || p_brand || chr(10) || 'end' AS text, p_size * 3 + CAST(0.5 AS DECIMAL(4, 1)) AS sum, CASE WHEN p_size % 2 = 0 THEN '1500ms' ELSE '1h' END AS wait FROM part""")
def expr_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heredoc over lines, numbers, and durations in text."""
    df = table(spark, sf_dir, "part").withColumn("even", F.col("p_size") % 2 == 0)
    text = "<<-END\n    part: ${p_name}\n      of ${p_brand}\n    end\n    END\n"
    out = expressions(df, p_partkey="p_partkey", text=text, sum="p_size + p_size + p_size + 0.5", wait='if even then "${1500ms}" else "${60m}"')
    return out.select(F.col("p_partkey").cast("long"), "text", F.col("sum").cast("decimal(20,1)").alias("sum"), "wait")


_UNITS = "CASE event_id % 7 WHEN 0 THEN 'ns' WHEN 1 THEN 'us' WHEN 2 THEN 'ms' WHEN 3 THEN 's' WHEN 4 THEN 'm' WHEN 5 THEN 'h' ELSE 'd' END"
_SIZES = "CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 WHEN 4 THEN 60000000000 WHEN 5 THEN 3600000000000 ELSE 86400000000000 END"


def _fitting(df: DataFrame, c: str) -> DataFrame:
    """df with c as the BIGINT that SQL makes of it; where some value is beyond one, and SQL fails, as the DECIMAL(38, 0) that it is."""
    whole = F.col(c).between(-(1 << 63), (1 << 63) - 1)
    return df.withColumn(c, F.col(c).cast("long")) if df.where(~whole).isEmpty() else df


@query(f"SELECT event_id, CAST((user_id * 2 + 1) * ({_SIZES}) AS BIGINT) // 2 AS ns FROM events")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("text", F.expr(f"concat(user_id, '.5', {_UNITS})"))
    return _fitting(df.select("event_id", duration_column(F.col("text"), wide=True).alias("ns")), "ns")


@query("""SELECT event_id, CASE WHEN ns = 0 THEN '0s' WHEN ns % 86400000000000 = 0 THEN (ns // 86400000000000) || 'd' WHEN ns % 3600000000000 = 0 THEN (ns // 3600000000000) || 'h' WHEN ns % 60000000000 = 0 THEN (ns // 60000000000) || 'm' WHEN ns % 1000000000 = 0 THEN (ns // 1000000000) || 's' WHEN ns % 1000000 = 0 THEN (ns // 1000000) || 'ms' WHEN ns % 1000 = 0 THEN (ns // 1000) || 'us' ELSE ns || 'ns' END AS shown
FROM (SELECT event_id, event_id * 1500 * (CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN 60000 ELSE 2400000000 END) AS ns FROM events)""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.expr("CAST(event_id AS DECIMAL(20, 0)) * 1500 * (CASE WHEN user_id % 3 = 0 THEN 1L WHEN user_id % 3 = 1 THEN 60000L ELSE 2400000000L END)")
    return table(spark, sf_dir, "events").select("event_id", duration_text(ns).alias("shown"))


@query(f"SELECT user_id, CAST(sum(CAST((user_id * 2 + 1) * ({_SIZES}) AS BIGINT) // 2) AS BIGINT) AS ns FROM events GROUP BY user_id")
def duration_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("text", F.expr(f"concat(user_id, '.5', {_UNITS})"))
    return _fitting(graph.checkpointed(df.groupBy("user_id").agg(F.sum(duration_column(F.col("text"), wide=True)).alias("ns"))), "ns")


# Whole pipelines.


def _pipeline(spark: SparkSession, text: str, store: MemoryStore | None = None, registry: Registry | None = None) -> Engine:
    registry = registry or default_registry()
    return Engine(spark, load(spark, text, registry), registry, store or MemoryStore(), f"{graph_folder(spark)}/blocks-{uuid.uuid4().hex}")


@query("""SELECT 'at[' || r_name || ']' AS block, 'path' AS field, 'data/' || r_name || '.parquet' AS value FROM region UNION ALL SELECT 'name[' || r_name || ']', 'low', r_name || '.parquet' FROM region
UNION ALL SELECT 'one', 'picked', 'ASIA.parquet' UNION ALL SELECT 'all', 'n', 'done'""")
def pipeline_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline with a slice for each region: expanded, aligned by key, applied, and read from its state."""
    regions = ", ".join(f'"{r[0]}"' for r in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect())
    text = f'let r = [{regions}]\nat[r] = value {{ path = "data/${{r}}.parquet" }}\nname[r] = value {{ low = at.path | basename }}\none = value {{ picked = name["ASIA"].low }}\nall = value {{ n = "done", depends_on = [name] }}\n'
    engine = _pipeline(spark, text)
    engine.apply(jobs=4)
    return spark.createDataFrame([(b, k, str(v)) for b, s in engine.store.all().items() for k, v in s.outputs.items()], "block string, field string, value string")


@query("""WITH s AS (SELECT 'c' || c_custkey AS block, 'n' || c_nationkey AS up, c_acctbal >= 0 AS passed, c_custkey % 9 = 4 AS changed, c_custkey % 11 = 5 AS new FROM customer), n AS (SELECT 'n' || n_nationkey AS block, n_nationkey % 5 = 2 AS changed FROM nation)
SELECT block, CASE WHEN new THEN 'create' WHEN dirty OR NOT passed THEN 'update' ELSE 'none' END AS action, dirty FROM (SELECT s.block, s.new, s.passed, s.changed OR s.new OR n.changed AS dirty FROM s JOIN n ON n.block = s.up)
UNION ALL SELECT block, CASE WHEN changed THEN 'update' ELSE 'none' END, changed FROM n""")
def pipeline_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tests that stand on their nations: those that failed are run again though nothing changed, and those whose nation changed."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    blocks = c.select(name("c", "c_custkey").alias("block")).unionByName(n.select(name("n", "n_nationkey").alias("block"))).withColumn("content_hash", F.lit("now"))
    stored = lambda changed: F.when(changed, "before").otherwise("now").alias("content_hash")
    state = c.where("c_custkey % 11 <> 5").select(name("c", "c_custkey").alias("block"), stored(F.col("c_custkey") % 9 == 4), (F.col("c_acctbal") >= 0).alias("passed"))
    state = state.unionByName(n.select(name("n", "n_nationkey").alias("block"), stored(F.col("n_nationkey") % 5 == 2), F.lit(None).cast("boolean").alias("passed")))
    edges = c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), F.lit("dependency").alias("kind"))
    return planning.plan_actions(blocks, state, edges, rerun_failed=True)


# Types.


_SHAPES = "CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '\"x\"' WHEN 2 THEN 'true' WHEN 3 THEN '[1, 2, \"y\"]' WHEN 4 THEN '{\"b\": 1, \"a\": \"s\"}' WHEN 5 THEN 'null' ELSE '[1, 2]' END"
_GOT = "CASE event_id % 7 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'bool' WHEN 4 THEN 'struct' WHEN 5 THEN 'null' ELSE 'list' END"


@query(f"""SELECT event_id, shape, path, expected, got FROM (
SELECT event_id, 'list' AS shape, CASE event_id % 7 WHEN 3 THEN '.v[2]' ELSE '.v' END AS path, CASE event_id % 7 WHEN 3 THEN 'number' ELSE '[number]' END AS expected, CASE event_id % 7 WHEN 3 THEN 'string' ELSE {_GOT} END AS got FROM events WHERE event_id % 7 <> 6
UNION ALL SELECT event_id, 'map', CASE event_id % 7 WHEN 4 THEN '.v.a' ELSE '.v' END, CASE event_id % 7 WHEN 4 THEN 'number' ELSE '{{string = number}}' END, CASE event_id % 7 WHEN 4 THEN 'string' ELSE {_GOT} END FROM events
UNION ALL SELECT event_id, 'union', '.v', 'number | [number]', {_GOT} FROM events WHERE event_id % 7 IN (1, 2, 3, 4, 5)
UNION ALL SELECT event_id, 'optional', '.v', 'bool', {_GOT} FROM events WHERE event_id % 7 NOT IN (2, 5)
UNION ALL SELECT event_id, 'struct', '.p.k', 'string', 'number' FROM events UNION ALL SELECT event_id, 'lacking', '.w', 'number', 'null' FROM events)""")
def type_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties beside values of mixed shapes, held against declared types: where each departs first."""
    text = F.concat(F.lit('{"p": '), "props", F.lit(', "v": '), F.expr(_SHAPES), F.lit("}"))
    df = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    number = types.NUMBER
    declared = {
        "list": {"p": types.struct_of({"k": number}), "v": types.list_of(number)}, "map": {"v": types.map_of(number), "w": types.optional(number)}, "union": {"v": types.union_of(number, types.list_of(number))},
        "optional": {"v": types.optional(types.BOOL)}, "struct": {"v": types.ANY, "p": types.struct_of({"k": types.STRING})}, "lacking": {"p": types.map_of(number), "w": number},
    }
    found = [departures(df.withColumn("shape", F.lit(k)), "text", types.struct_of(t)) for k, t in declared.items()]
    return functools.reduce(DataFrame.unionByName, found).select("event_id", "shape", "path", "expected", "got")


# Expansion.


@query("SELECT n_nationkey, n_name || '[' || r || ', ' || s || ']' AS slice FROM nation CROSS JOIN (VALUES ('amd64'), ('arm64')) a(r) CROSS JOIN (VALUES ('F'), ('O'), ('P')) b(s)")
def matrix_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"arch": ["amd64", "arm64"], "status": ["F", "O", "P"]}
    slices = expansion.cartesian(spark, keys).orderBy("place").collect()  # a matrix of configured values
    values = F.array(*(F.struct(*(F.lit(r[k]).alias(k) for k in keys)) for r in slices))
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.inline(values))
    return df.select("n_nationkey", expansion.slice_name(F.col("n_name"), F.col("arch"), F.col("status")).alias("slice"))


@query("""WITH r AS (SELECT r_regionkey, r_name, dense_rank() OVER (ORDER BY r_name) - 1 AS i FROM region), g AS (SELECT DISTINCT c_mktsegment AS segment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS j FROM customer)
SELECT r_name AS region, segment, i * (SELECT count(*) FROM g) + j AS place, count(c_custkey) AS n FROM r CROSS JOIN g LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey AND c_mktsegment = segment GROUP BY 1, 2, 3""")
def matrix_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice for each region and market segment, in its place, with the number of its customers."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    listed = lambda df, column: [x[0] for x in df.select(column).distinct().orderBy(column).collect()]  # noqa: E731 a pipeline's keys: regions and segments
    slices = expansion.cartesian(spark, {"region": listed(r, "r_name"), "segment": listed(c, "c_mktsegment")})
    at = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    counts = at.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return slices.join(counts, ["region", "segment"], "left").select("region", "segment", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT a.o_orderstatus AS status, a.o_orderpriority AS priority, a.n AS n, b.total AS total FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) a JOIN (SELECT o_orderstatus, o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1, 2) b USING (o_orderstatus, o_orderpriority)")
def matrix_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    keys = ["status", "priority"]
    return expansion.aligned(o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), o.groupBy(*keys).agg(F.sum("o_custkey").cast("decimal(38,0)").alias("total")), keys, keys).select("status", "priority", "n", F.col("total").cast("long"))


# Hashes and changes.


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS input_hash FROM orders""")
def input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey")
    return df.select("o_orderkey", hashing.input_hash(df).alias("input_hash"))


_MERKLE = """WITH s AS (SELECT o_custkey AS block, string_agg(CAST(o_orderkey AS VARCHAR) || chr(31) || sha256(o_orderstatus), chr(31) ORDER BY CAST(o_orderkey AS VARCHAR)) AS t FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS block, sha256(sha256(c_name) || chr(30) || coalesce(t, '') || chr(30)) AS content_hash FROM customer LEFT JOIN s ON block = c_custkey"""


@query(_MERKLE)
def merkle_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("block"), F.sha2("c_name", 256).alias("input_hash"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("block"), F.col("o_orderkey").cast("string").alias("key"), F.sha2("o_orderstatus", 256).alias("hash"))
    return hashing.content_hashes(blocks, orders, spark.createDataFrame([], "block string, parent string, hash string"))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as a graph; a customer hangs on its nation, every fifth on its region as well."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    phase = F.when(F.col("name").rlike("^r"), "pre").when(F.col("name").rlike("^n"), "default").otherwise("post")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("name")).unionByName(n.select(name("n", "n_nationkey").alias("name"))).unionByName(c.select(name("c", "c_custkey").alias("name")))
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.lit("dependency").alias("kind"))
    edges = edges.unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), F.lit("dependency").alias("kind")))
    far = c.where("c_custkey % 5 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = edges.unionByName(far.select(name("r", "n_regionkey").alias("src"), name("c", "c_custkey").alias("dst"), F.lit("ordering").alias("kind")))
    return nodes.withColumn("phase", phase), edges


_NODES = "nodes AS (SELECT 'r' || r_regionkey AS name FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer)"
_EDGES = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'dependency' AS kind FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'dependency' FROM customer UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 'ordering' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0)"


@query(f"""WITH {_NODES}, {_EDGES}, r AS (SELECT 'r' || r_regionkey AS block, sha256(sha256('r' || r_regionkey) || chr(30) || chr(30)) AS h FROM region),
n AS (SELECT 'n' || n_nationkey AS block, sha256(sha256('n' || n_nationkey) || chr(30) || chr(30) || r.block || chr(31) || r.h) AS h FROM nation JOIN r ON r.block = 'r' || n_regionkey),
c AS (SELECT 'c' || c_custkey AS block, sha256(sha256('c' || c_custkey) || chr(30) || chr(30) || n.block || chr(31) || n.h) AS h FROM customer JOIN n ON n.block = 'n' || c_nationkey)
SELECT block, h AS content_hash FROM r UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c""")
def merkle_nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _places(spark, sf_dir)
    blocks = nodes.select(F.col("name").alias("block"), F.sha2("name", 256).alias("input_hash"))
    return hashing.merkle(blocks, spark.createDataFrame([], "block string, key string, hash string"), nodes, edges)


_CHANGED = "CASE WHEN name IN ('r1', 'n3', 'n7') OR name LIKE 'c%9' THEN 'new' || name ELSE name END"


@query(f"""WITH {_NODES}, {_EDGES}, o AS (SELECT name, sha256(name) AS was, sha256({_CHANGED}) AS now FROM nodes),
r AS (SELECT name AS block, sha256(was || chr(30) || chr(30)) AS a, sha256(now || chr(30) || chr(30)) AS b FROM o WHERE name LIKE 'r%'),
n AS (SELECT o.name AS block, sha256(was || chr(30) || chr(30) || r.block || chr(31) || r.a) AS a, sha256(now || chr(30) || chr(30) || r.block || chr(31) || r.b) AS b FROM o JOIN edges ON dst = o.name JOIN r ON r.block = src WHERE o.name LIKE 'n%'),
c AS (SELECT o.name AS block, sha256(was || chr(30) || chr(30) || n.block || chr(31) || n.a) AS a, sha256(now || chr(30) || chr(30) || n.block || chr(31) || n.b) AS b FROM o JOIN edges ON dst = o.name AND kind = 'dependency' JOIN n ON n.block = src)
SELECT block, a AS old_hash, b AS content_hash FROM (SELECT * FROM r UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c) WHERE a <> b OR block IN ('r1', 'n3', 'n7') OR block LIKE 'c%9'""")
def merkle_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some regions, nations and customers change: what is hashed again, without the rest of the graph."""
    nodes, edges = _places(spark, sf_dir)
    none = spark.createDataFrame([], "block string, key string, hash string")
    blocks = nodes.select(F.col("name").alias("block"), F.sha2("name", 256).alias("input_hash"))
    state, ways = map(graph.checkpointed, hashing.merkle_tree(blocks, none, nodes, edges))
    new = nodes.where(F.col("name").isin("r1", "n3", "n7") | F.col("name").like("c%9")).select(F.col("name").alias("block"), F.sha2(F.expr(_CHANGED), 256).alias("input_hash"))
    return hashing.merkle_changed(state, ways, hashing.owned(new, none)).select("block", "old_hash", "content_hash")


_BEFORE, _AFTER = "o_orderkey % 11 <> 0", "o_orderkey % 13 <> 0"
_SNAPSHOTS = f"b AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE {_BEFORE}), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE {_AFTER})"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    now = F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus"))
    return o.where(_BEFORE).select("o_orderkey", F.col("o_orderstatus").alias("v")), o.where(_AFTER).select("o_orderkey", now.alias("v"))


@query(f"WITH {_SNAPSHOTS} SELECT coalesce(b.k, a.k) AS o_orderkey, b.v AS old, a.v AS new, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'removed' WHEN b.v IS NOT DISTINCT FROM a.v THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.k = b.k")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return planning.state_diff(before, after, "o_orderkey", "v")


_KEYS = "b AS (SELECT o_custkey AS block, o_orderkey AS key, o_orderstatus AS h FROM orders WHERE o_orderkey % 11 <> 0), a AS (SELECT o_custkey AS block, o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 13 <> 0), d AS (SELECT coalesce(b.block, a.block) AS block, coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.block = b.block AND a.key = b.key WHERE a.h IS DISTINCT FROM b.h)"


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("block"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("hash"))
    number = F.col("key").cast("long")
    return planning.resolve_diff(o.where(number % 11 != 0), o.where(number % 13 != 0).withColumn("hash", F.when(number % 7 == 0, "Z").otherwise(F.col("hash"))))


@query(f"WITH {_KEYS} SELECT CAST(block AS VARCHAR) AS block, CAST(key AS VARCHAR) AS key, change FROM d")
def resolve_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"""WITH {_KEYS}, k AS (SELECT block, count(DISTINCT key || ' ' || change) AS n, string_agg(DISTINCT key || ' ' || change, ', ' ORDER BY key || ' ' || change) AS t FROM d GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS block, CASE WHEN c_custkey % 10 = 0 THEN 'n' || c_nationkey || ' changed' WHEN n IS NULL THEN 'inputs changed' WHEN n <= 3 THEN t ELSE n || ' sources changed' END AS reason FROM customer LEFT JOIN k ON k.block = c_custkey""")
def change_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("block", F.col("c_custkey").cast("string"))
    up = c.where("c_custkey % 10 = 0").select("block", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    return planning.reasons(c, up, _diff(spark, sf_dir))


@query(f"""WITH {_NODES}, {_EDGES}, s AS (SELECT name, CASE WHEN name LIKE '%3' THEN 'old' ELSE 'h' END AS h FROM nodes WHERE name NOT LIKE '%7'),
differs AS (SELECT n.name FROM nodes n LEFT JOIN s ON s.name = n.name WHERE s.name IS NULL OR s.h <> 'h'),
d1 AS (SELECT name FROM differs UNION SELECT dst FROM edges JOIN differs ON src = name WHERE kind = 'dependency'),
d2 AS (SELECT name FROM d1 UNION SELECT dst FROM edges JOIN d1 ON src = name WHERE kind = 'dependency')
SELECT n.name AS block, CASE WHEN s.name IS NULL THEN 'create' WHEN d2.name IS NOT NULL THEN 'update' ELSE 'none' END AS action, d2.name IS NOT NULL AS dirty FROM nodes n LEFT JOIN s ON s.name = n.name LEFT JOIN d2 ON d2.name = n.name""")
def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _places(spark, sf_dir)
    blocks = nodes.select(F.col("name").alias("block"), F.lit("h").alias("content_hash"))
    state = nodes.where("name NOT LIKE '%7'").select(F.col("name").alias("block"), F.when(F.col("name").like("%3"), "old").otherwise("h").alias("content_hash"))
    return planning.plan_actions(blocks, state, edges)


@query(f"""WITH {_EDGES}, d0 AS (SELECT 'r' || r_regionkey AS name FROM region WHERE r_regionkey < 2 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 0),
d1 AS (SELECT name FROM d0 UNION SELECT dst FROM edges JOIN d0 ON src = name WHERE kind = 'dependency'), d2 AS (SELECT name FROM d1 UNION SELECT dst FROM edges JOIN d1 ON src = name WHERE kind = 'dependency')
SELECT name AS block FROM d2""")
def dirty_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _places(spark, sf_dir)
    r = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("block"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 6 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("block"))
    return planning.dirty(edges, r.unionByName(n))


@query("SELECT CAST(o_custkey AS VARCHAR) AS block, o_orderpriority AS param FROM orders WHERE o_custkey % 2 = 0 AND o_orderpriority <> '5-LOW' GROUP BY 1, 2")
def active_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("block"), F.col("o_orderpriority").alias("param")).distinct()
    active = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("block"))
    return planning.active_parameters(refs, active, spark.sql("SELECT '5-LOW' AS param"))


# Graphs.


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, walk AS (SELECT name AS root, name FROM nodes UNION SELECT root, src FROM walk JOIN edges ON dst = name) SELECT root, name FROM walk")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _places(spark, sf_dir)
    return graph.closure(edges, nodes.select("name"))


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'r1' AS name UNION SELECT dst FROM walk JOIN edges ON src = name) SELECT name FROM walk")
def graph_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _places(spark, sf_dir)
    return graph.transitive_dependents(edges, spark.sql("SELECT 'r1' AS name"))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, walk AS (SELECT name, 0 AS depth FROM nodes WHERE name NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, depth + 1 FROM walk JOIN edges ON src = name) SELECT name, max(depth) AS depth FROM walk GROUP BY name")
def graph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(*_places(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT dst AS name, coalesce(min(src) FILTER (kind = 'dependency'), min(src)) AS parent FROM edges GROUP BY dst")
def graph_primary_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.primary_parents(_places(spark, sf_dir)[1])


@query("WITH n AS (SELECT n_name AS name, n_regionkey % 3 AS p FROM nation) SELECT a.name AS src, b.name AS dst, 'ordering' AS kind FROM n a JOIN n b ON a.p < b.p")
def phase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.element_at(F.array(F.lit("pre"), F.lit("default"), F.lit("post")), F.col("n_regionkey") % 3 + 1)
    return graph.phase_edges(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), phase.alias("phase")))


_STEPS = 110


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers in chains of 110, each with a shorter way past every tenth: long ways and diamonds."""
    c = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS k")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    last = f"k div {_STEPS}"
    ways = c.join(c.select(F.col("k").alias("j")), F.expr(f"j = k + 1 AND j div {_STEPS} = {last}")).unionByName(c.where("k % 10 = 0").join(c.select(F.col("k").alias("j")), F.expr(f"j = k + 5 AND j div {_STEPS} = {last}")))
    return c.select(name(F.col("k")).alias("name")), ways.select(name(F.col("k")).alias("src"), name(F.col("j")).alias("dst"), F.lit("dependency").alias("kind"))


@query(f"SELECT 'c' || c_custkey AS name, c_custkey % {_STEPS} - CASE WHEN c_custkey < {_STEPS} THEN (SELECT min(c_custkey) FROM customer) ELSE 0 END AS depth FROM customer")
def graph_deep_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(*_chains(spark, sf_dir))


_WITH_BACK = f"""ways AS (SELECT 'c' || c_custkey AS src, 'c' || (c_custkey + 1) AS dst FROM customer WHERE (c_custkey + 1) % {_STEPS} <> 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)
UNION SELECT 'c' || c_custkey, 'c' || (c_custkey + 5) FROM customer WHERE c_custkey % 10 = 0 AND (c_custkey + 5) // {_STEPS} = c_custkey // {_STEPS} AND c_custkey + 5 IN (SELECT c_custkey FROM customer)
UNION SELECT 'c' || c_custkey, 'c' || (c_custkey - 9) FROM customer WHERE c_custkey % {_STEPS} = 25 UNION SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 97 = 3)"""


@query(f"""WITH RECURSIVE {_WITH_BACK}, walk AS (SELECT src AS a, dst AS b FROM ways UNION SELECT a, dst FROM walk JOIN ways ON src = b), ring AS (SELECT a FROM walk WHERE a = b)
SELECT x.a AS name, min(x.b) AS cycle FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a WHERE x.a IN (SELECT a FROM ring) GROUP BY x.a""")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of customers with ways back and to themselves: what lies on cycles, and on which."""
    nodes, edges = _chains(spark, sf_dir)
    number = F.expr("CAST(substring(name, 2) AS BIGINT)")
    back = nodes.withColumn("k", number).select(F.col("name").alias("src"), F.expr(f"CASE WHEN k % {_STEPS} = 25 THEN concat('c', k - 9) END").alias("dst"))
    own = nodes.where(number % 97 == 3).select(F.col("name").alias("src"), F.col("name").alias("dst"))
    return graph.cycles(edges.select("src", "dst").unionByName(back.where("dst IS NOT NULL")).unionByName(own))


@query(f"SELECT name, depth, row_number() OVER (ORDER BY depth, name) AS number FROM (SELECT 'c' || c_custkey AS name, CAST(c_custkey % {_STEPS} - CASE WHEN c_custkey < {_STEPS} THEN (SELECT min(c_custkey) FROM customer) ELSE 0 END AS INTEGER) AS depth FROM customer)")
def graph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.order_numbers(*_chains(spark, sf_dir))


_KNOT = f"""ways AS (SELECT 'c' || c_custkey AS src, 'c' || (c_custkey + 1) AS dst FROM customer WHERE c_custkey % 7 <> 3 AND (c_custkey + 1) % {_STEPS} <> 0
UNION SELECT 'c' || c_custkey, 'c' || (c_custkey + 5) FROM customer WHERE c_custkey % 10 = 0 AND (c_custkey + 5) // {_STEPS} = c_custkey // {_STEPS}
UNION SELECT 'c' || c_custkey, 'c' || (c_custkey + 9) FROM customer WHERE c_custkey % 13 = 4 AND (c_custkey + 9) // {_STEPS} = c_custkey // {_STEPS}), known AS (SELECT 'c' || c_custkey AS name FROM customer),
w AS (SELECT src, dst FROM ways WHERE dst IN (SELECT name FROM known))"""


@query(f"""WITH RECURSIVE {_KNOT}, walk AS (SELECT name AS b, name AS a FROM known UNION SELECT b, dst FROM walk JOIN w ON src = a),
q AS (SELECT 'c' || o_custkey AS a, 'c' || (o_custkey - l_partkey % 120) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT q.a, q.b, q.n, CASE WHEN q.a IN (SELECT name FROM known) AND q.b IN (SELECT name FROM known) THEN walk.a IS NOT NULL END AS depends FROM q LEFT JOIN walk ON walk.a = q.a AND walk.b = q.b""")
def graph_depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every order line, whether its customer depends on one some places before it, by the index."""
    c = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS k")
    to = F.expr(f"filter(array(if(k % 7 <> 3 AND (k + 1) % {_STEPS} <> 0, k + 1, NULL), if(k % 10 = 0 AND (k + 5) div {_STEPS} = k div {_STEPS}, k + 5, NULL), if(k % 13 = 4 AND (k + 9) div {_STEPS} = k div {_STEPS}, k + 9, NULL)), x -> x IS NOT NULL)")
    name = lambda x: F.concat(F.lit("c"), F.col(x).cast("string"))
    edges = c.select("k", F.explode(to).alias("j")).join(c.select(F.col("k").alias("j")), "j", "left_semi").select(name("k").alias("src"), name("j").alias("dst"), F.lit("dependency").alias("kind"))
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = graph.tasks_of(spark, lines.count())
    asked = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = asked.select(name("o_custkey").alias("a"), F.concat(F.lit("c"), F.expr("CAST(o_custkey - l_partkey % 120 AS STRING)")).alias("b"))
    asked = asked.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return reach.depends(reach.reach_index(c.select(name("k").alias("name")), edges), asked)


_PHASES = "p AS (SELECT name, CASE left(name, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS p FROM nodes)"


@query(f"WITH {_NODES}, {_PHASES} SELECT a.name AS root, b.name AS name FROM p a JOIN p b ON b.p < a.p OR a.name = b.name")
def graph_phase_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _places(spark, sf_dir)
    return graph.without_barriers(graph.closure(graph.phase_barriers(nodes), nodes.select("name")))


_MEMBERS = "m AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'n' || c_nationkey || '[c' || c_custkey || ']' WHEN 1 THEN 'n' || c_nationkey || '.c' || c_custkey || '.x' ELSE 'n' || c_nationkey || 'c' || c_custkey END AS name FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation)"


@query(f"""WITH {_MEMBERS}, t AS (SELECT 'r' || n_regionkey AS target, 'n' || n_nationkey AS block FROM nation)
SELECT DISTINCT target, name FROM t JOIN m ON name = block OR starts_with(name, block || '.') OR starts_with(name, block || '[')""")
def graph_target_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.sql(_MEMBERS.removeprefix("m AS (").removesuffix(")").replace("FROM customer", "FROM {customer}").replace("FROM nation", "FROM {nation}"), customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    targets = table(spark, sf_dir, "nation").select(F.expr("concat('r', n_regionkey)").alias("target"), F.expr("concat('n', n_nationkey)").alias("block"))
    return graph.target_members(names, targets)


@query(f"WITH {_NODES}, {_PHASES} SELECT name, CAST(p AS INTEGER) AS depth FROM p")
def graph_phase_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _places(spark, sf_dir)
    return graph.without_barriers(graph.depths(graph.barrier_nodes(nodes), graph.phase_barriers(nodes)))


# Logs.


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as the lines of a test log: a user is a package, a purchase its end, and some lines are broken."""
    e = table(spark, sf_dir, "events")
    action = F.expr("CASE event_type WHEN 'click' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' WHEN 'view' THEN 'output' ELSE CASE WHEN event_id % 7 = 0 THEN 'skip' WHEN event_id % 3 = 0 THEN 'fail' ELSE 'pass' END END")
    test = F.when(F.col("event_type") != "purchase", F.concat(F.lit("T"), F.expr("event_id % 4")))
    line = F.to_json(F.struct(action.alias("Action"), F.concat(F.lit("u"), "user_id").alias("Package"), test.alias("Test"), F.lit(0.5).alias("Elapsed"), F.concat(F.lit("v"), F.col("event_id").cast("string"), F.lit("\n")).alias("Output")))
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, F.lit("not json")).otherwise(line).alias("line"))


_LOG = """e AS (SELECT event_id AS seq, 'u' || user_id AS Package, CASE WHEN event_type <> 'purchase' THEN 'T' || (event_id % 4) END AS Test,
CASE event_type WHEN 'click' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' WHEN 'view' THEN 'output' ELSE CASE WHEN event_id % 7 = 0 THEN 'skip' WHEN event_id % 3 = 0 THEN 'fail' ELSE 'pass' END END AS Action FROM events WHERE event_id % 50 <> 0)"""
_RUNS = f"WITH {_LOG}, r AS (SELECT *, coalesce(sum(CASE WHEN Test IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY Package ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e)"
_SUITES = f"""{_RUNS}, s AS (SELECT Package, CAST(run AS BIGINT) AS run, count(*) FILTER (Action = 'pass' AND Test IS NOT NULL) AS passed, count(*) FILTER (Action = 'fail' AND Test IS NOT NULL) AS failed, count(*) FILTER (Action = 'skip' AND Test IS NOT NULL) AS skipped, bool_or(Test IS NULL) AS ended, max(CASE WHEN Test IS NULL THEN Action END) AS verdict FROM r GROUP BY 1, 2), f AS (SELECT *, CASE verdict WHEN 'skip' THEN NULL ELSE verdict = 'pass' END AS ok, verdict = 'skip' AS whole FROM s)"""


_ENDED = "CASE WHEN whole THEN 0 ELSE passed END AS passed, CASE WHEN whole THEN 0 ELSE failed END AS failed, CASE WHEN whole THEN 0 ELSE skipped END AS skipped, CAST(0.5 AS DOUBLE) AS elapsed, verdict FROM f WHERE ended AND NOT (coalesce(ok, false) AND passed + failed + skipped = 0)"


def _with_verdict(df: DataFrame) -> DataFrame:
    return df.withColumn("verdict", F.when(F.col("ok").isNull(), "skip").when(F.col("ok"), "pass").otherwise("fail")).drop("ok")


@query(f"{_SUITES} SELECT Package, run, {_ENDED}")
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_verdict(logs.suite_summary(logs.test_events(_event_lines(spark, sf_dir))))


@query(f"""{_RUNS}, t AS (SELECT *, coalesce(sum(CASE WHEN Action IN ('pass', 'fail') THEN 1 ELSE 0 END) OVER (PARTITION BY Package, run, Test ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM r WHERE Test IS NOT NULL)
SELECT Package, Test, max(seq) FILTER (Action = 'fail') AS seq, coalesce(string_agg('v' || seq, chr(10) ORDER BY seq) FILTER (Action = 'output'), '') AS output FROM t GROUP BY Package, Test, run, turn HAVING max(seq) FILTER (Action = 'fail') IS NOT NULL""")
def suite_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.failure_output(logs.test_events(_event_lines(spark, sf_dir)))


@query(f"WITH {_LOG} SELECT bool_and(Action <> 'fail') AS passed, count(*) > 0 AS had_events FROM e WHERE Test IS NULL")
def suite_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.verdict(logs.test_events(_event_lines(spark, sf_dir)))


@query(f"""{_SUITES} SELECT Package, run, CASE WHEN ok IS NULL THEN 'skip' WHEN ok THEN 'ok  ' ELSE 'FAIL' END || ' ' || Package || ': ' || CASE WHEN whole THEN '' ELSE concat_ws(', ', CASE WHEN passed > 0 THEN passed || ' passed' END, CASE WHEN failed > 0 THEN failed || ' failed' END, CASE WHEN skipped > 0 THEN skipped || ' skipped' END) END AS text
FROM f WHERE ended AND NOT (coalesce(ok, false) AND passed + failed + skipped = 0)""")
def suite_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rendered(logs.suite_summary(logs.test_events(_event_lines(spark, sf_dir)))).select("Package", "run", "text")


@query(f"{_SUITES} SELECT Package, {_ENDED}")
def stream_suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream; equal to suite_summary but for run, as the tests show."""
    base = f"{graph_folder(spark)}/stream-{uuid.uuid4().hex}"
    _event_lines(spark, sf_dir).write.parquet(f"{base}/in")
    lines = spark.readStream.schema("seq long, line string").parquet(f"{base}/in")
    done = stream_suites(logs.test_events(lines)).writeStream.format("parquet").option("checkpointLocation", f"{base}/at").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    if done.exception():
        raise done.exception()
    return _with_verdict(spark.read.parquet(f"{base}/out"))


def _streamed(lines: DataFrame, schema: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work makes of lines as a stream, with its state in RocksDB."""
    spark = with_state_store(lines.sparkSession)
    base = f"{graph_folder(spark)}/stream-{uuid.uuid4().hex}"
    lines.write.parquet(f"{base}/in")
    done = work(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.format("parquet").option("checkpointLocation", f"{base}/at").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    if done.exception():
        raise done.exception()
    return lines.sparkSession.read.parquet(f"{base}/out")


@query(ORACLES["suite_failures"])
def stream_suite_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(_event_lines(spark, sf_dir), "seq long, line string", lambda lines: stream_failures(logs.test_events(lines)))


def graph_folder(spark: SparkSession) -> str:
    """The cluster's shared folder."""
    graph.ready_to_checkpoint(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _cargo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.expr("CASE event_type WHEN 'click' THEN concat('test m', user_id, '::t ... ok') WHEN 'error' THEN concat('test m', user_id, '::t ... FAILED') WHEN 'signup' THEN if(event_id % 3 = 0, concat('   Doc-tests u', user_id), concat('     Running unittests src/u', user_id, '.rs (x)')) WHEN 'purchase' THEN concat('test result: ', if(event_id % 2 = 0, 'ok', 'FAILED'), '. ', user_id, ' passed; ', event_id % 5, ' failed; 1 ignored; 0 measured; finished in 0.25s') ELSE 'running 2 tests' END")
    return e.select(F.col("event_id").alias("seq"), line.alias("line"), F.expr("event_id % 16").alias("log"))


@query("""SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'test' WHEN 'error' THEN 'test' WHEN 'signup' THEN 'suite' WHEN 'purchase' THEN 'result' ELSE 'running' END AS kind,
CASE WHEN event_type IN ('click', 'error') THEN 'm' || user_id || '::t' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'doc-tests u' || user_id WHEN event_type = 'signup' THEN 'src/u' || user_id || '.rs' END AS name, CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'FAILED' END AS status FROM events""")
def cargo_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.classified(_cargo_lines(spark, sf_dir)).select("seq", "kind", "name", "status")


@query("""WITH l AS (SELECT *, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'doc-tests u' || user_id WHEN event_type = 'signup' THEN 'src/u' || user_id || '.rs' END AS s FROM events)
SELECT event_id % 16 AS log, event_id AS seq, suite, event_id % 2 = 0 AS ok, user_id AS passed, event_id % 5 AS failed, CAST(1 AS BIGINT) AS ignored, CAST(0.25 AS DOUBLE) AS seconds
FROM (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY event_id % 16 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suite FROM l) WHERE event_type = 'purchase'""")
def cargo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.cargo_summary(_cargo_lines(spark, sf_dir), "log")


@query("""WITH l AS (SELECT *, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'doc-tests u' || user_id WHEN event_type = 'signup' THEN 'src/u' || user_id || '.rs' END AS s FROM events)
SELECT event_id % 16 AS log, event_id AS seq, last_value(s IGNORE NULLS) OVER (PARTITION BY event_id % 16 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suite FROM l""")
def stream_cargo_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(_cargo_lines(spark, sf_dir), "seq long, line string, log long", lambda lines: stream_attributed(lines, "log")).select("log", "seq", "suite")


@query("SELECT bool_and(event_id % 2 = 0) AS passed, count(*) > 0 AS had_events FROM events WHERE event_type = 'purchase'")
def cargo_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.cargo_verdict(_cargo_lines(spark, sf_dir))


_SECTIONS = "CASE event_type WHEN 'click' THEN 'header' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'failures' ELSE 'result' END END"


@query(f"""WITH k AS (SELECT event_id AS seq, event_id % 8 AS log, user_id, {_SECTIONS} AS kind FROM events), p AS (SELECT *, max(CASE WHEN kind IS NOT NULL THEN seq END) OVER (PARTITION BY log ORDER BY seq) AS at FROM k)
SELECT p.log, 'm' || h.user_id || '::t' AS name, coalesce(string_agg('line ' || p.seq, chr(10) ORDER BY p.seq) FILTER (p.kind IS NULL), '') AS output FROM p JOIN k h ON h.seq = p.at AND h.kind = 'header' GROUP BY p.log, p.at, h.user_id""")
def cargo_failure_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(f"CASE {_SECTIONS} WHEN 'header' THEN concat('---- m', user_id, '::t stdout ----') WHEN 'failures' THEN 'failures:' WHEN 'result' THEN 'test result: FAILED. 1 passed; 2 failed; 0 ignored' ELSE concat('line ', event_id) END")
    return logs.cargo_failures(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), line.alias("line"), F.expr("event_id % 8").alias("log")), "log")


@query("SELECT '/bin/u' || user_id AS executable FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1")
def cargo_last_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "bin").otherwise("lib")
    line = F.to_json(F.struct(F.lit("compiler-artifact").alias("reason"), F.concat(F.lit("/bin/u"), "user_id").alias("executable"), F.struct(F.array(kind).alias("kind"), F.lit("x").alias("name")).alias("target")))
    return logs.last_binary(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), line.alias("line")))


# Sources.


@query("""SELECT page_id, (regexp_matches(url, '(^|/)[^/]*-[^/]*($|/)') OR url LIKE '%.html' OR url LIKE '%.html/%') AND NOT (url LIKE '%/en/%' OR url LIKE 'en/%') AS ignored FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS url FROM pages)""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(files.ignore_rules("# comment\n*-*\n\n!**/en/**\n*.html\n"), "seq int, pattern string, negate boolean")
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return files.ignored(paths, rules).select("page_id", "ignored")


_WALKED = """SELECT page_id, concat('p/', CASE page_id % 17 WHEN 0 THEN 'node_modules' WHEN 1 THEN '.git' WHEN 2 THEN 'dist' WHEN 3 THEN 'build' WHEN 4 THEN 'out' WHEN 5 THEN '.next' WHEN 6 THEN '.nuxt' WHEN 7 THEN '.turbo'
WHEN 8 THEN '.vite' WHEN 9 THEN '.svelte-kit' WHEN 10 THEN 'coverage' WHEN 11 THEN '.cache' WHEN 12 THEN 'vendor' WHEN 13 THEN 'target' WHEN 14 THEN 'tmp' ELSE 'src' END, '/', page_id, CASE page_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsbuildinfo'
WHEN 2 THEN '.map' WHEN 3 THEN '.log' ELSE '/.DS_Store' END) AS path FROM pages"""


@query(f"SELECT page_id, path FROM ({_WALKED}) WHERE split_part(path, '/', 2) IN ('vendor', 'target', 'tmp', 'src') AND NOT (path LIKE '%.tsbuildinfo' OR path LIKE '%/.DS_Store')")
def source_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.source_walk(spark.sql(_WALKED.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages")))


_TREE = "SELECT concat('m/', CASE c_custkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN '_c' WHEN 3 THEN 'vendor/d' WHEN 4 THEN '.e' ELSE 'testdata' END, c_nationkey, '/f', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.txt' ELSE '.go' END) AS path FROM customer"


def _tree(spark: SparkSession, sf_dir: str, text: str = _TREE) -> DataFrame:
    return spark.sql(text.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


@query(f"SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM ({_TREE}) WHERE path LIKE '%.go' AND NOT regexp_matches(path, '(^|/)(\\.[^/]+|vendor|testdata)/')")
def go_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.go_packages(_tree(spark, sf_dir), "./...")


@query("SELECT c_custkey AS path, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['t' || c_nationkey || '.txt', 'd' || c_nationkey] ELSE ['x' || c_nationkey, 'y'] END) AS pattern FROM customer WHERE c_custkey % 3 < 2")
def go_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('package x\n', CASE c_custkey % 3 WHEN 0 THEN concat('//go:embed t', c_nationkey, '.txt all:d', c_nationkey, '\n') WHEN 1 THEN concat('//go:embed x', c_nationkey, ' y\n') ELSE '// go: embed z\n' END, 'var a string\n')")
    return code.go_embeds(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), text.alias("text")))


@query("""WITH RECURSIVE need AS (SELECT 1 AS k UNION SELECT u.k FROM need JOIN (SELECT n_nationkey AS k, n_nationkey // 2 AS of FROM nation) u ON u.of = need.k)
SELECT 'n' || n_nationkey || '/a.go' AS path FROM nation WHERE n_nationkey IN (SELECT k FROM need) UNION ALL SELECT 'n1/a_test.go'""")
def go_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports_ = F.expr("concat_ws('', transform(filter(array(2 * n_nationkey, 2 * n_nationkey + 1), k -> k < 25), k -> concat('  \"ex.com/m/n', k, '\"\n')))")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("f"), F.concat(F.lit('package x\nimport (\n  "fmt"\n'), imports_, F.lit(")\n")).alias("text"))
    files_ = n.select(F.concat("f", F.lit("/a.go")).alias("path"), "text").unionByName(n.select(F.concat("f", F.lit("/a_test.go")).alias("path"), F.lit("package x\n").alias("text")))
    return code.go_closure(files_, "ex.com/m", "./n1", tests=True)


@query("SELECT 'w/' || n_name || '/src/lib.rs' AS path, n_name AS name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'w/' || n_name || '/Cargo.toml', n_name FROM nation WHERE n_regionkey < 3")
def cargo_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    inner = F.explode(F.array(*(F.concat(F.lit("w/"), F.col("n_name"), F.lit(x)) for x in ("/src/lib.rs", "/Cargo.toml", "/README.md"))))
    return code.cargo_sources(n.select(inner.alias("path")), n.where("n_regionkey < 3").select(F.col("n_name").alias("name"), F.concat(F.lit("w/"), F.col("n_name")).alias("folder")))


@query("""SELECT n_name AS name, 'w/' || n_name AS folder, NULL AS target FROM nation UNION ALL SELECT n_name, 'w/' || n_name || '/src', 'w/' || n_name || '/src/lib.rs' FROM nation UNION ALL SELECT n_name, 'w/' || n_name || '/tests', 'w/' || n_name || '/tests/t' || n_regionkey || '.rs' FROM nation
UNION ALL SELECT n_name, 'x/e' || n_regionkey, 'x/e' || n_regionkey || '/main.rs' FROM nation WHERE n_nationkey % 2 = 0""")
def cargo_target_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat(F.lit("w/"), "n_name")
    target = lambda name, path: F.struct(F.lit(name).alias("name"), path.alias("src_path"))
    region = F.col("n_regionkey").cast("string")
    own = F.array(target("lib", F.concat(at, F.lit("/src/lib.rs"))), target("t", F.concat(at, F.lit("/tests/t"), region, F.lit(".rs"))))
    more = F.when(F.col("n_nationkey") % 2 == 0, F.array(target("e", F.concat(F.lit("x/e"), region, F.lit("/main.rs"))))).otherwise(F.array().cast("array<struct<name:string,src_path:string>>"))
    package = F.struct(F.col("n_name").alias("name"), F.concat(at, F.lit("/Cargo.toml")).alias("manifest_path"), F.concat(own, more).alias("targets"))
    return code.cargo_folders(table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.array(package).alias("packages"))).alias("metadata")))


@query(f"SELECT path FROM ({_TREE}) WHERE path LIKE 'm/a3/%' OR path = 'm/a/b7/f7.go' OR regexp_matches(path, '^m/[^/]*/f1[^/]*\\.txt$') GROUP BY path")
def run_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.run_sources(_tree(spark, sf_dir), "m/a3", ("m/*/f1*.txt",), ("m/a/b7/f7.go",))


@query("SELECT path FROM (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages) WHERE regexp_matches(path, '^(.*/)?en/[^/]*[^/]$')")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return paths.where(F.col("path").rlike(files.pattern_regex("**/en/*?")))


@query(f"SELECT path FROM ({_TREE}) WHERE path LIKE 'm/a/%' AND path NOT LIKE '%.txt'")
def expand_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(files.ignore_rules("*.txt\n"), "seq int, pattern string, negate boolean")
    return files.expanded(_tree(spark, sf_dir), "./m/a/", rules)


@query("SELECT n_nationkey, 'github.com' AS host, n_name AS owner, 'r' || n_regionkey AS repository, CASE WHEN n_nationkey % 2 = 0 THEN 'a/b' ELSE '' END AS folder, CASE WHEN n_nationkey % 3 = 0 THEN 'v1' ELSE '' END AS ref FROM nation")
def import_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("concat('github.com/', n_name, '/r', n_regionkey, if(n_nationkey % 2 = 0, '/a/b', ''), if(n_nationkey % 3 = 0, '#v1', ''))")
    return table(spark, sf_dir, "nation").select("n_nationkey", imports.url_columns(url).alias("u")).select("n_nationkey", "u.*")


@query("""SELECT c_custkey AS path, 'fmt' AS import FROM customer UNION ALL SELECT c_custkey, 'example.com/m/n' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'os' FROM customer WHERE c_custkey % 2 = 0""")
def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("""concat('package x\nimport (\n  "fmt"\n  alias "example.com/m/n', c_nationkey, '" // "no"\n)\n', if(c_custkey % 2 = 0, 'import "os"\n', '// import "none"\n'), 'var s = "http://x"\n')""")
    return code.go_imports(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), text.alias("text")))


@query("SELECT n_nationkey, 'v1/' || n_name || '/d' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'w' END AS source FROM nation")
def dockerfile_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('$V/', n_name, '/${D:-d}', if(n_nationkey % 2 = 0, '', '${V:+w}'))")
    return table(spark, sf_dir, "nation").select("n_nationkey", dockerfile.expand_column(text, {"V": "v1"}).alias("source"))


@query("SELECT n_nationkey, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS hash FROM nation WHERE n_regionkey IN (1, 3)")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, in folders of regions, digested where a pattern matches."""
    base = f"{graph_folder(spark)}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").write.partitionBy("n_regionkey", "n_nationkey").text(base)
    found = digests.file_digests(spark, base, "n_regionkey=[13]/**/*.txt")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "length", "hash")
