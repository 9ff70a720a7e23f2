"""Approximate nearest neighbours by collision-counting hashing.

Each vector, at unit length, has its place on a number of random directions. A block of vectors keeps one sorted array for each
direction. Around a query's own place windows open in all of them, and widen step by step (a step's
windows hold those of the step before, so only what is new is read). A vector in the windows of at least THRESHOLD directions is
verified by its true cosine. The windows are wide enough when they reach the distance of the k-th best so far: by then each
nearer vector has had its chance, 1 - MISS, of that many collisions, whatever the data.

Vectors are dealt in ranges of the first direction, so that a query goes to its own range first, and then to those that a window of REACH times
its k-th distance meets there. Tasks hold one block and a bounded group of queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import dropped, written

DIRECTIONS, SEED = 64, 7
#: The probability that a vector as near as the k-th best is overlooked in windows of its distance.
MISS = 0.01
#: The standard deviations of a projected distance that a window over ranges covers: all but 0.3 %.
REACH = 3.0
#: Vectors of a block and queries of a group: what a task holds, whatever the input's size.
BLOCK, GROUP = 8_192, 16_384
#: Half-widths of windows. Unit vectors are 2 apart at most.
WIDTHS = 2.0 * 1.2 ** np.arange(-24, 1)
#: Queries whose windows are looked up at once, and what rounding may move a place by.
_AT_ONCE, _SLACK = 128, 1e-6


def threshold(directions: int = DIRECTIONS, miss: float = MISS) -> int:
    """The collisions that a vector has at least, but for the probability miss, in windows of its own distance to the query.

    A projected distance is normal with the distance as deviation, so each direction collides with probability erf(1 / sqrt(2)).
    """
    p, below = math.erf(1 / math.sqrt(2)), 0.0
    for n in range(directions + 1):
        below += math.comb(directions, n) * p**n * (1 - p) ** (directions - n)
        if below > miss:
            return n
    return directions


def random_directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, DIRECTIONS))


def sane(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares would leave double precision are scaled, which changes no angle; all others stay as they are."""
    with np.errstate(over="ignore"):
        squares = (vectors * vectors).sum(axis=1)
    odd = ~np.isfinite(squares) | (squares < 1e-290)
    if odd.any():
        vectors = vectors.copy()
        vectors[odd] /= np.abs(vectors[odd]).max(axis=1, keepdims=True)
    return vectors


class Block:
    """Vectors with a sorted array of places for each direction."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows, self.vectors = ids, rows, sane(vectors)
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.directions = random_directions(vectors.shape[1])
        places = np.ascontiguousarray((self.vectors / self.length[:, None] @ self.directions).T)
        self.order = np.argsort(places, axis=1).astype(np.int32)
        self.places = np.take_along_axis(places, self.order, axis=1)
        self.least = threshold()

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (at length one), width and direction: where the window begins and ends in the sorted array."""
        at = queries @ self.directions
        low, high = (np.empty((len(queries), len(WIDTHS), DIRECTIONS), np.int32) for _ in range(2))
        for j in range(DIRECTIONS):
            low[:, :, j] = np.searchsorted(self.places[j], at[:, j, None] - WIDTHS - _SLACK, "left")
            high[:, :, j] = np.searchsorted(self.places[j], at[:, j, None] + WIDTHS + _SLACK, "right")
        return low, high

    def scores(self, some: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        """The cosines of some vectors with a query, summed in one order for all, so that equal vectors score alike."""
        return (self.vectors[some] * query).sum(axis=1) / (self.length[some] * length)

    def search(self, best: Best, low: np.ndarray, high: np.ndarray) -> None:
        """Add to best what collides often enough in windows that reach its k-th distance."""
        counts, left = np.zeros(len(self.ids), np.int32), np.ones(len(self.ids), bool)
        left[self.rows == best.row] = False
        held = (high - low).sum(axis=1)
        # no window is read before k vectors can have collided, or, where a distance is known, before the last that is too narrow for it
        first = max(int(np.searchsorted(held, self.least * best.k)), int(np.searchsorted(WIDTHS, best.reach()) - 1) if best.full() else 0)
        was = None
        for i in range(min(first, len(WIDTHS) - 1), len(WIDTHS)):
            if was is None:
                read = [self.order[j, low[i, j] : high[i, j]] for j in range(DIRECTIONS)]
            else:
                read = [self.order[j, low[i, j] : low[was, j]] for j in range(DIRECTIONS)] + [self.order[j, high[was, j] : high[i, j]] for j in range(DIRECTIONS)]
            was = i
            counts += np.bincount(np.concatenate(read), minlength=len(counts)).astype(np.int32)
            some = np.flatnonzero((counts >= self.least) & left)
            left[some] = False
            best.add(self, some)
            if WIDTHS[i] >= best.reach():
                return
        if not best.full():  # fewer than k so far: all that is left
            best.add(self, np.flatnonzero(left))


class Best:
    """A query's k best so far; bound is a distance within which k others are known to be, if any are."""

    def __init__(self, row: int, query: np.ndarray, k: int, bound: float) -> None:
        self.row, self.k, self.bound = row, k, bound
        self.query = sane(query[None, :])[0]
        self.length = math.sqrt((self.query * self.query).sum())
        self.ids, self.found = np.zeros(0, np.int64), np.zeros(0)

    def full(self) -> bool:
        return len(self.ids) == self.k or math.isfinite(self.bound)

    def reach(self) -> float:
        """The distance of the k-th."""
        own = math.sqrt(max(0.0, 2 - 2 * float(self.found[-1]))) if len(self.ids) == self.k else math.inf
        return min(own, self.bound)

    def add(self, block: Block, some: np.ndarray) -> None:
        if len(some):
            ids, found = np.concatenate([self.ids, block.ids[some]]), np.concatenate([self.found, block.scores(some, self.query, self.length)])
            keep = np.lexsort((ids, -found))[: self.k]
            self.ids, self.found = ids[keep], found[keep]


_ROWS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("query", pa.bool_()), ("dim", pa.int32()), ("at", pa.float64()), ("vector", pa.binary())])
_BLOCKS = pa.schema([("slab", pa.int32()), ("dim", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), ("n_queries", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("query", pa.binary()), ("at", pa.binary()), ("vectors", pa.binary())])
_ASKED = "row long, id long, dim int, at double, slab int, vector binary"
_FOUND = "row long, query_id long, vec_id long, score double"


def _placed(kind: str) -> Callable:
    """Rows of unpacked vectors with their place on the first direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), np.asarray(lists.values.to_numpy(zero_copy_only=False), kind)
            vectors = [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            at = []
            for v in vectors:
                own = sane(v.astype(np.float64)[None, :])[0]
                at.append(float(own @ _first(len(own))) / math.sqrt(float(own @ own)))
            yield pa.record_batch([*batch.columns[:3], pa.array([len(v) for v in vectors], pa.int32()), pa.array(at, pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary())], schema=_ROWS)

    return run


_FIRST: dict[int, np.ndarray] = {}


def _first(dim: int) -> np.ndarray:
    if dim not in _FIRST:
        _FIRST[dim] = np.ascontiguousarray(random_directions(dim)[:, 0])
    return _FIRST[dim]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, in order of dimension and place, in blocks of one dimension."""
    from pyspark import TaskContext

    slab, held = TaskContext.get().partitionId(), []

    def flush() -> pa.RecordBatch:
        rows, ids, query, dims, at, vectors = zip(*held, strict=True)
        packed = [np.array(x, t).tobytes() for x, t in ((ids, np.int64), (rows, np.int64), (query, np.bool_), (at, np.float64))]
        held.clear()
        return pa.record_batch([[x] for x in (slab, dims[0], min(at), max(at), len(ids), sum(query), *packed, b"".join(vectors))], schema=_BLOCKS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= BLOCK or held[0][3] != row[3]):
                yield flush()
            held.append(row)
    if held:
        yield flush()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of blocks: row, id, dim, at, slab, vector."""
    for batch in batches:
        for b in batch.to_pylist():
            ids, rows, query, at = (np.frombuffer(b[c], t) for c, t in (("ids", np.int64), ("rows", np.int64), ("query", np.bool_), ("at", np.float64)))
            size, some = len(b["vectors"]) // len(ids), np.flatnonzero(query)
            if len(some):
                columns = [pa.array(rows[some]), pa.array(ids[some]), pa.array([b["dim"]] * len(some), pa.int32()), pa.array(at[some]), pa.array([b["slab"]] * len(some), pa.int32()), pa.array([b["vectors"][k * size : (k + 1) * size] for k in some], pa.binary())]
                yield pa.record_batch(columns, names=["row", "id", "dim", "at", "slab", "vector"])


def _met(slabs: dict[int, np.ndarray]) -> Callable:
    """The ranges other than its own that a query's window on the first direction meets; slabs has (slab, low, high) by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            to, of = [], []
            for k, (dim, at, own, bound) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "at", "slab", "bound")), strict=True)):
                slab, low, high = slabs[dim]
                reach = math.inf if bound is None else REACH * bound + _SLACK
                for x in slab[(low <= at + reach) & (high >= at - reach)].tolist():
                    if int(x) != own:
                        to.append(int(x))
                        of.append(k)
            rest = batch.take(pa.array(of, pa.int64()))
            yield pa.record_batch([pa.array(to, pa.int32()) if c == "slab" else rest.column(c) for c in names], names=names)

    return run


def _search(kind: str, k: int) -> Callable:
    """Rows sorted by range and group, a group's queries before the range's blocks, to the queries' k best of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, []

        def found() -> pa.RecordBatch:
            best = [(b.row, q, int(i), float(s)) for q, b in asked for i, s in zip(b.ids, b.found, strict=True)]
            asked.clear()
            return pa.record_batch([pa.array([x[c] for x in best], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["row", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["slab"], r["of"]):
                    if asked:
                        yield found()
                    at = (r["slab"], r["of"])
                if not r["block"]:
                    asked.append((r["id"], Best(r["row"], np.frombuffer(r["vector"], kind).astype(np.float64), k, math.inf if r["bound"] is None else r["bound"])))
                    continue
                block = Block(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64), np.frombuffer(r["vector"], kind).reshape(-1, r["dim"]).astype(np.float64))
                here = [b for _, b in asked if len(b.query) == r["dim"]]
                for first in range(0, len(here), _AT_ONCE):
                    some = here[first : first + _AT_ONCE]
                    low, high = block.windows(np.array([b.query / b.length for b in some]))
                    for n, b in enumerate(some):
                        block.search(b, low[n], high[n])
        if asked:
            yield found()

    return run


def _tiles(visits: DataFrame, blocks: DataFrame, n: int, kind: str, k: int) -> DataFrame:
    """What visits(slab, of, row, id, dim, bound, vector) find: each range with each group of its queries is one stretch of a task's rows."""
    none = F.lit(None).cast("binary")
    queries = visits.select("slab", "of", F.lit(False).alias("block"), "row", "id", "dim", "bound", none.alias("ids"), none.alias("rows"), "vector")
    wanted = visits.select("slab", "of").distinct()
    held = blocks.join(wanted, "slab").select("slab", "of", F.lit(True).alias("block"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("id"), "dim", F.lit(None).cast("double").alias("bound"), "ids", "rows", F.col("vectors").alias("vector"))
    return queries.unionByName(held).repartition(n, "slab", "of").sortWithinPartitions("slab", "of", "block").mapInArrow(_search(kind, k), _FOUND)


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which queries holds, by cosine, ties to the smaller id.

    Every other row is a candidate, one with equal id or vector too; ids are whole numbers. A query with fewer than k candidates
    gets all; each of the k nearest is found with probability 0.99 in its range and 0.987 beyond, whatever the data. Scores are
    cosines of the original vectors in double precision. Rows with a null id, and vectors that are null, empty, zero or hold nulls or
    non-finite components take no part; vectors of different lengths are never compared. An empty table
    gives an empty result; other columns are ignored.
    """
    element = vectors.select(vector_col).schema[0].dataType.elementType.simpleString()
    kind, plain = ("<f4", "float") if element == "float" else ("<f8", "double")
    vector = F.col(vector_col).cast(f"array<{plain}>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), vector.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    ranges = max(1, math.ceil(vectors.count() / BLOCK))
    placed = rows.mapInArrow(_placed(kind), "row long, id long, query boolean, dim int, at double, vector binary")
    blocks = written(placed.repartitionByRange(ranges, "dim", "at", "row").sortWithinPartitions("dim", "at", "row").mapInArrow(_blocks, "slab int, dim int, low double, high double, n long, n_queries long, ids binary, rows binary, query binary, at binary, vectors binary"), "none")
    # a row for each range of BLOCK vectors: 24 bytes for each so many that a task holds, on the driver and in its closures
    bounds = blocks.groupBy("dim", "slab").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_queries").alias("n")).collect()
    slabs = {d: tuple(np.array([r[c] for r in bounds if r["dim"] == d]) for c in ("slab", "low", "high")) for d in {r["dim"] for r in bounds}}
    groups = max(1, math.ceil(sum(r["n"] for r in bounds) / GROUP))
    asked = blocks.where("n_queries > 0").mapInArrow(_asked, _ASKED).withColumn("of", F.pmod(F.xxhash64("row"), F.lit(groups)))
    n = max(1, len(bounds) * groups)
    home = written(_tiles(asked.withColumn("bound", F.lit(None).cast("double")), blocks, n, kind, k))
    known = home.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("row", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).alias("bound"))
    visits = asked.join(known, "row", "left")
    visits = written(visits.mapInArrow(_met(slabs), visits.schema))
    found = home.unionByName(_tiles(visits, blocks, n, kind, k))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    dropped(blocks, home, visits)
    return out
