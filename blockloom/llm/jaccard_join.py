"""Similarity self-join on word n-grams by chosen paths.

Each text's set of n-grams is embedded as SKETCH minhashes. A run picks some positions at random, about one in
SKETCH * threshold; sets that agree in a chosen position share a node, where the same happens again with other
positions, BRANCH times as many, until a node is small; small nodes are compared by brute force. A pair survives a run's path with a
probability that grows with its similarity, and the number of runs follows from the recall wanted at the threshold in nodes of any depth.

The pairs so found only gather what must be compared: their components are then compared set by set, exactly,
and only pairs of at least the threshold are links. Large components are compared in tiles of bounded size.

Every row has a number of its own, its chunk and its place there; links are between these, and ids come in at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.chunks import NO_ID, PLACE_BITS, chunked, opened
from blockloom.llm.common import checkpointed, dropped, looked_up
from blockloom.llm.components import components
from blockloom.llm.exact_dedup import without
from blockloom.llm.hashing import Words, mixed, pack_sorted, unpack_sorted

SKETCH = 64
#: A node of so many sets or fewer is compared by brute force, and any node is after so many choices.
SMALL_NODE, MAX_DEPTH = 64, 5
#: Below the root, how many of the positions that it chooses a pair at the threshold agrees in, on average; at the root it is one.
BRANCH = 2
#: Sets of one component in a task; larger components are compared in tiles of two blocks.
BLOCK = 512
#: Sets of one node in a task; larger nodes are divided first, and their list is broadcast up to so many.
NODE_LIMIT, BROADCAST_NODES = 4096, 10_000
#: Standard deviations of a sketch's estimate below the threshold at which a pair is still compared exactly.
SLACK = 4
_RNG = np.random.Generator(np.random.PCG64(5))
_MULTIPLIERS = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def chosen(seed: int, threshold: float, branch: float = 1) -> np.ndarray:
    """The positions that a node chooses: each with probability branch / (threshold * SKETCH), and one at least."""
    h = mixed(np.arange(SKETCH, dtype=np.uint64) + np.uint64(seed * SKETCH % 2**64))
    picked = np.flatnonzero(h < np.uint64(int(2**64 * min(0.999, branch / (threshold * SKETCH)))))
    return picked if len(picked) else np.array([int(np.argmin(h))])


def runs_for(recall: float, threshold: float, levels: int = MAX_DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a node `levels` choices deep with the wanted probability; nodes are no deeper."""
    survive = 1.0
    for level in range(levels, 0, -1):
        survive = 1 - math.exp(-survive * (BRANCH if level > 1 else 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survive)))


def _sketches(n: int) -> Callable:
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("sha", pa.binary()), ("whole", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, offsets = opened(row)
                words = Words(data, offsets)
                hashes, first = words.shingles(n)
                full = np.flatnonzero(np.diff(first) > 0)
                out = np.empty((len(full), SKETCH), np.uint32)
                for k in range(SKETCH if len(full) else 0):
                    out[:, k] = np.minimum.reduceat((hashes * _MULTIPLIERS[k]) >> np.uint64(32), first[full]).astype(np.uint32)
                sketch = dict(zip(full.tolist(), out, strict=True))
                raw, whole, base = data.tobytes(), words.whole(), row["chunk"] << PLACE_BITS
                at = offsets.tolist()
                rows = [(base + k, i, hashlib.sha256(raw[at[k] : at[k + 1]]).digest(), whole[k] if k in sketch else None, sketch[k].tobytes() if k in sketch else None) for k, i in enumerate(ids.tolist())]
                yield from _arrow(rows, schema).to_batches()

    return run


def _roots(runs: int, threshold: float) -> list[tuple[int, int]]:
    return [(r, int(i)) for r in range(runs) for i in chosen(r, threshold)]


def _root_nodes(sketch: np.ndarray, r: int, i: int) -> np.ndarray:
    return mixed(sketch[:, i].astype(np.uint64) + (np.uint64(r * SKETCH + i) << np.uint64(32))).view(np.int64)


def _child_seed(seed: int, i: int, value: int) -> int:
    return (seed * 1_000_003 + i * 257 + value + 1) % 2**62


def _nodes(roots: list[tuple[int, int]], listed: list[int], inside: bool) -> Callable:
    """Every set to the nodes that the runs choose at their roots, if they are (or are not) listed: node, id and a byte of each minhash."""
    marked = np.array(sorted(listed), np.int64)
    schema = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
            low = pa.array([x.tobytes() for x in (sketch & np.uint32(255)).astype(np.uint8)], pa.binary())
            for r, i in roots:
                node = _root_nodes(sketch, r, i)
                out = pa.record_batch([pa.array(node), ids, low], schema=schema)
                yield out.filter(pa.array(np.isin(node, marked) == inside)) if len(marked) else out

    return run


def _node_sizes(roots: list[tuple[int, int]]) -> Callable:
    """node, n: how many sets of each batch go to each node, where they are two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(-1, SKETCH)
            for r, i in roots:
                node, n = np.unique(_root_nodes(sketch, r, i), return_counts=True)
                yield pa.record_batch([pa.array(node), pa.array(n)], names=["node", "n"])

    return run


def _least_agreement(threshold: float) -> int:
    """Bytes of two sketches that must agree for a pair to be near."""
    mean = threshold + (1 - threshold) / 256
    return math.floor(SKETCH * mean - SLACK * math.sqrt(SKETCH * mean * (1 - mean)))


def _split(threshold: float) -> Callable:
    """Sets of large nodes: a link to the node's leader for those that are near it, and all to the nodes that the node chooses."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64()), ("bytes", pa.binary()), ("far", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _least_agreement(threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
            leader = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH)
            far = (own == leader).sum(axis=1) < least
            to = batch.column(3).to_numpy()
            for n in np.unique(node).tolist():
                seed = n & (2**62 - 1)
                at = np.flatnonzero(node == n)
                for k, i in enumerate(chosen(seed, threshold, BRANCH).tolist()):
                    child = mixed((own[at, i].astype(np.uint64) << np.uint64(8)) + np.uint64(_child_seed(seed, i, 0))).view(np.int64)
                    linked = to[at] if k == 0 else ids[at]
                    yield pa.record_batch([pa.array(np.where(far[at], ids[at], linked)), pa.array(ids[at]), pa.array(child), batch.column(2).take(pa.array(at)), pa.array(far[at])], schema=schema)

    return run


def _far_against_all(threshold: float) -> Callable:
    """A tile of a node that no more choices divide: one block of the sets that are far from its leader against one block of all.

    Of the pairs found near, those go out that join what was not yet joined in the tile, so links are no more than sets.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        least, out = _least_agreement(threshold), []
        ids, far = table["id"].to_numpy(), np.array(table["side"].to_pylist(), bool)
        sketch = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        others, theirs = ids[~far], sketch[~far]
        joined = np.arange(len(others))  # of each of the others, the number of those that it is joined with
        for i in np.flatnonzero(far).tolist():
            near = np.flatnonzero(((theirs == sketch[i]).sum(axis=1) >= least) & (others != ids[i]))
            groups, first = np.unique(joined[near], return_index=True)
            out += [(int(ids[i]), int(others[j])) for j in near[first].tolist()]
            if len(groups) > 1:
                joined[np.isin(joined, groups)] = groups[0]
        return _arrow(out, schema)

    return run


def _near_links(texts: DataFrame, threshold: float, runs: int, parts: int, node_limit: int) -> DataFrame:
    """a, b: links that join what the runs find near. Nodes of over node_limit sets are divided before any task gets one whole.

    A large node's sets are first held against its leader, the one with the least id. Those near it are connected
    by that, so of the nodes it is divided into only those with a set far from it go on; after MAX_DEPTH
    choices the far sets of a node are compared with all, in blocks.
    """
    roots, kinds = _roots(runs, threshold), "node long, id long, bytes binary"
    sizes = texts.select("sketch").mapInArrow(_node_sizes(roots), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    hot = checkpointed(sizes.where(F.col("n") > node_limit).select("node"))
    rows = texts.select("id", "sketch")
    listed = [r[0] for r in hot.limit(BROADCAST_NODES + 1).collect()]
    if len(listed) <= BROADCAST_NODES:  # sent with the tasks, 8 bytes each
        large, rows = rows.mapInArrow(_nodes(roots, listed, True), kinds), rows.mapInArrow(_nodes(roots, listed, False), kinds)
    else:
        whole = rows.mapInArrow(_nodes(roots, [], False), kinds)
        large, rows = whole.join(hot, "node", "left_semi"), whole.join(hot, "node", "left_anti")
    ready, links, depth = [], [], 1
    while listed:
        large = checkpointed(large)
        leaders = checkpointed(large.groupBy("node").agg(F.min(F.struct("id", "bytes")).alias("l")).select("node", F.col("l.id").alias("leader"), F.col("l.bytes").alias("of")))
        led = looked_up(large, "node", leaders).select("node", "id", "bytes", "leader", "of")
        split = checkpointed(led.mapInArrow(_split(threshold), "a long, b long, node long, bytes binary, far boolean"))
        links.append(split.where("a <> b").select("a", "b"))
        depth += 1
        children = split.select("node", F.col("b").alias("id"), "bytes", "far")
        alive = children.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if("far").alias("n_far")).where("n_far > 0 AND n > 1")
        going = checkpointed(looked_up(children, "node", alive).where("n IS NOT NULL"))
        ready.append(going.where(F.col("n") <= node_limit).select("node", "id", "bytes", F.lit(depth).alias("depth")))
        over = going.where(F.col("n") > node_limit)
        if over.isEmpty():
            break
        if depth >= MAX_DEPTH:
            count = lambda c: F.ceil(F.col(c) / node_limit).cast("int")
            block = lambda c: F.pmod(F.xxhash64("id"), count(c)).cast("int")
            each = lambda c: F.sequence(F.lit(0), count(c) - 1)
            whole = over.select("node", "id", "bytes", F.lit(False).alias("side"), block("n").alias("all_block"), F.explode(each("n_far")).alias("far_block"))
            apart = over.where("far").select("node", "id", "bytes", F.lit(True).alias("side"), F.explode(each("n")).alias("all_block"), block("n_far").alias("far_block"))
            links.append(whole.unionByName(apart).groupBy("node", "far_block", "all_block").applyInArrow(_far_against_all(threshold), "a long, b long"))
            break
        large = over.select("node", "id", "bytes")
    rows = rows.withColumn("depth", F.lit(1))
    for df in ready:
        rows = rows.unionByName(df)
    # A task's entries are a few megabytes.
    tasks = max(256, parts, math.ceil(texts.count() * len(roots) / 20_000))
    out = rows.withColumn("task", F.pmod(F.xxhash64("node"), F.lit(tasks))).groupBy("task").applyInArrow(_solve(threshold), "a long, b long")
    for df in links:
        out = out.unionByName(df)
    return out


class _Join:
    """The recursion below the roots, in one task; links holds a forest of the pairs that are near by their sketches."""

    def __init__(self, ids: np.ndarray, sketch: np.ndarray, threshold: float) -> None:
        self.ids, self.sketch, self.threshold = ids, sketch, threshold
        self.least = _least_agreement(threshold)
        self.parent = np.arange(len(ids))
        self.links: set[tuple[int, int]] = set()

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            self.links.add((int(self.ids[i]), int(self.ids[j])))

    def against(self, i: int, others: np.ndarray) -> None:
        for j in others[(self.sketch[others] == self.sketch[i]).sum(axis=1) >= self.least].tolist():
            self.link(i, j)

    def solve(self, node: np.ndarray, seed: int, depth: int) -> None:
        """Link what is near among the given sets, which agree in the positions of a path."""
        if len(node) < 2:
            return
        if len(node) > 2:
            self.against(int(node[0]), node[1:])
            roots = np.array([self.root(i) for i in node.tolist()])
            if (roots == roots[0]).all():
                return
        if len(node) <= SMALL_NODE or depth >= MAX_DEPTH:
            # What is already connected need not be compared among itself: the largest part only with the others.
            roots = np.array([self.root(i) for i in node.tolist()])
            parts, n = np.unique(roots, return_counts=True)
            for i in node[roots != parts[np.argmax(n)]].tolist():
                self.against(i, node[node != i])
            return
        for i in chosen(seed, self.threshold, BRANCH).tolist():
            values = self.sketch[node, i]
            order = np.argsort(values, kind="stable")
            cuts = np.flatnonzero(np.diff(values[order])) + 1
            for child in np.split(node[order], cuts):
                self.solve(child, _child_seed(seed, i, int(self.sketch[child[0], i])), depth + 1)


def _solve(threshold: float) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["id"].to_numpy(), table["node"].to_numpy()))
        node, ids, depth = (table[c].to_numpy()[order] for c in ("node", "id", "depth"))
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(node)]]))
        if not (sizes > 1).any():
            return _arrow([], schema)
        sketch = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
        own, of = np.unique(ids, return_inverse=True)  # a set may be in many nodes
        place = np.zeros(len(own), np.int64)
        place[of] = np.arange(len(ids))
        join = _Join(own, sketch[place], threshold)
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            join.solve(of[s : s + n], int(node[s]) & (2**62 - 1), int(depth[s]))
        return _arrow(list(join.links), schema)

    return run


def _gathered(n: int) -> Callable:
    """The sets of the texts that a chunk is asked for."""
    schema = pa.schema([("row", pa.int64()), ("component", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int64()), ("grams", pa.binary())])

    def run(chunk: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        asked = asked.to_pylist()
        for row in chunk.to_pylist() if asked else []:
            _, data, offsets = opened(row)
            hashes, first = Words(data, offsets).shingles(n)
            for r in asked:
                k = r["row"] & (1 << PLACE_BITS) - 1
                out.append((r["row"], r["component"], r["copies"], r["blocks"], pack_sorted(np.unique(hashes[first[k] : first[k + 1]]))))
        return _arrow(out, schema)

    return run


def _exact(threshold: float) -> Callable:
    """Links within a task's components; each set's number of linked rows, and the sets joined with their least."""
    schema = pa.schema([("row", pa.int64()), ("least", pa.int64()), ("linked", pa.int64())])
    up = round(threshold * 10_000)

    def of(ids: np.ndarray, block: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], cross: bool) -> list[tuple]:
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark, linked, least = np.zeros(flat.max() + 1, bool), np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(i: int) -> int:
            while least[i] != i:
                least[i] = least[least[i]]
                i = least[i]
            return i

        for i in np.flatnonzero(block == block.min()).tolist() if cross else range(len(ids) - 1):
            own = flat[begin[i] : begin[i] + sizes[i]]
            mark[own] = True
            j0 = 0 if cross else i + 1
            common = np.add.reduceat(mark[flat[begin[j0] :]], begin[j0:] - begin[j0], dtype=np.int64)
            mark[own] = False
            near = common * 10_000 >= up * (sizes[i] + sizes[j0:] - common)
            if cross:
                near &= block != block[i]
            js = np.flatnonzero(near) + j0
            linked[i] += copies[js].sum()
            linked[js] += copies[i]
            for j in js.tolist():
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
        return [(i, int(ids[root(k)]), n) for k, (i, n) in enumerate(zip(ids.tolist(), linked.tolist(), strict=True))]

    def run(table: pa.Table) -> pa.Table:
        out = []
        order = np.lexsort((table["row"].to_numpy(), table["component"].to_numpy()))
        table = table.take(pa.array(order))
        component = table["component"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(component)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(a, z - a)
            sets = [unpack_sorted(x, np.uint64) for x in part["grams"].to_pylist()]
            block = part["block"].to_numpy()
            cross = bool(part["tile"][0].as_py())
            if len(sets) > 1 and not (cross and block.min() == block.max()):
                out += of(part["row"].to_numpy(), block, part["copies"].to_numpy(), sets, cross)
        return _arrow(out, schema)

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, node_limit: int) -> DataFrame:
    """id, sha, row, class_id, class_row, n_links of every row: what jaccard_classes says, and which row has the class's id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunked(docs, id_col, text_col)
    sketches = checkpointed(chunks.mapInArrow(_sketches(n), "row long, id long, sha binary, whole binary, sketch binary"))
    texts = checkpointed(sketches.where("whole IS NOT NULL").groupBy("whole").agg(F.min(F.struct("id", "row", "sketch")).alias("first"), F.count(F.lit(1)).alias("copies")).select("whole", "first.*", "copies"))
    n_texts = texts.count()
    found = components(_near_links(texts.select(F.col("row").alias("id"), "sketch"), threshold, runs_for(recall, threshold), parts, node_limit))
    tasks = max(256, parts, math.ceil(n_texts / 20_000))

    sized = looked_up(found, "component", found.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    asked = sized.withColumnRenamed("id", "row").join(texts.select("row", "copies"), "row").select(F.shiftright("row", PLACE_BITS).alias("chunk"), "row", "component", "copies", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    sets = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_gathered(n), "row long, component long, copies long, blocks long, grams binary")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    whole = F.col("blocks") == 1
    dealt = sets.withColumn("block", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    key = F.when(whole, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    cross = F.when(whole | (F.col("block") == F.col("other")), 0).otherwise(1)
    tiles = dealt.select(key.alias("key"), cross.alias("tile"), "block", "component", "row", "copies", "grams")
    exact = checkpointed(tiles.groupBy("key").applyInArrow(_exact(threshold), "row long, least long, linked long"))
    dropped(chunks, found)

    linked = exact.groupBy("row").agg(F.sum("linked").alias("linked"))
    classes = components(exact.where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))).withColumnRenamed("id", "row")
    by_text = checkpointed(texts.select("whole", "row", "id", "copies").join(linked, "row", "left").join(classes, "row", "left").withColumn("component", F.coalesce("component", "row")))
    firsts = by_text.groupBy("component").agg(F.min(F.struct("id", "row")).alias("least"))
    known = looked_up(by_text, "component", firsts, n_texts).select("whole", "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = looked_up(sketches.select("row", "id", "sha", "whole"), "whole", checkpointed(known))
    return rows.select("id", "sha", "row", F.coalesce("least.id", "id").alias("class_id"), F.coalesce("least.row", "row").alias("class_row"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99, node_limit: int = NODE_LIMIT) -> DataFrame:
    """id_col, class_id, n_links: a row for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is at least the threshold; n_links
    counts the other rows that a row is linked to, copies included; class_id is the least id that links lead to.
    Texts of fewer than n words have one gram, all their words; texts without words (null too) are linked to none and are each their own class.
    Rows that repeat an id, with the same text or another, are rows of their own. Ids are whole numbers; null sorts
    before all others. Other columns are ignored; an empty table gives an empty result.

    recall is the probability, at the threshold, that a pair is compared; nearer pairs and pairs that have
    common neighbours have more. Every link returned is exact, but for collisions of 64-bit hashes of n-grams.
    """
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return _classes(docs, id_col, text_col, n, threshold, recall, node_limit).select(back("id").alias(id_col), back("class_id").alias("class_id"), "n_links")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Of each class of docs one row with its least id, and all rows without words."""
    rows = _classes(docs, id_col, text_col, n, threshold, recall, node_limit)
    stays = F.max(F.col("row") == F.col("class_row"))
    decided = rows.groupBy(F.nullif("id", F.lit(NO_ID)).alias("id"), "sha").agg(stays.alias("one"), F.min("class_row").alias("first"), F.max("class_row").alias("last"), F.count(F.lit(1)).alias("c"))
    # Rows alike in id and text are of one class, or without words and each of its own.
    return without(docs, decided.where("NOT one OR c > 1 AND first = last").select("id", "sha", "one"), id_col, text_col)
