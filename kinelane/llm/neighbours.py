"""Approximate nearest neighbours: a graph by NN-descent, searched greedily from a query's own neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelane.llm.common import lanes_for, stored

#: Neighbours kept per node, rounds of descent at most, and the share of edges that a round must change to go on.
DEGREE, ROUNDS, SETTLED = 24, 20, 0.02
#: Nodes compared with one another at the start, and members of a node compared at a time.
BLOCK, CHUNK = 1024, 96
#: Nodes a search keeps open per query, and numbers that are subtracted at a time.
BEAM, NUMBERS = 320, 1 << 18
EDGE = "u long, v long, d double"


def valid_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the vectors that take part: not null or zero, all components finite, the usual length."""
    own = df.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector")).filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.filter(F.coalesce(finite, F.lit(False))).filter(F.exists("vector", lambda x: x != 0))
    usual = own.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1)
    return own.join(F.broadcast(usual.select("n")), F.size("vector") == F.col("n"), "left_semi")


def distinct_vectors(vectors: DataFrame, members: int) -> DataFrame:
    """``node, vector, rank, vec_id``: the ``members`` least ids of every different vector; ``node`` is the least.

    A result of ``members - 1`` rows beside the query never needs more of equal vectors, and the limit is applied before
    rows are dealt, so that one very common vector is no large group.
    """
    own = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.dropDuplicates(["vec_id", "vector"]).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= members)
    return few.withColumn("node", F.min("vec_id").over(Window.partitionBy("vector")))


def _grouped(batches: Iterator[pa.RecordBatch], work: Callable[[int, list[pa.RecordBatch]], None], most: int = 1 << 60) -> None:
    """Calls ``work`` for the rows of each value of the first column, ``most`` at a time; rows come sorted by it."""
    held, at, n = [], None, 0
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else []
        for a, b in zip(cuts, [*cuts, len(keys)][1:], strict=True) if cuts else ():
            if keys[a] != at and held:
                work(at, held)
                held, n = [], 0
            at = keys[a]
            while a < b:
                size = min(b - a, most - n)
                held.append(batch.slice(a, size))
                a, n = a + size, n + size
                if n == most:
                    work(at, held)
                    held, n = [], 0
    if held:
        work(at, held)


def _vectors(batches: list[pa.RecordBatch], column: int, kind: type) -> np.ndarray:
    raw = b"".join(v.as_buffer().to_pybytes() for b in batches for v in b.column(column))
    return np.frombuffer(raw, kind).reshape(sum(b.num_rows for b in batches), -1).astype(np.float64)


def _column(batches: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([b.column(column).to_numpy() for b in batches])


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` and ``y`` (or of one row and many), by their differences."""
    return ((x - y) ** 2).sum(1)


def _least_squares(x: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of all rows by the product form: it less what its rounding can add.

    The products lose what near copies differ in, so they only rule pairs out; NaN (products overflow) rules out none.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        own = (x * x).sum(1)
        both = own[:, None] + own[None]
        return both - 2 * x @ x.T - (2 * x.shape[1] + 8) * np.finfo(np.float64).eps * both


class _Best:
    """Candidate edges of a task: at most ``keep`` per node are passed on, the nearest."""

    def __init__(self, keep: int, flush: int = 1_500_000):
        self.keep, self.flush, self.held, self.n = keep, flush, [], 0

    def add(self, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        self.held.append((u, v, d))
        self.n += len(u)
        if self.n > self.flush:
            self.held = [self.reduced()]
            self.n = len(self.held[0][0])

    def reduced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, d = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        order = np.lexsort((v, d, u))
        u, v, d = u[order], v[order], d[order]
        fresh = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.empty(0, bool)
        u, v, d = u[fresh], v[fresh], d[fresh]
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, np.int64)
        rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
        few = rank < self.keep
        return u[few], v[few], d[few]

    def batch(self) -> pa.RecordBatch:
        u, v, d = self.reduced()
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(d.astype(np.float64))], names=["u", "v", "d"])


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest of every node's edges, each edge once."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).filter(F.col("rank") <= degree).drop("rank")


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, kind: type = np.float16, chunk: int = CHUNK) -> DataFrame:
    """``u, v, d``: near neighbours of every node (``nodes``: node, packed; packed is the vector as floats of ``kind``).

    Start: nodes are compared within two sets of blocks drawn by hash. Each round joins the neighbours of a node, in both directions,
    with their vectors, and compares them with one another (neighbours of neighbours); a pair counts if it is nearer
    than the worst neighbour that one of them has so far, and was not compared before in that role. Nodes with over ``chunk``
    neighbours are cut into parts of about that size, dealt anew by hash each round, which are tasks' work of their own.
    Two members that never met in a part may both be old by then, so parts compare old members as well. Distances are
    squared, in double precision.
    """
    count = nodes.count()
    blocks = lanes_for(count, BLOCK)

    def within_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(degree)

        def compare(_: int, rows: list[pa.RecordBatch]) -> None:
            ids, x = _column(rows, 1), _vectors(rows, 2, kind)
            for a in range(0, len(ids), CHUNK * 8):
                d = np.stack([_squares(one, x) for one in x[a : a + CHUNK * 8]])
                few = min(degree // 2 + 1, len(ids)) if blocks > 1 else min(degree + 1, len(ids))
                near = np.argpartition(d, few - 1, axis=1)[:, :few]
                u, v = np.repeat(ids[a : a + len(d)], few), ids[near].ravel()
                kept = u != v
                best.add(u[kept], v[kept], np.take_along_axis(d, near, 1).ravel()[kept])

        _grouped(batches, compare)
        yield best.batch()

    # Two drawings, since neighbours of neighbours never leave the blocks of one.
    block = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(blocks)) + turn * blocks for turn in (0, 1)]))
    start = nodes.select(block.alias("block"), "node", "packed").repartition(F.col("block")).sortWithinPartitions("block")
    edges = stored(_nearest(start.mapInArrow(within_block, EDGE), degree).withColumn("new", F.lit(True)), "graph")

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(degree)

        def compare(_, rows: list[pa.RecordBatch]) -> None:
            ids, new, worst = _column(rows, 1), _column(rows, 2).astype(bool), _column(rows, 3)
            if not new.any():
                return
            x = _vectors(rows, 4, kind)
            useful = ~(_least_squares(x) >= worst[:, None]) & (new[:, None] | new[None]) & (ids[:, None] != ids[None])
            pairs, step = np.argwhere(useful), max(1, NUMBERS // x.shape[1])
            for a in range(0, len(pairs), step):
                i, j = pairs[a : a + step].T
                d = _squares(x[i], x[j])
                nearer = d < worst[i]
                best.add(ids[i[nearer]], ids[j[nearer]], d[nearer])

        _grouped(batches, compare, chunk)
        yield best.batch()

    for turn in range(rounds if count > degree + 1 else 0):
        worst = edges.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
        worst = worst.select(F.col("u").alias("node"), F.when(F.col("n") < degree, F.lit(float("inf"))).otherwise(F.col("worst")).alias("worst"))
        known = nodes.join(worst, "node")
        both = edges.select("u", "v", "new").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "new"))
        both = both.groupBy("u", "v").agg(F.max("new").alias("new"))
        both = stored(both, "both")
        parts = both.groupBy("u").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts")).filter("parts > 1")
        both = both.join(parts, "u", "left")
        part = F.coalesce(F.pmod(F.xxhash64("v", F.lit(turn)), "parts"), F.lit(0)).alias("part")
        fresh = (F.col("new") | F.col("parts").isNotNull()).cast("int").alias("new")
        members = both.join(known, both["v"] == known["node"]).select("u", "v", fresh, "worst", "packed", part)
        dealt = members.repartition(F.col("u"), F.col("part")).sortWithinPartitions("u", "part", F.xxhash64("v", F.lit(turn)))
        found = dealt.mapInArrow(local_join, EDGE).select("u", "v", "d", F.lit(True).alias("new"))
        every = found.union(edges.select("u", "v", "d", F.lit(False).alias("new")))
        once = every.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v")))
        edges = stored(ranked.filter(F.col("rank") <= degree).drop("rank"), "graph")
        changed, total = edges.agg(F.sum(F.col("new").cast("long")), F.count("*")).first()
        if (changed or 0) <= SETTLED * total:
            break
    return edges.select("u", "v", "d")


def graph_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM, kind: type = np.float16) -> DataFrame:
    """``query_id, node, d``: the nearest ``beam`` nodes that a greedy search visits, from ``queries`` (query_id, packed, start).

    Each hop opens, for every query, those of its nearest ``beam`` nodes that are not open yet, joins their neighbours in
    both directions and measures them; it ends when the nearest ``beam`` are all open. What is farther than ``beam``
    nodes can never come back, so a query holds no more rows than that, however many nodes it visits. ``d`` is the
    squared distance in double precision; packed vectors are floats of ``kind``.
    """
    adjacent = stored(graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "adjacent")
    asked = queries.select("query_id", "packed")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []

        def one(query: int, rows: list[pa.RecordBatch]) -> None:
            x = _vectors(rows, 2, kind)
            ids = _column(rows, 1)
            asks = np.flatnonzero(ids < 0)  # the query itself comes first
            if len(asks) and len(ids) > 1:
                d = _squares(x[asks[0]], x[1:])
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(d), query, np.int64)), pa.array(ids[1:]), pa.array(d)], names=["query_id", "node", "d"]))

        _grouped(batches, one)
        yield from out

    def distances(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(nodes, "node").select("query_id", "node", "packed")
        marked = rows.union(asked.select("query_id", F.lit(-1).cast("long").alias("node"), "packed"))
        dealt = marked.repartition(F.col("query_id")).sortWithinPartitions("query_id", "node")
        return dealt.mapInArrow(measure, "query_id long, node long, d double")

    pool = stored(distances(queries.select("query_id", F.col("start").alias("node"))).withColumn("opened", F.lit(False)), "pool")
    while True:
        opening = pool.filter(~F.col("opened")).select("query_id", "node")
        if opening.isEmpty():
            return pool.select("query_id", "node", "d")
        reached = opening.join(adjacent, opening["node"] == adjacent["u"]).select("query_id", F.col("v").alias("node")).distinct()
        fresh = distances(reached.join(pool, ["query_id", "node"], "left_anti")).withColumn("opened", F.lit(False))
        every = pool.withColumn("opened", F.lit(True)).unionByName(fresh)
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node")))
        pool = stored(ranked.filter(F.col("rank") <= beam).drop("rank"), "pool")


def nearest(df: DataFrame, is_query: F.Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for the rows that ``is_query`` (of ``vec_id``) selects.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id; a query is
    no neighbour of itself, but of equal vectors. Vectors that are null, zero, not finite or not of the usual length take
    no part, nor do null ids; rows with equal id and vector are one; an empty table gives no rows. Fewer than ``k``
    candidates are all returned.
    """
    members = stored(distinct_vectors(valid_vectors(df, id_column, vector_column), k + 1), "members")
    kind = np.float32 if isinstance(df.schema[vector_column].dataType.elementType, T.FloatType) else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["node", "packed"])

    nodes = stored(members.filter("rank = 1").select(F.col("node").cast("long"), "vector").mapInArrow(pack, "node long, packed binary"), "nodes")
    graph = neighbour_graph(nodes, kind=kind)
    vectors = members.filter("rank = 1").select("node", "vector")
    asked = valid_vectors(df, id_column, vector_column).filter(is_query).dropDuplicates(["vec_id", "vector"])
    asked = stored(asked.join(vectors, "vector").select(F.col("vec_id").cast("long").alias("query_id"), "vector", F.col("node").cast("long").alias("start")), "asked")
    packed = asked.join(nodes, asked["start"] == nodes["node"]).select("query_id", "packed", "start")
    visited = graph_search(graph, nodes, packed, max(BEAM, 2 * k), kind).select("query_id", "node", F.sqrt("d").alias("score"))
    # Every node but the query's own gives a row at least; rank leaves nodes of equal score in.
    scored = visited.withColumn("at", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("at") <= k + 1).drop("at")
    rows = scored.join(members.select("node", F.col("vec_id").cast("long").alias("vec_id")), "node").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
