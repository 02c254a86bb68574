"""Learning and scoring as Spark ML jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import product
from math import gcd, prod
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinelane.operators.trees import candidate_cuts, ended, grow, in_tasks, node_rows, packed, reached
from kinelane.schema import SERIES
from kinelane.session import ensure_checkpoints, work_path

# Fixed values (but FIT_ROWS): the forest search space. Unlimited depth becomes Spark's documented maximum, and the
# split-size setting has no Spark counterpart, so 18 combinations remain.
FIT_ROWS = 100_000  # rows of a partition that forests are searched on
WHOLE_ROWS = 200_000  # rows times trees of a forest that is fitted at once
HELD_ROWS = 1_500_000  # rows times trees of the fits that run at a time: the driver holds their nodes, about one for two rows
FITS = 8  # fits that run at a time
SHARED_BYTES = 64_000_000  # of rows that every task may hold: a byte per feature
LOADED = 3  # parts of a grown forest that are loaded at a time, where a part has more than one tree
VOTED = 20  # trees that vote together at most, in a search
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2]}


def forest(
    columns: Sequence[str], label: str = "label", trees: int = 100, depth: int = 30, weight: str | None = None, seed: int = 42
) -> Pipeline:
    """Random forest on plain feature columns."""
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), model])


def forest_parts(
    train: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 100, depth: int = 30, weight: str | None = None, seed: int = 42
) -> list[Callable[[], PipelineModel]]:
    """A forest as functions that fit a part of its trees each, with seeds of their own.

    A deep tree has about a node for every second row, and a model holds the nodes of all its trees in the driver. So the more
    rows, the fewer trees a part has: what ``each_part`` holds at a time does not grow until one tree of all rows is over
    that. Up to ``WHOLE_ROWS`` the forest is one part. Beyond that trees are grown by tasks that hold all rows, as long as
    these take ``SHARED_BYTES``; then they are fitted by Spark again, level by level. ``train`` should be written down, since
    every part reads it.
    """
    rows = max(1, train.count())
    if rows * trees <= WHOLE_ROWS:
        return [lambda: forest(columns, label, trees, depth, weight, seed).fit(train)]
    if rows * len(columns) <= SHARED_BYTES:
        grown = Grown(train, columns, label, weight, depth, seed)
        own = min(-(-trees // FITS), max(1, HELD_ROWS // (LOADED * rows)))
        return [GrownPart(grown, first, min(own, trees - first)) for first in range(0, trees, own)]
    own = min(-(-trees // FITS), max(1, HELD_ROWS // (FITS * rows)))
    kept = train.select(*columns, label, *([weight] if weight else [])).coalesce(max(1, -(-rows // FIT_ROWS)))

    def part(first: int) -> PipelineModel:
        return forest(columns, label, min(own, trees - first), depth, weight, seed + first).fit(kept)

    return [partial(part, first) for first in range(0, trees, own)]


class Grown:
    """Binned training rows in every task, for trees grown there; a tree's draws depend on ``seed`` and its number."""

    def __init__(self, train: DataFrame, columns: Sequence[str], label: str, weight: str | None, depth: int, seed: int, least: int = 1):
        self.train, self.columns, self.label, self.weight, self.depth, self.seed, self.least = train, list(columns), label, weight, depth, seed, least
        self.spark = train.sparkSession
        self.cuts = candidate_cuts(train, columns)
        rows = packed(train, columns, [self.cuts], {c: "float64" for c in (label, weight) if c})
        truth, weights = _judged(rows.others, label, weight)
        self.classes = int(truth.max(initial=0)) + 1
        self.shared = self.spark.sparkContext.broadcast((rows.x[0], truth, weights))
        self._lock, self._form = Lock(), None

    def tree(self) -> Callable:
        """Grows the tree of a number, in a task."""
        shared, classes, depth, least, seed = self.shared, self.classes, self.depth, self.least, self.seed
        return lambda number: grow(*shared.value, classes, depth, least, [seed, number])

    def votes(self, rows: DataFrame, trees: int, path: str) -> int:
        """Writes the class shares of ``rows`` (by ``_row``), summed over some trees each, and says over how many such turns."""
        tested = packed(rows, self.columns, [self.cuts], {"_row": "int64"})
        shown = self.spark.sparkContext.broadcast((tested.x[0], tested.others["_row"]))
        tree, own, depth = self.tree(), max(1, trees // 50), self.depth

        def vote(turn: int) -> Iterator[pa.RecordBatch]:
            x, number = shown.value
            total = 0.0
            for grown in map(tree, range(turn * own, min((turn + 1) * own, trees))):
                total = total + grown.shares()[ended(grown, depth)[0][reached(grown, x)]]
            yield from _by_row({"turn": np.full(len(x), turn, np.int32), "_row": number}, "raw", total)

        turns = -(-trees // own)
        in_tasks(self.spark.range(0, turns, 1, turns), vote, "turn int, _row long, raw array<double>").write.parquet(path)
        shown.destroy()
        return turns

    def template(self) -> tuple[PipelineModel, T.StructType]:
        """A stump that Spark has fitted on the same rows, whose stored form the trees take over, and the schema of its nodes."""
        with self._lock:
            if self._form is None:
                model = forest(self.columns, self.label, 1, 0, self.weight, self.seed).fit(self.train)
                path = work_path(self.spark, "stump")
                model.stages[-1].write().save(path)
                self._form = model, self.spark.read.parquet(f"{path}/data").schema
            return self._form


class GrownPart:
    """Some trees of a grown forest. A call gives their model; stored as a model's writer does, they never pass the driver."""

    def __init__(self, grown: Grown, first: int, trees: int):
        self.grown, self.first, self.trees = grown, first, trees

    def __call__(self) -> PipelineModel:
        path = work_path(self.grown.spark, "part")
        self.save(path)
        return PipelineModel.load(path)

    def write(self) -> GrownPart:
        return self

    def overwrite(self) -> GrownPart:
        return self

    def save(self, path: str) -> None:
        grown, spark = self.grown, self.grown.spark
        model, schema = grown.template()
        model.write().overwrite().save(path)
        stage = f"{path}/stages/{len(model.stages) - 1}_{model.stages[-1].uid}"
        about = json.loads(spark.read.text(f"{stage}/metadata").first().value)
        about["paramMap"].update(numTrees=self.trees, maxDepth=grown.depth, minInstancesPerNode=grown.least)
        about["numTrees"] = self.trees
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{stage}/metadata")
        trees = spark.read.parquet(f"{stage}/treesMetadata")
        _, one, weight = trees.first()
        own = json.loads(one)
        own["paramMap"].update(maxDepth=grown.depth, minInstancesPerNode=grown.least)
        named = [(i, json.dumps(own), weight) for i in range(self.trees)]
        spark.createDataFrame(named, trees.schema).coalesce(1).write.mode("overwrite").parquet(f"{stage}/treesMetadata")
        tree, first, cuts, depth, form = grown.tree(), self.first, grown.cuts, grown.depth, to_arrow_schema(schema)
        nodes = in_tasks(spark.range(0, self.trees, 1, self.trees), lambda i: [node_rows(tree(first + i), i, cuts, depth, form)], schema)
        nodes.write.mode("overwrite").parquet(f"{stage}/data")


def _judged(others: dict[str, np.ndarray], label: str, weight: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Classes and weights of training rows, None as weights where all are 1."""
    truth, weights = others[label], others[weight] if weight else None
    if (truth < 0).any() or (truth != np.floor(truth)).any():
        raise ValueError("classes of a forest are whole numbers from 0")
    if weights is not None and not (weights >= 0).all():
        raise ValueError("weights of training rows are not negative")
    return truth.astype(np.uint8 if truth.max(initial=0) < 256 else np.int32), None if weights is None or (weights == 1).all() else weights


def _by_row(keys: dict[str, np.ndarray], name: str, values: np.ndarray, batch: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``keys`` and of the further dimensions of ``values`` as nested lists."""
    for at in range(0, len(values), batch):
        part = values[at : at + batch]
        made = pa.array(part.ravel())
        for d in range(part.ndim - 1, 0, -1):
            made = pa.ListArray.from_arrays(np.arange(prod(part.shape[:d]) + 1, dtype=np.int32) * part.shape[d], made)
        yield pa.RecordBatch.from_pydict({**{k: v[at : at + batch] for k, v in keys.items()}, name: made})


def each_part(spark: SparkSession, rows: int, parts: Sequence[Callable[[], PipelineModel]], action: Callable[[int, PipelineModel], None], trees: int = 100) -> None:
    """``action`` on every part of a forest over ``rows`` rows; no more parts at a time than ``HELD_ROWS`` allows."""
    own = -(-trees // len(parts))
    with ThreadPool(max(1, min(FITS, HELD_ROWS // max(1, own * rows)))) as pool:
        pool.map(inheritable_thread_target(spark)(lambda turn: action(turn, parts[turn]())), range(len(parts)), chunksize=1)


def store_parts(spark: SparkSession, rows: int, parts: Sequence[Callable[[], PipelineModel]], save: Callable[[int, PipelineModel | GrownPart], None], trees: int = 100) -> None:
    """``save`` on every part of a forest: grown trees are not loaded for that, so ``HELD_ROWS`` does not limit them."""
    grown = isinstance(parts[0], GrownPart)
    each_part(spark, 0 if grown else rows, [(lambda p=p: p) for p in parts] if grown else parts, save, trees)


def forest_votes(rows: DataFrame, parts: Sequence[Callable[[], PipelineModel]], train_rows: int, trees: int = 100) -> DataFrame:
    """``rows`` with the ``prediction`` of the whole forest: a part is scored when it is there, and then let go.

    The votes of a part are written down by row, and added up in the order of the parts. Grown trees vote in the tasks that
    grow them. ``rows`` should be written down.
    """
    if len(parts) == 1:
        return parts[0]().transform(rows)
    count, numbered = rows.count(), rows.withColumn("_row", F.monotonically_increasing_id())
    path = work_path(rows.sparkSession, "votes")
    # A task gets the whole part, so no more tasks than the rows need.
    dealt = numbered.coalesce(max(1, -(-count // FIT_ROWS)))

    def score(turn: int, model: PipelineModel) -> None:
        made = model.transform(dealt).select("_row", vector_to_array("rawPrediction").alias("raw"))
        made.write.parquet(f"{path}/turn={turn}")

    if isinstance(parts[0], GrownPart) and count * len(parts[0].grown.columns) <= SHARED_BYTES:
        turns = parts[0].grown.votes(numbered, trees, path)
    else:
        turns = len(parts)
        each_part(rows.sparkSession, train_rows, parts, score, trees)
    votes = rows.sparkSession.read.parquet(path).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("turn", "raw"))).alias("_votes"))
    every = F.transform("_votes", lambda v: v["raw"])
    total = F.aggregate(F.slice(every, 2, turns), every[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    guess = votes.select("_row", total.alias("_total")).select("_row", (F.array_position("_total", F.array_max("_total")) - 1).cast("double").alias("prediction"))
    return numbered.join(guess, "_row").drop("_row")


class Search(NamedTuple):
    """Candidates of a search, the mean accuracy of each over the folds, and the best one fitted on all rows.

    Trees that tasks have grown are stored, and loaded when ``best`` is read.
    """

    candidates: list[dict[str, int]]
    accuracies: list[float]
    fitted: Callable[[], PipelineModel]

    @property
    def best(self) -> PipelineModel:
        return self.fitted()


class CutTrees(NamedTuple):
    """Trees as they are when they end at any of some depths.

    ``shares``: class shares of every node, tree after tree. ``leaves``: per depth the node that takes the place of each
    leaf, tree after tree. ``first``: the place of each tree's first leaf.
    """

    shares: np.ndarray
    leaves: dict[int, np.ndarray]
    first: np.ndarray


def cut_trees(model: PipelineModel, depths: Sequence[int]) -> CutTrees:
    """The trees of a fitted forest at every one of ``depths``, from its stored nodes.

    Nodes are split level by level, so a tree that ends at a depth is the deeper one cut there. As in a fit of that depth,
    a node whose leaves all predict one class is a leaf, with its own shares.
    """
    spark = SparkSession.active()
    path = work_path(spark, "trees")
    model.stages[-1].write().save(path)
    columns = ["id", "prediction", "impurityStats", "leftChild", "rightChild"]
    table = spark.read.parquet(f"{path}/data").select("treeID", *[f"nodeData.{c}" for c in columns]).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    tree, prediction, left, right = (table.column(c).to_numpy() for c in ("treeID", "prediction", "leftChild", "rightChild"))
    stats = table.column("impurityStats").combine_chunks().flatten().to_numpy().reshape(len(tree), -1)
    total = stats.sum(1, keepdims=True)
    shares = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)

    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    end = left < 0
    start = roots[tree]  # ids count from 0 in every tree, a node before those on its left, these before those on its right
    left, right = left + start, right + start
    levels = [roots]
    while len(inner := levels[-1][~end[levels[-1]]]):
        levels.append(np.concatenate([left[inner], right[inner]]))
    leaves = {}
    for depth in depths:
        leaf, label, place = end.copy(), prediction.copy(), np.arange(len(tree))
        if depth < len(levels):
            leaf[levels[depth]] = True
        for level in levels[:depth][::-1]:
            inner = level[~leaf[level]]
            a, b = left[inner], right[inner]
            one = leaf[a] & leaf[b] & (label[a] == label[b])
            leaf[inner[one]], label[inner[one]] = True, label[a[one]]
        for level in levels:
            inner = level[~end[level]]
            held = leaf[inner] | (place[inner] != inner)
            for child in (left[inner], right[inner]):
                place[child] = np.where(held, place[inner], child)
        leaves[depth] = place[end].astype(np.int32)
    return CutTrees(shares, leaves, np.cumsum(end)[roots] - end[roots])


def forest_search(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "label",
    weight: str | None = "weight",
    grid: dict[str, list] | None = None,
    folds: int = 5,
    parallelism: int = 8,
    seed: int = 42,
) -> Search:
    """Cross-validated grid search by accuracy, refitted on all rows.

    A forest is the mean of its trees, so a forest of 300 is three of 100 with seeds of their own, and its first parts are
    the forests of 100 and 200: one block of trees is fitted once and serves every candidate that holds it. A block is
    fitted at the greatest depth and cut at the lesser ones, which gives the trees of fits of their own as long as a level of
    a block's nodes goes through Spark's memory at once, and trees of other random draws beyond. The rows and their folds are
    written down, in as many partitions as they need, since a fit is some thirty jobs over them. No more fits at a time than
    ``HELD_ROWS`` allows, but one. Blocks of over ``WHOLE_ROWS`` rows times trees are grown by tasks that hold all rows, a few
    trees each, as long as these take ``SHARED_BYTES``.
    """
    spark = df.sparkSession
    grid = grid or FOREST_GRID
    names = list(grid)
    candidates = [dict(zip(names, values, strict=True)) for values in product(*grid.values())]
    block = gcd(*grid["numTrees"])
    depths = list(grid.get("maxDepth", [30]))
    kept = df.select(*columns, label, *([weight] if weight else [])).withColumn("_fold", F.floor(F.rand(seed) * folds).cast("int"))
    ensure_checkpoints(spark)
    kept = kept.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    rows = kept.count()
    held = rows * (folds - 1) // folds * block
    by_tasks = held > WHOLE_ROWS and rows * len(columns) * folds <= SHARED_BYTES and set(grid) <= {"numTrees", "maxDepth", "minInstancesPerNode"}
    kept = kept if by_tasks else kept.coalesce(max(1, -(-rows // FIT_ROWS))).persist()
    path = work_path(spark, "votes")

    def choice(c: dict[str, int]) -> tuple:
        return tuple((n, c[n]) for n in names if n not in ("numTrees", "maxDepth"))

    def fitted(part: DataFrame, trees: int, own: dict[str, int], turn: int = 0) -> PipelineModel:
        pipeline = forest(columns, label, trees=trees, weight=weight, seed=seed + turn)
        model = pipeline.getStages()[1].setCacheNodeIds(True)  # the trees stay in the driver while they grow
        return pipeline.fit(part, {model.getParam(n): v for n, v in own.items() if n != "numTrees"})

    others = list(dict.fromkeys(choice(c) for c in candidates))

    def score(task: tuple[int, int, int]) -> None:
        """Class probabilities of a fold's rows by one block of trees at every depth, for one choice of the other parameters."""
        fold, other, turn = task
        scored, train = kept.filter(F.col("_fold") == fold), kept.filter(F.col("_fold") != fold)
        model = fitted(train, block, {**dict(others[other]), "maxDepth": max(depths)}, turn)
        model.stages[-1].setLeafCol("_leaf").setPredictionCol("").setProbabilityCol("").setRawPredictionCol("")
        shared = spark.sparkContext.broadcast(tuple(cut_trees(model, depths)))

        @F.pandas_udf("array<array<double>>")
        def votes(found: pd.Series) -> pd.Series:
            shares, leaves, first = shared.value
            places = (np.stack(found.to_list()).astype(np.int64) + first).T
            made = np.stack([sum(shares[leaves[depth][place]] for place in places) for depth in depths], 1)
            return pd.Series((made / made.sum(2, keepdims=True)).tolist())

        made = model.transform(scored).select("_row", "_fold", label, votes(vector_to_array("_leaf", "float32")).alias("votes"))
        made.write.parquet(f"{path}/other={other}/turn={turn}/part={fold}")
        shared.destroy()

    def grown(voting: int) -> None:
        """The class shares of every row by trees of the other folds, ``voting`` trees together."""
        known = [kept.filter(F.col("_fold") != fold) for fold in range(folds)]
        wanted = {**{c: "float64" for c in (label, weight) if c}, "_fold": "int32", "_row": "int64"}
        every = packed(kept, columns, [candidate_cuts(part, columns) for part in known], wanted)
        truth, weights = _judged(every.others, label, weight)
        shared = spark.sparkContext.broadcast((every.x, truth, weights, every.others["_fold"], every.others["_row"]))
        classes, least = int(truth.max()) + 1, [dict(o).get("minInstancesPerNode", 1) for o in others]
        tasks = list(product(range(folds), range(len(others)), range(max(grid["numTrees"]) // voting)))

        def vote(task: int) -> Iterator[pa.RecordBatch]:
            fold, other, turn = tasks[task]
            every, truth, weights, folds_of, number = shared.value
            mine = folds_of == fold
            x, scored = every[fold][~mine], every[fold][mine]
            own = x, truth[~mine], None if weights is None else weights[~mine]
            total = np.zeros((len(scored), len(depths), classes))
            for i in range(turn * voting, (turn + 1) * voting):
                tree = grow(*own, classes, max(depths), least[other], [seed, i])
                leaves, shares = reached(tree, scored), tree.shares()
                for d, depth in enumerate(depths):
                    total[:, d] += shares[ended(tree, depth)[0][leaves]]
            keys = {"other": np.full(len(scored), other, np.int32), "turn": np.full(len(scored), turn, np.int32), "_fold": folds_of[mine], "_row": number[mine], "_label": truth[mine].astype(np.int32)}
            yield from _by_row(keys, "votes", total)

        schema = "other int, turn int, _fold int, _row long, _label int, votes array<array<double>>"
        in_tasks(spark.range(0, len(tasks), 1, len(tasks)), vote, schema).write.parquet(path)
        shared.destroy()

    turns = max(grid["numTrees"]) // block
    sizes = [(depth, trees) for depth in depths for trees in grid["numTrees"]]
    voting = max(t for t in range(1, VOTED + 1) if block % t == 0) if by_tasks else block
    try:
        if by_tasks:
            grown(voting)
        else:
            with ThreadPool(max(1, min(parallelism, HELD_ROWS // max(1, held)))) as pool:
                tasks = product(range(folds), range(len(others)), range(turns))
                pool.map(inheritable_thread_target(spark)(score), list(tasks), chunksize=1)
        by_turn = F.transform(F.array_sort(F.collect_list(F.struct("turn", "votes"))), lambda v: v["votes"])
        whole = spark.read.parquet(path).groupBy("other", "_fold", "_row").agg(F.first("_label" if by_tasks else label).alias("_label"), by_turn.alias("_votes"))

        def right(depth: int, trees: int) -> F.Column:
            every = F.transform(F.slice("_votes", 1, trees // voting), lambda v: v[depths.index(depth)])
            total = F.aggregate(F.slice(every, 2, trees // voting), every[0], lambda x, v: F.zip_with(x, v, lambda y, z: y + z))
            return F.avg((F.array_position(total, F.array_max(total)) - 1 == F.col("_label")).cast("double"))

        judged = sorted(whole.groupBy("other", "_fold").agg(*[right(*size).alias(f"_{i}") for i, size in enumerate(sizes)]).collect(), key=lambda r: r["_fold"])
        accuracies = []
        for c in candidates:
            other, i = others.index(choice(c)), sizes.index((c.get("maxDepth", depths[0]), c["numTrees"]))
            known = [r[f"_{i}"] for r in judged if r["other"] == other and r[f"_{i}"] is not None]  # a fold without rows says nothing
            accuracies.append(sum(known) / len(known))
        best = candidates[max(range(len(candidates)), key=accuracies.__getitem__)]
        if by_tasks:
            whole_forest = Grown(kept, columns, label, weight, best.get("maxDepth", depths[0]), seed, best.get("minInstancesPerNode", 1))
            stored = work_path(spark, "forest")
            GrownPart(whole_forest, 0, best["numTrees"]).save(stored)
            return Search(candidates, accuracies, partial(PipelineModel.load, stored))
        model = fitted(kept, best["numTrees"], best)
        return Search(candidates, accuracies, lambda: model)
    finally:
        kept.unpersist()


def window_vectors(windows: DataFrame, column: str = "features", output: str = "features") -> DataFrame:
    """Windows as one flat vector each: sample after sample."""
    flat = F.flatten(F.col(column))
    if isinstance(windows.schema[column].dataType.elementType, T.DoubleType):  # type: ignore[attr-defined]
        flat = F.col(column)
    return windows.withColumn(output, array_to_vector(flat))


def binary_window_model(windows: DataFrame, label: str = "label", iterations: int = 100) -> PipelineModel:
    """Two-class model on flat windows; its probability takes the place of the network's output."""
    stage = LogisticRegression(labelCol=label, maxIter=iterations, regParam=1e-3)
    return Pipeline(stages=[stage]).fit(windows)


def multiclass_window_model(
    windows: DataFrame, inputs: int, classes: int = 4, hidden: Sequence[int] = (16, 8), label: str = "label",
    iterations: int = 100, seed: int = 111,
) -> PipelineModel:
    """Small multilayer network on flat windows."""
    stage = MultilayerPerceptronClassifier(labelCol=label, layers=[inputs, *hidden, classes], maxIter=iterations, seed=seed)
    return Pipeline(stages=[stage]).fit(windows)


def forecaster(pairs: DataFrame, target: str = "target", iterations: int = 100) -> PipelineModel:
    """Next-sample regression on the window of past samples with Huber loss."""
    stage = LinearRegression(labelCol=target, loss="huber", maxIter=iterations)
    return Pipeline(stages=[stage]).fit(pairs)


def history(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Objective per iteration of the last stage, where the stage keeps one."""
    summary = model.stages[-1].summary
    rows = [(i, float(v)) for i, v in enumerate(summary.objectiveHistory)]
    return df.sparkSession.createDataFrame(rows, "iteration int, loss double")


def series_means(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean of each column per series."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


class Clusters(NamedTuple):
    """Centres in the order of their coordinates, and the sum of squared distances of the rows to their own."""

    centres: list[list[float]]
    cost: float


def _drawn(rows: DataFrame, centres: np.ndarray, seed: int) -> np.ndarray:
    """One more centre for every start: a row drawn by its squared distance from the start's centres, in one scan.

    Each row draws an exponential time over its weight and the earliest one wins, so tasks draw apart from one another.
    """
    starts, have, _ = centres.shape

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, have, TaskContext.get().partitionId()])
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            if not len(x):
                continue
            weight = np.ones((starts, len(x)))
            if have:
                weight = np.stack([np.min([((x - c) ** 2).sum(1) for c in own], axis=0) for own in centres])
            with np.errstate(divide="ignore"):
                time = rng.exponential(size=weight.shape) / weight
            first = time.argmin(1)
            yield pa.RecordBatch.from_pydict({"start": np.arange(starts), "time": time[np.arange(starts), first], "x": x[first].tolist()})

    made = rows.mapInArrow(draw, "start long, time double, x array<double>")
    found = made.groupBy("start").agg(F.min_by("x", F.struct("time", "x")).alias("x")).collect()
    new = np.array([r.x for r in sorted(found, key=lambda r: r.start)])
    return np.concatenate([centres.reshape(starts, have, new.shape[1]), new[:, None]], axis=1)


def _assigned(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums and squared distances of the clusters of every start: one scan, one number per entry from a task."""
    starts, k, d = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((starts, k, d + 2))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for start, own in enumerate(centres):
                far = np.stack([((x - c) ** 2).sum(1) for c in own])
                at = far.argmin(0)
                for c in range(k):
                    totals[start, c, :-1] += wide[at == c].sum(0)
                    totals[start, c, -1] += far[c, at == c].sum()
        yield pa.RecordBatch.from_pydict({"entry": np.arange(totals.size), "total": totals.ravel()})

    found = rows.mapInArrow(add, "entry long, total double").groupBy("entry").agg(F.sum("total").alias("total")).collect()
    totals = np.zeros(starts * k * (d + 2))
    for r in found:
        totals[r.entry] = r.total
    totals = totals.reshape(starts, k, d + 2)
    return totals[..., -2], totals[..., :-2], totals[..., -1].sum(1)


def cluster(
    df: DataFrame, columns: Sequence[str], k: int = 2, restarts: int = 14, seed: int = 0, iterations: int = 20, moved: float = 1e-4
) -> tuple[DataFrame, Clusters]:
    """k-means with several starts, the cheapest kept; adds ``cluster``. Needs at least ``k`` rows.

    All starts share a scan: one per centre drawn, one per iteration, until no centre moves by more than ``moved``, and one
    for the costs. Rows with a null or NaN among ``columns`` take no part and get no cluster. Clusters are numbered by
    their centres' coordinates; a row as near to two goes to the first; a centre without rows stays where it is.
    """
    ensure_checkpoints(df.sparkSession)
    numbers = [F.col(c).cast("double") for c in columns]
    whole = F.lit(True)
    for x in numbers:
        whole = whole & x.isNotNull() & ~F.isnan(x)
    rows = df.filter(whole).select(F.array(*numbers).alias("x")).checkpoint(eager=True)
    if len(rows.head(k)) < k:
        raise ValueError(f"clustering needs at least {k} series")
    centres = np.zeros((restarts, 0, len(columns)))
    for _ in range(k):
        centres = _drawn(rows, centres, seed)
    for _ in range(iterations):
        count, total, _ = _assigned(rows, centres)
        means = np.where(count[..., None] > 0, total / np.maximum(count, 1)[..., None], centres)
        far = np.sqrt(((means - centres) ** 2).sum(2)).max()
        centres = means
        if far <= moved:
            break
    costs = _assigned(rows, centres)[2]
    best = sorted(centres[costs.argmin()].tolist())
    squares = [sum(((x - F.lit(v)) * (x - F.lit(v)) for x, v in zip(numbers[1:], c[1:], strict=True)), (numbers[0] - F.lit(c[0])) * (numbers[0] - F.lit(c[0]))) for c in best]
    place = (F.array_position(F.array(*squares), F.array_min(F.array(*squares))) - 1).cast("int")
    return df.withColumn("cluster", F.when(whole, place)), Clusters(best, float(costs.min()))


def members(clustered: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Membership list as rows ordered by cluster and name (a list per cluster could be any length)."""
    return clustered.select("cluster", *keys).orderBy("cluster", *keys)


def silhouette(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distance from per-cluster sums: linear in the rows.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.S/n + Q/n with the cluster's sum S, sum of
    squared norms Q and size n. A point alone in its cluster scores 0.
    """
    norm = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    stats = df.groupBy(F.col(cluster).alias("c")).agg(
        F.count("*").alias("size"), F.sum(norm).alias("q"), F.array(*[F.sum(c) for c in columns]).alias("s")
    )
    # One row holding one entry per cluster.
    table = stats.agg(F.collect_list(F.struct("c", "size", "q", "s")).alias("_stats"))
    dot = lambda s: sum((F.col(c) * s[i] for i, c in enumerate(columns[1:], 1)), F.col(columns[0]) * s[0])
    rows = df.withColumn("_norm", norm).join(F.broadcast(table), how="cross")
    other = F.array_min(
        F.transform(
            F.filter("_stats", lambda t: t["c"] != F.col(cluster)),
            lambda t: F.col("_norm") - F.lit(2.0) * dot(t["s"]) / t["size"] + t["q"] / t["size"],
        )
    )
    rows = rows.withColumn("_own", F.filter("_stats", lambda t: t["c"] == F.col(cluster))[0]).withColumn("_b", other)
    own_sum = F.col("_norm") * F.col("_own.size") - F.lit(2.0) * dot(F.col("_own.s")) + F.col("_own.q")
    a = own_sum / F.nullif(F.col("_own.size") - F.lit(1), F.lit(0))
    score = F.when(F.col("_own.size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - a, F.greatest("_b", a)), F.lit(0.0))
    )
    return rows.agg(F.avg(score).alias("silhouette"), F.count("*").alias("points"))


def project_2d(df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]] = ()) -> tuple[DataFrame, list[list[float]]]:
    """Two principal components of the points (columns ``pc1``, ``pc2``) and of the centroids.

    Points are centred first. The sign of a component makes its largest loading positive.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = [float(means[c]) for c in columns]
    centred = _vectors(df.withColumns({f"_c{i}": F.col(c) - F.lit(centre[i]) for i, c in enumerate(columns)}), [f"_c{i}" for i in range(len(columns))])
    model: PCAModel = PCA(k=2, inputCol="features", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] > 0 else -1.0 for j in range(2)]
    parts = vector_to_array(F.col("_pc"))
    out = model.transform(centred).withColumns({f"pc{j + 1}": parts[j] * F.lit(signs[j]) for j in range(2)})
    moved = [((np.asarray(c) - centre) @ loadings * signs).tolist() for c in centroids]
    return out.drop("_pc", "features", *[f"_c{i}" for i in range(len(columns))]), moved


def score_windows(
    windows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str = "features", output: str = "probs"
) -> DataFrame:
    """Score windows with a user's model: ``load`` runs once per task and returns a function from a
    ``(batch, samples, channels)`` float32 array to ``(batch, classes)``."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            stacked = np.stack([np.stack(list(w)) for w in batch]).astype(np.float32)
            yield pd.Series(list(np.asarray(model(stacked), dtype=float).reshape(len(batch), -1)))

    return windows.withColumn(output, score(F.col(features)))


def per_column(df: DataFrame, columns: Sequence[str], function: Callable, suffix: str) -> DataFrame:
    """Apply one Column -> Column function to many columns."""
    return df.withColumns({f"{c}{suffix}": function(F.col(c)) for c in columns})


def per_series(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Apply a pandas function to each whole series. Only for series that fit one task by their nature
    (a recording); operators of this package use lanes instead."""
    return df.groupBy(*keys).applyInPandas(function, schema)
