"""Trees of a random forest, each grown by one task on all training rows, whose features are one byte each.

The learner is that of Spark's forests: at most 32 bins a feature, Poisson counts in place of drawn rows, the square root of
the features as candidates of a node, Gini gain, nodes whose leaves all predict one class as leaves. Spark grows a level of
all trees with a job over the rows and moves a histogram per node, which deep trees make large; here a tree stays in its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BINS = 32
NODES = 2048  # nodes of a level that are judged at a time
LEAST_GAIN = 1e-12


def candidate_cuts(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Values that may divide the rows by each feature: between all values where there are few, else at quantiles."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)])

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * len(columns)
        for batch in batches:
            seen = [np.unique(np.concatenate([old, _finite(batch.column(i))]))[: BINS + 1] for i, old in enumerate(seen)]
        yield pa.RecordBatch.from_pydict({"feature": np.arange(len(seen)), "found": [v.tolist() for v in seen]}, schema=pa.schema({"feature": pa.int64(), "found": pa.list_(pa.float64())}))

    known: list[set] = [set() for _ in columns]
    for r in numbers.mapInArrow(few, "feature long, found array<double>").toLocalIterator():
        if len(known[r.feature]) <= BINS:
            known[r.feature].update(r.found)
    marks = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    many = [i for i, values in enumerate(known) if len(values) > BINS]
    cuts = [np.convolve(np.sort(list(values)), [0.5, 0.5], "valid") if 1 < len(values) <= BINS else np.empty(0) for values in known]
    if many:
        for i, found in zip(many, numbers.agg(*[F.percentile_approx(f"f{i}", marks, F.lit(10_000)) for i in many]).first(), strict=True):
            cuts[i] = np.unique(found)
    return cuts


def _finite(column: pa.Array) -> np.ndarray:
    """The values of a feature, none of which may be missing."""
    x = column.to_numpy(zero_copy_only=False)
    if column.null_count or np.isnan(x).any():
        raise ValueError("a feature of a forest is null or NaN")
    return x


class Packed(NamedTuple):
    """Rows as arrays: a byte per feature for every list of cuts, and the other columns wanted."""

    x: list[np.ndarray]
    others: dict[str, np.ndarray]


def packed(df: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[np.ndarray]], others: dict[str, str]) -> Packed:
    """All rows of ``df`` at the driver; ``others`` are columns and their types. For bounded tables only."""
    names = [f"x{k}" for k in range(len(cuts))]
    features, kinds = len(columns), {c: np.dtype(t) for c, t in others.items()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [_finite(batch.column(i)) for i in range(features)]
            made = {n: [np.stack([np.searchsorted(c, v) for c, v in zip(own, values, strict=True)], 1).astype(np.uint8).tobytes()] for n, own in zip(names, cuts, strict=True)}
            for i, (c, kind) in enumerate(kinds.items(), features):
                column = batch.column(i)
                if column.null_count:
                    raise ValueError(f"{c} of a training row is null")
                made[c] = [column.to_numpy(zero_copy_only=False).astype(kind).tobytes()]
            yield pa.RecordBatch.from_pydict(made)

    wanted = df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)], *others)
    found = wanted.mapInArrow(pack, ", ".join(f"`{c}` binary" for c in [*names, *others])).toArrow()

    def whole(name: str, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(b"".join(v.as_buffer() for v in found.column(name)), kind)

    return Packed([whole(n, np.dtype(np.uint8)).reshape(-1, features) for n in names], {c: whole(c, kind) for c, kind in kinds.items()})


class Tree(NamedTuple):
    """Nodes level by level; the right child follows the left one; a leaf has -1 as feature and child.

    ``feature``, ``cut``: rows up to bin ``cut`` go to the left. ``weights``, ``rows``: weight by class and number of rows.
    ``levels``: the first node of every level, and the number of nodes.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    weights: np.ndarray
    rows: np.ndarray
    levels: np.ndarray

    def shares(self) -> np.ndarray:
        """Class shares of every node."""
        total = self.weights.sum(1, keepdims=True)
        return np.divide(self.weights, total, out=np.zeros_like(self.weights), where=total != 0)


def grow(x: np.ndarray, label: np.ndarray, weight: np.ndarray | None, classes: int, depth: int, least: int, seed: Sequence[int]) -> Tree:
    """One tree on a bootstrap of the rows; ``x`` holds bins by row, ``least`` is the fewest rows of a child."""
    rng = np.random.default_rng(seed)
    n, features = x.shape
    flat, tried = x.ravel(), int(np.ceil(np.sqrt(features))) if features else 0
    drawn = rng.poisson(1.0, n)
    counts = drawn.astype(np.float64)
    weights = counts if weight is None else counts * weight
    rows = np.flatnonzero(drawn)
    sizes = np.array([len(rows)])
    levels, made = [0], []
    while len(sizes):
        k, node = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        own = np.stack([np.bincount(node, np.where(label[rows] == c, weights[rows], 0.0), k) for c in range(classes)], 1)
        inside = np.bincount(node, counts[rows], k)
        feature, cut, left, gain = np.full(k, -1), np.full(k, -1), np.full(k, -1), np.full(k, -1.0)
        levels.append(levels[-1] + k)
        open_ = (own.max(1) < own.sum(1)) & (inside >= 2 * least) & (len(levels) - 2 < depth)
        kept = open_[node]
        rows, places, sizes = rows[kept], np.flatnonzero(open_), sizes[open_]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        next_rows, next_sizes = [], []
        for at in range(0, len(places), NODES):
            some, part = places[at : at + NODES], rows[ends[at] : ends[min(at + NODES, len(places))]]
            split = _best(flat, features, part, sizes[at : at + NODES], own[some], label, weights, None if weight is None else counts, least, rng.random((len(some), features)).argsort(1)[:, :tried])
            feature[some], cut[some], gain[some] = split
            cells = sizes[at : at + NODES]
            goes = np.repeat(feature[some] >= 0, cells)
            part, turn = part[goes], np.repeat(np.arange(len(some)), cells)[goes]
            right = flat.take(part * features + feature[some][turn]) > cut[some][turn]
            side = (2 * turn + right).astype(np.uint16)
            next_rows.append(part[np.argsort(side, kind="stable")])
            found = np.bincount(side, minlength=2 * len(some))
            next_sizes.append(found.reshape(-1, 2)[feature[some] >= 0].ravel())
        inner = np.flatnonzero(feature >= 0)
        left[inner] = levels[-1] + 2 * np.arange(len(inner))
        made.append((feature, cut, left, gain, own, inside))
        rows = np.concatenate(next_rows) if next_rows else rows[:0]
        sizes = np.concatenate(next_sizes) if next_sizes else sizes[:0]
    return Tree(*[np.concatenate(v) for v in zip(*made, strict=True)], np.array(levels))


def _best(
    flat: np.ndarray, features: int, rows: np.ndarray, sizes: np.ndarray, own: np.ndarray, label: np.ndarray, weights: np.ndarray,
    counts: np.ndarray | None, least: int, tried: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin to the left and gain of the best split of each node among the features ``tried``; -1 without one."""
    k, classes = own.shape
    node = np.repeat(np.arange(k), sizes)
    class_cells = label[rows].astype(np.int64) * (k * BINS) + node * BINS
    row_weights, start = weights[rows], rows * features
    total = own.sum(1)
    feature, cut, best = np.full(k, -1), np.full(k, -1), np.full(k, -np.inf)
    each = np.arange(k)
    for chosen in tried.T:
        bins = flat.take(start + chosen[node])
        hist = np.bincount(class_cells + bins, row_weights, classes * k * BINS).reshape(classes, k, BINS)
        lefts = hist.cumsum(2)[:, :, :-1]
        at_left = lefts.sum(0)
        at_right = total[:, None] - at_left
        if counts is None:
            rows_left, rows_right = at_left, at_right
        else:
            rows_left = np.bincount(node * BINS + bins, counts[rows], k * BINS).reshape(k, BINS).cumsum(1)
            rows_left, rows_right = rows_left[:, :-1], rows_left[:, -1:] - rows_left[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            purity = sum(lefts[c] ** 2 / at_left + (own[:, c, None] - lefts[c]) ** 2 / at_right for c in range(classes))
        purity = np.where((rows_left >= least) & (rows_right >= least) & ~np.isnan(purity), purity, -np.inf)
        place = purity.argmax(1)
        found = purity[each, place]
        more = found > best
        feature[more], cut[more], best[more] = chosen[more], place[more], found[more]
    gain = best / total - (own**2).sum(1) / total**2
    bad = ~(gain > LEAST_GAIN)
    feature[bad], cut[bad], gain[bad] = -1, -1, -1.0
    return feature, cut, gain


def ended(tree: Tree, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The node that takes the place of every node in the tree that ends at ``depth``, and the prediction of every node.

    As in Spark, a node whose leaves all predict one class is a leaf, with its own shares.
    """
    leaf, label, place = tree.left < 0, tree.weights.argmax(1).astype(np.float64), np.arange(len(tree.left))
    spans = list(zip(tree.levels[:-1], tree.levels[1:], strict=True))
    if depth < len(spans):
        leaf[slice(*spans[depth])] = True
    for first, last in spans[:depth][::-1]:
        inner = first + np.flatnonzero(~leaf[first:last])
        a = tree.left[inner]
        one = leaf[a] & leaf[a + 1] & (label[a] == label[a + 1])
        leaf[inner[one]], label[inner[one]] = True, label[a[one]]
    for first, last in spans:
        inner = first + np.flatnonzero(tree.left[first:last] >= 0)
        held = leaf[inner] | (place[inner] != inner)
        for child in (tree.left[inner], tree.left[inner] + 1):
            place[child] = np.where(held, place[inner], child)
    return place, label


def reached(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    flat, features = x.ravel(), x.shape[1]
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live := live[tree.left[at[live]] >= 0]):
        here = at[live]
        at[live] = tree.left[here] + (flat.take(live * features + tree.feature[here]) > tree.cut[here])
    return at


def node_rows(tree: Tree, number: int, cuts: Sequence[np.ndarray], depth: int, form: pa.Schema) -> pa.RecordBatch:
    """The nodes of a tree as Spark stores them: ``form`` has ``treeID`` and ``nodeData``."""
    place, label = ended(tree, depth)
    kept = np.flatnonzero(place == np.arange(len(place)))
    leaf = np.zeros(len(place), bool)
    leaf[place[tree.left < 0]] = True
    ids = np.cumsum(place == np.arange(len(place))) - 1
    end = leaf[kept]
    inner = kept[~end]
    left = np.where(end, -1, ids[np.where(end, 0, tree.left[kept])])
    shares = tree.shares()[kept]
    cells = np.concatenate([[0], np.cumsum(~end)]).astype(np.int32)
    limits = np.array([cuts[f][c] for f, c in zip(tree.feature[inner], tree.cut[inner], strict=True)], np.float64)
    kind = form.field("nodeData").type
    parts = {
        "id": np.arange(len(kept)),
        "prediction": label[kept],
        "impurity": np.where(shares.any(1), 1.0 - (shares**2).sum(1), 0.0),
        "impurityStats": pa.ListArray.from_arrays(np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32), tree.weights[kept].ravel()),
        "rawCount": tree.rows[kept].astype(np.int64),
        "gain": np.where(end, -1.0, tree.gain[kept]),
        "leftChild": left,
        "rightChild": np.where(end, -1, left + 1),
    }
    split = {
        "featureIndex": np.where(end, -1, tree.feature[kept]),
        "leftCategoriesOrThreshold": pa.ListArray.from_arrays(cells, limits),
        "numCategories": np.full(len(kept), -1),
    }
    own = kind.field("split").type
    parts["split"] = pa.StructArray.from_arrays([pa.array(split[f.name]).cast(f.type) for f in own], fields=list(own))
    nodes = pa.StructArray.from_arrays([pa.array(parts[f.name]).cast(f.type) for f in kind], fields=list(kind))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), number)).cast(form.field("treeID").type), nodes], schema=form)


def in_tasks(df: DataFrame, work: Callable[[int], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``work`` on every number of the one column of ``df``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from work(number)

    return df.mapInArrow(each, schema)
