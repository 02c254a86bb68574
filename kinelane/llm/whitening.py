"""Whitening of embeddings: exact integer scatter counted on bit planes, then eigenvectors of the centred sums."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of the vectors whose planes are counted together.
BLOCK_ENTRIES = 1 << 22
#: Sums travel as five numbers of 32 bits (the last one with the sign), which Spark adds without a loss.
LIMB_BITS, LIMBS = 32, 5
#: Eigenvalues below this share of the greatest are found anew from the exact sums; below the second, they are zero.
GRADED, ZERO = 1e-8, 1e-26


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors that are not null or empty and hold finite entries only."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    length = np.diff(offsets)
    good = (length > 0) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == size))
        step = max(1, BLOCK_ENTRIES // size)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield size, part, values[offsets[part][:, None] + np.arange(size)]


def quantised(entries: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """``floor(scale * c) + shift`` as 64-bit integers; entries beyond 2 ** 62 keep that size and their sign."""
    return np.clip(np.floor(entries * scale), -(2.0**62), 2.0**62).astype(np.int64) + shift


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact products of the columns (1, x) summed over the rows, as Python integers.

    Columns are shifted to begin at 0 and cut into bit planes; a plane is packed over the rows into words. The product
    of two columns is the sum of 2 ** (a + b) times the common ones of plane a of the one and plane b of the other.
    """
    n, size = x.shape
    low = x.min(axis=0)
    rest = x.astype(np.uint64) - low.astype(np.uint64)
    widths = [max(1, int(m).bit_length()) for m in rest.max(axis=0)]
    planes = np.zeros((1 + sum(widths), -(-n // 64) * 8), np.uint8)
    packed = -(-n // 8)
    planes[0, :packed] = np.packbits(np.ones(n, bool))
    weights, starts = [1], [0]
    for k, (column, width) in enumerate(zip(rest.T, widths, strict=True)):
        starts.append(len(weights))
        bits = (column[None, :] >> np.arange(width, dtype=np.uint64)[:, None]) & np.uint64(1)
        planes[starts[-1] : starts[-1] + width, :packed] = np.packbits(bits.astype(np.uint8), axis=1)
        weights += [1 << b for b in range(width)]
    words = planes.view(np.uint64)
    common = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        common[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    common += np.triu(common, 1).T
    kind = np.int64 if 2 * max(widths) + n.bit_length() < 62 else object
    weight = np.array(weights, kind)
    made = common.astype(kind) * weight[:, None] * weight[None, :]
    made = np.add.reduceat(np.add.reduceat(made, starts, axis=0), starts, axis=1).astype(object)
    begin = np.array([0, *low.tolist()], object)
    return made + np.multiply.outer(begin, made[0]) + np.multiply.outer(made[0], begin) + n * np.multiply.outer(begin, begin)


def _limbs(value: int) -> list[int]:
    mask = (1 << LIMB_BITS) - 1
    return [(value >> (LIMB_BITS * k)) & mask for k in range(LIMBS - 1)] + [value >> (LIMB_BITS * (LIMBS - 1))]


def products(df: DataFrame, vector_column: str, scale: float, shift: int) -> dict[int, np.ndarray]:
    """Per length of vector, the exact sums of products of (1, x) over all rows.

    Tasks count their own rows and hand on one number per pair of dimensions; the driver gets these sums alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, entries in vectors(batch.column(0)):
                total[size] = total.get(size, 0) + scatter(quantised(entries, scale, shift))
        for size, made in total.items():
            i, j = np.triu_indices(size + 1)
            limbs = [_limbs(v) for v in made[i, j].tolist()]
            columns = [pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([v[k] for v in limbs], pa.int64()) for k in range(LIMBS)], names=names)

    names = ["size", "i", "j", *[f"limb{k}" for k in range(LIMBS)]]
    slim = df.select(F.col(vector_column).cast("array<double>").alias("vector"))
    parts = slim.mapInArrow(run, ", ".join(f"{n} {'int' if k < 3 else 'long'}" for k, n in enumerate(names)))
    found: dict[int, np.ndarray] = {}
    for row in parts.groupBy("size", "i", "j").agg(*[F.sum(n).alias(n) for n in names[3:]]).toLocalIterator():
        size, i, j, *limbs = row
        own = found.setdefault(size, np.zeros((size + 1, size + 1), object))
        own[i, j] = own[j, i] = sum(v << (LIMB_BITS * k) for k, v in enumerate(limbs))
    return found


class Whitening(NamedTuple):
    """Length of the vectors, rows and sums of the fit list, components as columns, their eigenvalues, trace of all."""

    size: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Rows minus their mean, and n squared times their squared length, as exact integers."""
        whole = [s // self.n for s in self.sums]
        rest = [s - self.n * a for s, a in zip(self.sums, whole, strict=True)]
        y = x.astype(object) - np.array(whole, object) if max(map(abs, whole)) + int(np.abs(x).max()) >= 1 << 62 else x - np.array(whole, np.int64)
        most = int(np.abs(y).max()) + 1
        exact = y if self.size * most * max(most, self.n) < 1 << 62 else y.astype(object)
        squares, mixed = (exact * exact).sum(axis=1).tolist(), (exact * np.array(rest, exact.dtype)).sum(axis=1).tolist()
        left = sum(r * r for r in rest)
        length = [self.n * self.n * a - 2 * self.n * b + left for a, b in zip(squares, mixed, strict=True)]
        return y.astype(np.float64) - np.array([r / self.n for r in rest]), length

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """Coordinates on the components over their deviations; NaN on components without variance."""
        some = self.values > 0
        out = np.full((len(centred), len(some)), np.nan)
        out[:, some] = centred @ self.components[:, some] / np.sqrt(self.values[some])
        return out


def _rotated(matrix: np.ndarray, vectors_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi rotations until every pair of ``vectors_`` is free of the other, each to the scale of its own values."""
    a, q = matrix.copy(), vectors_.copy()
    for _ in range(30):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) <= 1e-15 * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                slope = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = np.copysign(1 / (abs(slope) + np.hypot(1, slope)), slope)
                c = 1 / np.hypot(1, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                diagonal = a[i, i] - t * a[i, j], a[j, j] + t * a[i, j]
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                a[i, i], a[j, j] = diagonal
                a[i, j] = a[j, i] = 0
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    return np.diag(a), q


def fit(sums: np.ndarray, components: int) -> Whitening:
    """Eigenvectors of the covariance, which is centred as integers: n times the products less the product of the sums.

    Where eigenvalues span many orders of magnitude, the covariance is turned to the eigenvectors in exact integers
    and diagonalised again by rotations, which keep the small values to their own precision.
    """
    n, size = int(sums[0, 0]), len(sums) - 1
    centred = n * sums[1:, 1:] - np.multiply.outer(sums[0, 1:], sums[0, 1:])
    square = n * n
    covariance = np.array([[v / square for v in row] for row in centred.tolist()])
    values, found = np.linalg.eigh(covariance)
    greatest = values[-1]
    if greatest > 0 and values[max(0, size - components)] < GRADED * greatest:
        unit = 1 << 60
        whole = np.array([[int(v * unit) for v in row] for row in found.tolist()], object)
        turned = np.array([[v / (square * unit * unit) for v in row] for row in whole.T.dot(centred).dot(whole).tolist()])
        values, found = _rotated(turned, found)
        found = found / np.linalg.norm(found, axis=0)
    order = np.argsort(-values, kind="stable")[:components]
    values, found = values[order], found[:, order]
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    values = np.where(values > ZERO * max(greatest, 0), values, 0.0)
    return Whitening(size, n, [int(s) for s in sums[0, 1:]], found, values, sum(centred.diagonal().tolist()) / square)


def identity_error(df: DataFrame, model: Whitening, vector_column: str, scale: float, shift: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on all rows."""
    some = np.flatnonzero(model.values > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(some) + 1, len(some) + 1))
        for batch in batches:
            for size, _, entries in vectors(batch.column(0)):
                if size == model.size:
                    made = model.whiten(model.centred(quantised(entries, scale, shift))[0])[:, some]
                    made = np.concatenate([np.ones((len(made), 1)), made], axis=1)
                    total += made.T @ made
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    if not len(some):
        return 0.0
    slim = df.select(F.col(vector_column).cast("array<double>").alias("vector"))
    found = np.zeros((len(some) + 1, len(some) + 1))
    for i, j, v in slim.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[i, j] = found[j, i] = v / model.n
    return float(np.abs(found[1:, 1:] - np.outer(found[0, 1:], found[0, 1:]) - np.eye(len(some))).max())


def whitened(df: DataFrame, model: Whitening, id_column: str, vector_column: str, scale: float, shift: int) -> DataFrame:
    """``id, deviation, whitened``: one row per vector of the model's length, coordinates as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, entries in vectors(batch.column(1)):
                if size == model.size:
                    centred, length = model.centred(quantised(entries, scale, shift))
                    made = model.whiten(centred)
                    lists = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.array(made.ravel(), from_pandas=True))
                    exact = pa.array(length, pa.int64()).cast(number) if max(length) < 1 << 63 else pa.array([v if v < 10**38 else None for v in length], number)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), exact, lists], names=["id", "deviation", "whitened"])

    number = pa.decimal128(38, 0)
    slim = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return slim.mapInArrow(run, T.StructType([T.StructField("id", df.schema[id_column].dataType), *T.StructType.fromDDL("deviation decimal(38,0), whitened array<double>")]))


def whiten(df: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component.

    Entries become integers ``floor(scale * c) + shift``. One pass counts their products, the driver holds these sums
    only (their number is the square of the length of a vector), one pass measures ``identity_error``, one returns
    the rows. ``deviation`` (the squared length of n times a row minus the sums) is an exact decimal of 38 digits, null
    beyond.

    Vectors that are null or empty or hold null or non-finite entries take no part; nor do vectors of another length
    than the commonest (the greater of equally common ones). Components without variance have ``explained`` 0 and null
    ``whitened``, and are left out of ``identity_error``. Null ids and repeated rows stay, each in the fit list; without
    vectors there are no rows; other columns are not read.
    """
    found = products(df, vector_column, scale, shift)
    kind = df.schema[id_column].dataType
    if not found:
        schema = T.StructType([T.StructField("vec_id", kind), *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")])
        return df.sparkSession.createDataFrame([], schema)
    model = fit(max(found.items(), key=lambda f: (f[1][0, 0], f[0]))[1], components)
    error = identity_error(df, model, vector_column, scale, shift)
    rows = whitened(df, model, id_column, vector_column, scale, shift).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values])
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
