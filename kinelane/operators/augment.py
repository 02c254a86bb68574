"""Augmented variants of recordings: noise, jitter, rotation and resampling to twice the length."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelane.functions.signal import normals, rotate_xy
from kinelane.operators.lanes import LANE, Lanes
from kinelane.schema import AXES, LENGTH

# The weight of a far knot in a cubic spline falls by a factor of about 3.7 per knot, so beyond 48 knots
# it is below 1e-27: a lane with this halo gives the same doubles as one spline over the whole series.
SPLINE_HALO = 48


def _identity(lanes: Lanes, seed: int) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in lanes.keys], F.col(lanes.seq).cast("string"), F.lit(str(seed)))


def add_noise(
    df: DataFrame, columns: Sequence[str] = tuple(AXES), level: float = 0.02, seed: int = 42, lanes: Lanes = Lanes()
) -> DataFrame:
    """Add N(0, level). Draws are a function of (series, seq, axis, seed): reruns and retries agree."""
    draws = normals(_identity(lanes, seed), len(columns))
    return df.withColumns({c: F.col(c) + F.lit(level) * z for c, z in zip(columns, draws)})


def jitter(
    df: DataFrame, columns: Sequence[str] = tuple(AXES), factor: float = 0.01, seed: int = 43, lanes: Lanes = Lanes()
) -> DataFrame:
    """Add ``factor`` times the series' population deviation times N(0, 1)."""
    stats = df.groupBy(*lanes.keys).agg(
        F.count("*").alias(LENGTH), *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns]
    )
    draws = normals(_identity(lanes, seed), len(columns))
    return (
        lanes.attach(df, stats)
        .withColumns({c: F.col(c) + F.lit(factor) * F.col(f"_sd_{c}") * z for c, z in zip(columns, draws)})
        .drop(*[f"_sd_{c}" for c in columns])
    )


def rotate(df: DataFrame, pairs: Sequence[tuple[str, str]] = (("acc_x", "acc_y"), ("gyro_x", "gyro_y")), degrees: float = 10.0) -> DataFrame:
    made: dict[str, Column] = {}
    for x, y in pairs:
        made[x], made[y] = rotate_xy(x, y, degrees)
    return df.withColumns(made)


def resample_linear(
    df: DataFrame, columns: Sequence[str], factor: int = 2, lanes: Lanes = Lanes()
) -> DataFrame:
    """``factor * n`` samples at positions ``k(n-1)/(factor*n-1)``, linear between neighbours.

    Every input row makes the outputs that fall between it and the next row, so nothing is joined.
    """
    n, pos = F.col(LENGTH), F.col(lanes.seq)
    out = n * F.lit(factor)
    steps = out - F.lit(1)
    # Smallest k with k(n-1) >= pos*(factor*n-1), in whole numbers.
    first = F.when(n > 1, F.floor((pos * steps + n - F.lit(2)) / (n - F.lit(1)))).otherwise(F.lit(0))
    after = F.when(n > 1, F.floor(((pos + 1) * steps + n - F.lit(2)) / (n - F.lit(1)))).otherwise(out)
    last = F.when(pos == n - 1, out - 1).otherwise(after - 1).cast("long")
    first = first.cast("long")

    def make(d: DataFrame) -> DataFrame:
        nexts = {f"_next_{c}": F.coalesce(F.lead(c).over(lanes.window), F.col(c)) for c in columns}
        return d.withColumns(nexts)

    pairs = lanes.run(lanes.with_length(df), 0, 1, make).filter(first <= last)
    wide = pairs.withColumn("_k", F.explode(F.sequence(first, last)))
    share = F.when(n > 1, (F.col("_k") * (n - 1) - pos * steps) / steps).otherwise(F.lit(0.0))
    return wide.select(
        *lanes.keys,
        F.col("_k").alias(lanes.seq),
        out.alias(LENGTH),
        *[(F.col(c) + (F.col(f"_next_{c}") - F.col(c)) * share).alias(c) for c in columns],
    )


DECAY = 3.0**0.5 - 2.0
KERNEL = DECAY ** np.abs(np.arange(-SPLINE_HALO, SPLINE_HALO + 1)) / (2.0 * 3.0**0.5)


def _spline_second(y: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """Second derivatives of the interpolating cubic on unit knots; y is (knots, columns).

    The knots satisfy M[i-1] + 4 M[i] + M[i+1] = r[i]: a convolution of r with a decaying kernel plus two
    decaying terms that meet the end values. At a true end of the series the not-a-knot condition makes
    6 M = r next to the end; at a lane's halo end any value does.
    """
    m = len(y)
    r = np.zeros_like(y)
    r[1:-1] = 6.0 * (y[2:] - 2.0 * y[1:-1] + y[:-2])
    lo, hi = (1 if left else 0), (m - 2 if right else m - 1)
    known_lo = r[lo] / 6.0 if left else np.zeros(y.shape[1])
    known_hi = r[hi] / 6.0 if right else np.zeros(y.shape[1])
    free = np.zeros_like(y)
    free[lo + 1 : hi] = r[lo + 1 : hi]
    part = np.column_stack([np.convolve(col, KERNEL)[SPLINE_HALO : SPLINE_HALO + m] for col in free.T])
    span = DECAY ** (hi - lo)
    gap_lo, gap_hi = known_lo - part[lo], known_hi - part[hi]
    from_lo = (gap_lo - span * gap_hi) / (1.0 - span * span)
    from_hi = (gap_hi - span * gap_lo) / (1.0 - span * span)
    at = np.arange(m)[:, None]
    second = part + from_lo * DECAY ** np.abs(at - lo) + from_hi * DECAY ** np.abs(hi - at)
    if left:
        second[0] = 2.0 * second[1] - second[2]
    if right:
        second[-1] = 2.0 * second[-2] - second[-3]
    return second


def resample_cubic(
    df: DataFrame, columns: Sequence[str] = tuple(AXES), factor: int = 2, lanes: Lanes = Lanes()
) -> DataFrame:
    """Not-a-knot cubic spline sampled at ``k(n-1)/(factor*n-1)``. Series with fewer than 4 rows are left out."""
    keys, seq, rows = list(lanes.keys), lanes.seq, lanes.rows
    columns = list(columns)

    def one(rows_in: pa.Table) -> pa.Table:
        n, lane = rows_in.column(LENGTH)[0].as_py(), rows_in.column(LANE)[0].as_py()
        steps = factor * n - 1
        own_lo, own_hi = lane * rows, min((lane + 1) * rows, n - 1)
        if own_lo >= own_hi:  # the previous lane already reaches the end of the series
            return rows_in.slice(0, 0).select([*keys, seq, LENGTH, *columns])
        position = rows_in.column(seq).to_numpy()
        order = np.argsort(position)
        base = int(position[order[0]])
        y = np.column_stack([rows_in.column(c).to_numpy()[order] for c in columns])
        second = _spline_second(y, base == 0, base + len(y) == n)
        k_lo = -(-own_lo * steps // (n - 1))
        k_hi = factor * n if own_hi == n - 1 else -(-own_hi * steps // (n - 1))
        k = np.arange(k_lo, k_hi, dtype=np.int64)
        cell = np.minimum(k * (n - 1) // steps, n - 2)
        t = ((k * (n - 1) - cell * steps) / steps)[:, None]
        i = cell - base
        a = 1.0 - t
        value = a * y[i] + t * y[i + 1] + ((a**3 - a) * second[i] + (t**3 - t) * second[i + 1]) / 6.0
        made = {key: pa.repeat(rows_in.column(key)[0], len(k)) for key in keys}
        made |= {seq: pa.array(k), LENGTH: pa.array(np.full(len(k), factor * n, dtype=np.int64))}
        return pa.table({**made, **{c: pa.array(value[:, j]) for j, c in enumerate(columns)}})

    types = dict(df.dtypes)
    schema = ", ".join(
        [*[f"`{k}` {types[k]}" for k in keys], f"`{seq}` bigint", f"{LENGTH} bigint", *[f"`{c}` double" for c in columns]]
    )
    axes = [F.col(c).cast("double").alias(c) for c in columns]
    ready = lanes.with_length(df).filter(F.col(LENGTH) >= 4).select(*keys, seq, LENGTH, *axes)
    return lanes.spread(ready, SPLINE_HALO, SPLINE_HALO).groupBy(*lanes.group).applyInArrow(one, schema)


def resample(
    df: DataFrame,
    axes: Sequence[str] = tuple(AXES),
    timestamps: Sequence[str] = ("timestamp_acc", "timestamp_gyro"),
    factor: int = 2,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Cubic axes and linear timestamps on the same positions."""
    cubic = resample_cubic(df, axes, factor, lanes)
    if not timestamps:
        return cubic
    linear = resample_linear(df, timestamps, factor, lanes)
    # Both sides on (series, lane) keys would be equal work: positions are unique, so join on them.
    return cubic.join(linear.drop(LENGTH), [*lanes.keys, lanes.seq])


def variants(
    df: DataFrame,
    axes: Sequence[str] = tuple(AXES),
    timestamps: Sequence[str] = ("timestamp_acc", "timestamp_gyro"),
    seed: int = 42,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """The four variants, each from the original, told apart by ``variant``."""
    base = lanes.with_length(df).select(*lanes.keys, lanes.seq, LENGTH, *timestamps, *axes)
    base = base.withColumns({c: F.col(c).cast("double") for c in timestamps})
    half = len(axes) // 2
    pairs = [(axes[0], axes[1]), (axes[half], axes[half + 1])]
    made = {
        "noisy": add_noise(base, axes, seed=seed, lanes=lanes),
        "jittered": jitter(base, axes, seed=seed + 1, lanes=lanes),
        "rotated": rotate(base, pairs),
        "interpolated": resample(base, axes, timestamps, lanes=lanes),
    }
    tagged = [d.withColumn("variant", F.lit(name)) for name, d in made.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
