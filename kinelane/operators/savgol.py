"""Savitzky-Golay smoothing from three moment sums per frame.

A least-squares polynomial of degree 2 on equally spaced points depends on the samples only through
sum(x), sum(k*x) and sum(k*k*x). Sums of wide frames come from heads and tails of blocks, whatever the width, those of
narrow frames from plain window aggregates; the two edges use the sums of the first and last frame of the series. No
Python, one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelane.operators.lanes import Lanes
from kinelane.operators.wide import frame_sums
from kinelane.schema import LENGTH

SMOOTH_LANES = Lanes(rows=1024)


def _polynomial(m0: Column, m1: Column, m2: Column, width: int, at: Column | None) -> Column:
    """Value at offset ``at`` from the frame centre of the degree-2 fit with centred moments."""
    s0 = float(width)
    s2 = width * (width**2 - 1) / 12.0
    s4 = width * (width**2 - 1) * (3 * width**2 - 7) / 240.0
    det = s0 * s4 - s2 * s2
    b0 = F.lit(s4 / det) * m0 - F.lit(s2 / det) * m2
    if at is None:
        return b0
    b1 = m1 / F.lit(s2)
    b2 = F.lit(s0 / det) * m2 - F.lit(s2 / det) * m0
    return b0 + b1 * at + b2 * at * at


def savgol(
    df: DataFrame,
    columns: Sequence[str],
    width: int = 101,
    suffix: str = "_smooth",
    edges: bool = True,
    lanes: Lanes = SMOOTH_LANES,
) -> DataFrame:
    """Degree-2 Savitzky-Golay filter, edges evaluated on the first and last fitted frame.

    An even ``width`` covers ``i-width/2+1 .. i+width/2`` and is evaluated at the centre of that frame.
    Series shorter than ``width`` cannot be fitted and are left out (``edges=False`` also leaves out
    the rows next to the ends).
    """
    if width < 3:
        raise ValueError("width must be at least 3 for a degree-2 fit")
    before, after = (width - 1) // 2, width // 2
    half = width // 2
    pos, n = F.col(lanes.seq), F.col(LENGTH)
    mid = (width - 1) / 2.0

    def make(d: DataFrame) -> DataFrame:
        d = d.withColumns({f"_{c}_x": F.col(c).cast("double") for c in columns})
        d = frame_sums(d, [f"_{c}_x" for c in columns], before, after, 2, lanes)
        sums = {c: [F.col(f"__{c}_x_m{p}") for p in range(3)] for c in columns}
        if edges:
            # The first and the last whole frame of the series serve all rows beside them.
            every = F.struct(*[m.alias(f"{c}_m{p}") for c in columns for p, m in enumerate(sums[c])])
            d = d.withColumns(
                {
                    "_left": F.first(F.when(pos == before, every), ignorenulls=True).over(lanes.whole),
                    "_right": F.first(F.when(pos == n - 1 - after, every), ignorenulls=True).over(lanes.whole),
                }
            )
        made: dict[str, Column] = {}
        for c in columns:
            value = _polynomial(*sums[c], width, None)
            if edges:
                left, right = ([F.col(side).getField(f"{c}_m{p}") for p in range(3)] for side in ("_left", "_right"))
                value = (
                    F.when(pos >= n - half, _polynomial(*right, width, pos - (n - width) - F.lit(mid)))
                    .when(pos < half, _polynomial(*left, width, pos - F.lit(mid)))
                    .otherwise(value)
                )
            made[f"{c}{suffix}"] = value
        helpers = [f"__{c}_x_m{p}" for c in columns for p in range(3)] + [f"_{c}_x" for c in columns]
        return d.withColumns(made).drop("_left", "_right", *helpers)

    ready = lanes.with_length(df).filter(n >= width)
    out = lanes.run(ready, width - 1, width - 1, make)
    return out if edges else out.filter((pos >= half) & (pos < n - half))


def savgol_nearest(
    df: DataFrame,
    columns: Sequence[str],
    width: int = 220,
    suffix: str = "_smooth",
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Degree-1 filter with ``nearest`` edges: a moving mean whose missing samples repeat the end value."""
    before, after = (width - 1) // 2, width // 2
    pos, n = F.col(lanes.seq), F.col(LENGTH)
    whole = lanes.whole
    left = F.greatest(F.lit(before) - pos, F.lit(0))
    right = F.greatest(pos + F.lit(after) - (n - 1), F.lit(0))

    def make(d: DataFrame) -> DataFrame:
        d = frame_sums(d, columns, before, after, 0, lanes)
        made = {}
        for c in columns:
            x = F.col(c)
            first = F.coalesce(F.max(F.when(pos == 0, x)).over(whole), F.lit(0.0))
            last = F.coalesce(F.max(F.when(pos == n - 1, x)).over(whole), F.lit(0.0))
            made[f"{c}{suffix}"] = (F.col(f"_{c}_m0") + left * first + right * last) / F.lit(float(width))
        return d.withColumns(made).drop(*[f"_{c}_m0" for c in columns])

    return lanes.run(lanes.with_length(df), before, after, make)


def compare_filters(
    df: DataFrame, columns: Sequence[str], savgol_width: int = 101, mean_width: int = 50
) -> DataFrame:
    """Both filters side by side: ``*_savgol`` and ``*_moving_avg``."""
    from kinelane.operators.frames import moving_average

    smoothed = savgol(df, columns, savgol_width, suffix="_savgol")
    return moving_average(smoothed, columns, mean_width, suffix="_moving_avg", lanes=SMOOTH_LANES)
