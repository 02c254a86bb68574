"""Numeric column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magnitude(x: str | Column, y: str | Column, z: str | Column) -> Column:
    x, y, z = _col(x), _col(y), _col(z)
    return F.sqrt(x * x + y * y + z * z)


def rotate_xy(x: str | Column, y: str | Column, degrees: float = 10.0) -> tuple[Column, Column]:
    """Rotation in the x-y plane; both results use the original values."""
    x, y = _col(x), _col(y)
    cos, sin = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return cos * x - sin * y, sin * x + cos * y


def threshold(p: str | Column, cut: float = 0.5, inclusive: bool = False) -> Column:
    p = _col(p)
    return ((p >= cut) if inclusive else (p > cut)).cast("int")


def half_even(x: str | Column) -> Column:
    return F.bround(_col(x), 0).cast("int")


def middle(values: list[Column]) -> Column:
    """Median of a fixed number of columns in one row."""
    ordered = F.array_sort(F.array(*[v.cast("double") for v in values]))
    k = len(values)
    if k % 2:
        return F.element_at(ordered, k // 2 + 1)
    return (F.element_at(ordered, k // 2) + F.element_at(ordered, k // 2 + 1)) / F.lit(2.0)


def uniform_pair(identity: Column, stream: int) -> tuple[Column, Column]:
    """Two numbers in (0, 1) that depend only on ``identity`` and ``stream``."""
    digest = F.md5(F.concat_ws(":", identity, F.lit(str(stream))))

    def part(start: int) -> Column:
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("double")
        return (word + F.lit(0.5)) / F.lit(float(2**32))

    return part(1), part(9)


def normals(identity: Column, count: int) -> list[Column]:
    """``count`` standard normal draws per row (Box-Muller), stable under any partitioning."""
    out: list[Column] = []
    for stream in range((count + 1) // 2):
        u, v = uniform_pair(identity, stream)
        radius = F.sqrt(F.lit(-2.0) * F.log(u))
        angle = F.lit(2.0 * math.pi) * v
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out[:count]
