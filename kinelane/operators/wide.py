"""Power sums of centred frames at a cost that does not grow with their width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelane.operators.lanes import Lanes
from kinelane.schema import LENGTH

#: Up to this width a frame is summed as it is: cheaper, as measured, than running sums in two orders.
NARROW = 160


def _whole(a: Column, b: Column) -> Column:
    """Sum of two parts of a frame; NULL where both hold no value."""
    zero = F.lit(0)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero))


def frame_sums(
    d: DataFrame, columns: Sequence[str], before: int, after: int, powers: int, lanes: Lanes, narrow: int = NARROW
) -> DataFrame:
    """Add ``_{c}_m0`` .. ``_m{powers}``: sums of ``x * k**p`` with ``k`` counted from the centre of each frame.

    ``d`` is spread over lanes with a halo of at least the frame. Frames are cut at the ends of a series, which only
    power 0 allows; other powers hold for whole frames. Sums skip NULL, and a frame of NULLs has none.

    A wide frame is the tail of one block of its own width and the head of the next. Both are running sums with ``k``
    counted from the block's centre; the binomial law shifts them to the centre of the frame. A value reaches
    the frames that hold it and no others, so nothing cancels.
    """
    width = before + after + 1
    pos = F.col(lanes.seq)
    if width <= narrow:
        return _direct(d, columns, before, after, powers, lanes)
    block, k = F.floor(pos / F.lit(width)).cast("long"), "_k"
    inner = Window.partitionBy(*lanes.group, "_block")
    upto = (Window.unboundedPreceding, 0)
    head, tail = inner.orderBy(lanes.seq).rowsBetween(*upto), inner.orderBy(F.col(lanes.seq).desc()).rowsBetween(*upto)
    along = Window.partitionBy(*lanes.group).orderBy("_block", lanes.seq)
    # Dealt by lane once: the windows by block and the one along the lane need no other shuffle.
    d = d.repartition(*[F.col(c) for c in lanes.group]).withColumn("_block", block)
    d = d.withColumn(k, (pos - F.col("_block") * F.lit(width)).cast("double") - F.lit((width - 1) / 2.0))

    def term(c: str, p: int) -> Column:
        x = F.col(c)
        for _ in range(p):
            x = x * F.col(k)
        return x

    names = [(c, p) for c in columns for p in range(powers + 1)]
    d = d.withColumns({f"_{c}_t{p}": F.sum(term(c, p)).over(tail) for c, p in names})
    d = d.withColumns({f"_{c}_h{p}": F.sum(term(c, p)).over(head) for c, p in names})
    start, end = pos - F.lit(before), F.least(pos + F.lit(after), F.col(LENGTH) - 1)
    ends = {f"_{c}_a{p}": F.lag(f"_{c}_t{p}", before).over(along) for c, p in names}
    ends |= {f"_{c}_z{p}": F.lead(f"_{c}_h{p}", after).over(along) for c, p in names}
    if powers == 0:
        everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends |= {f"_{c}_l0": F.last(f"_{c}_h0").over(everything) for c in columns}
    d = d.withColumns(ends)
    first, last = F.floor(start / F.lit(width)).cast("long"), F.floor(end / F.lit(width)).cast("long")
    head_only, tail_only = (start < 0) | (start % F.lit(width) == 0), first == last
    made: dict[str, Column] = {}
    for c in columns:
        a = [F.col(f"_{c}_a{p}") for p in range(powers + 1)]
        z = [F.col(f"_{c}_z{p}") for p in range(powers + 1)]
        if powers == 0:
            z[0] = F.when(pos + F.lit(after) < F.col(LENGTH), z[0]).otherwise(F.col(f"_{c}_l0"))
        a = _shifted(a, (first * F.lit(width) - start).cast("double"))
        z = _shifted(z, (last * F.lit(width) - start).cast("double"))
        for p in range(powers + 1):
            made[f"_{c}_m{p}"] = F.when(head_only, z[p]).when(tail_only, a[p]).otherwise(_whole(a[p], z[p]))
    return d.withColumns(made).drop(k, "_block", *[f"_{c}_{part}{p}" for c, p in names for part in "thazl"])


def _shifted(sums: list[Column], by: Column) -> list[Column]:
    """Sums of ``x * (k + by)**p`` from those of ``x * k**p``, up to power 2."""
    out = sums[:1]
    if len(sums) > 1:
        out.append(sums[1] + by * sums[0])
    if len(sums) > 2:
        out.append(sums[2] + F.lit(2.0) * by * sums[1] + by * by * sums[0])
    return out


def _direct(d: DataFrame, columns: Sequence[str], before: int, after: int, powers: int, lanes: Lanes) -> DataFrame:
    frame = lanes.frame(before, after)
    middle = F.col(lanes.group[-1]) * F.lit(lanes.rows) + F.lit(lanes.rows // 2)
    d = d.withColumn("_k", (F.col(lanes.seq) - middle).cast("double"))
    made: dict[str, Column] = {}
    for c in columns:
        sums, term = [], F.col(c)
        for _ in range(powers + 1):
            sums.append(F.sum(term).over(frame))
            term = term * F.col("_k")
        for p, m in enumerate(_shifted(sums, -(F.col("_k") + F.lit((after - before) / 2.0)))):
            made[f"_{c}_m{p}"] = m
    return d.withColumns(made).drop("_k")
