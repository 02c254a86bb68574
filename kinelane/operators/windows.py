"""Sliding windows, tumbling segments and sequence/target pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelane.functions.signal import magnitude
from kinelane.operators.lanes import LANE, Lanes
from kinelane.schema import AXES, LENGTH

START = "start"
WINDOW = "window_id"


def sliding_windows(
    df: DataFrame,
    columns: Sequence[str],
    width: int,
    step: int,
    target: str | None = None,
    horizon: int = 0,
    reach: int | None = None,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Full windows at starts 0, step, 2*step, ... as ``features ARRAY<ARRAY<DOUBLE>>``.

    With ``target`` the value of that column ``horizon`` rows after the start is added. ``reach`` is how
    many rows from the start must exist (default: the window and, if asked for, the target row).

    Each row travels once (plus the halo), not once per window that covers it: a lane becomes one array
    of at most ``lanes.rows + reach`` rows and windows are slices of it.
    """
    need = max(width, horizon + 1 if target else 0, reach or 0)
    value = F.array(*[F.col(c).cast("double") for c in columns])
    item = [F.col(lanes.seq).alias("s"), value.alias("v")]
    if target:
        item.append(F.col(target).alias("t"))
    packed = (
        lanes.spread(df, 0, need - 1)
        .groupBy(*lanes.group)
        .agg(F.array_sort(F.collect_list(F.struct(*item))).alias("_rows"))
    )
    base = F.col(LANE) * F.lit(lanes.rows)
    lo = F.ceil(base / F.lit(step)) * F.lit(step)
    hi = F.least(base + F.lit(lanes.rows - 1), base + F.size("_rows") - F.lit(need))
    starts = F.when(lo <= hi, F.sequence(lo, hi, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def cut(start: Column) -> Column:
        at = (start - base).cast("int")
        rows = F.slice(F.col("_rows"), at + 1, F.lit(width))
        parts = [start.alias(START), F.transform(rows, lambda r: r["v"]).alias("features")]
        if target:
            parts.append(F.element_at(F.col("_rows"), at + F.lit(horizon + 1))["t"].alias("target"))
        return F.struct(*parts)

    cut_rows = packed.select(*lanes.keys, F.explode(F.transform(starts, cut)).alias("w"))
    extra = [F.col("w.target")] if target else []
    return cut_rows.select(
        *lanes.keys,
        F.floor(F.col(f"w.{START}") / F.lit(step)).cast("long").alias(WINDOW),
        F.col(f"w.{START}"),
        F.col("w.features"),
        *extra,
    )


def forecast_windows(df: DataFrame, column: str, width: int = 20, lanes: Lanes = Lanes()) -> DataFrame:
    """``width`` past samples and the next one, for every position that has a next one."""
    return sliding_windows(df, [column], width, 1, target=column, horizon=width, lanes=lanes)


def sequence_targets(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    width: int = 30,
    trim_tail: bool = False,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Sequences ``[i, i+width)`` with the target at ``i+width``: n-width of them.

    ``trim_tail`` is the evaluation variant, where the last ``width`` rows are cut from the inputs
    first: n-2*width+1 of them.
    """
    reach = 2 * width if trim_tail else width + 1
    return sliding_windows(df, columns, width, 1, target=target, horizon=width, reach=reach, lanes=lanes)


def segment_rows(
    df: DataFrame, width: int = 100, keep_last: bool = False, lanes: Lanes = Lanes()
) -> DataFrame:
    """Tumbling segments ``0, width, ...`` below ``n - width``.

    The partial tail goes, and so does the last full segment when n is a multiple of ``width``;
    ``keep_last`` keeps that one.
    """
    rows = lanes.with_length(df)
    start = F.floor(F.col(lanes.seq) / F.lit(width)) * F.lit(width)
    bound = F.col(LENGTH) - F.lit(width)
    inside = (start <= bound) if keep_last else (start < bound)
    return rows.filter(inside).withColumn("segment", F.floor(F.col(lanes.seq) / F.lit(width)).cast("long"))


def segment_features(
    df: DataFrame,
    axes: Sequence[str] = tuple(AXES),
    magnitudes: bool = True,
    label: str | None = None,
    width: int = 100,
    keep_last: bool = False,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Mean and sample deviation of the axes and both magnitudes per segment, with the modal label."""
    rows = segment_rows(df, width, keep_last, lanes)
    names = list(axes)
    if magnitudes:
        half = len(names) // 2
        rows = rows.withColumns(
            {"acc_magnitude": magnitude(*names[:half]), "gyro_magnitude": magnitude(*names[half:])}
        )
        names += ["acc_magnitude", "gyro_magnitude"]
    made = [f(c).alias(f"{c}_{s}") for c in names for s, f in (("mean", F.avg), ("std", F.stddev_samp))]
    if label:
        made.append(F.mode(label, True).alias("label"))
    return rows.groupBy(*lanes.keys, "segment").agg(*made)


def chronological_split(
    df: DataFrame,
    first: float = 3 / 5,
    second: float = 1 / 5,
    names: Sequence[str] = ("train", "valid", "test"),
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Part of each row by its position, sizes cut to whole numbers."""
    rows = lanes.with_length(df)
    a = F.floor(F.lit(first) * F.col(LENGTH))
    b = F.floor(F.lit(second) * F.col(LENGTH))
    pos = F.col(lanes.seq)
    return rows.withColumn(
        "part", F.when(pos < a, names[0]).when(pos < a + b, names[1]).otherwise(names[2])
    )


def drop_last(df: DataFrame, count: int = 2, lanes: Lanes = Lanes()) -> DataFrame:
    """Leave out the last ``count`` rows of each series; ``n`` follows."""
    rows = lanes.with_length(df).filter(F.col(lanes.seq) < F.col(LENGTH) - F.lit(count))
    return rows.withColumn(LENGTH, F.col(LENGTH) - F.lit(count))


def shift_ahead(
    df: DataFrame, column: str, by: int, target: str = "true_label", lanes: Lanes = Lanes()
) -> DataFrame:
    """Value of ``column`` ``by`` rows later, on rows that have one."""
    out = lanes.run(
        df, 0, by, lambda d: d.withColumns({target: F.lead(column, by).over(lanes.window)})
    )
    return lanes.with_length(out).filter(F.col(lanes.seq) + F.lit(by) < F.col(LENGTH))


def concatenate(
    df: DataFrame, keys: Sequence[str] = ("series_id",), into: str = "all", buckets_hex: int = 3
) -> DataFrame:
    """All series end to end as one: ``global_seq`` = rows of earlier series + ``seq``.

    A directory listing has no fixed order, so series follow each other by the MD5 of their key: its
    first digits are even buckets, ranked by a two-level sum instead of one global sort.
    """
    lanes = Lanes(keys=tuple(keys))
    rows = lanes.with_length(df)
    name = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    sizes = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias(LENGTH))
        .withColumn("_h", F.md5(name))
        .withColumn("_b", F.substring("_h", 1, buckets_hex))
    )
    totals = sizes.groupBy("_b").agg(F.sum(LENGTH).alias("_t"))
    # At most 16**buckets_hex rows, whatever the number of series.
    over_buckets = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_b",
        F.coalesce(F.sum("_t").over(over_buckets), F.lit(0)).alias("_before"),
        F.sum("_t").over(Window.partitionBy(F.lit(1))).alias("_all"),
    )
    inside = Window.partitionBy("_b").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(F.broadcast(offsets), "_b").select(
        *keys,
        LENGTH,
        (F.col("_before") + F.coalesce(F.sum(LENGTH).over(inside), F.lit(0))).alias("_offset"),
        F.col("_all").alias("total"),
    )
    return (
        lanes.attach(rows, placed)
        .withColumn("global_seq", F.col("_offset") + F.col(lanes.seq))
        .withColumn("dataset", F.lit(into))
        .drop("_offset")
    )


def union_labelled(sets: dict[int, DataFrame], label: str = "label") -> DataFrame:
    """Window sets of several classes as one, every set's rows with its class. Columns are matched by name."""
    tagged = [df.withColumn(label, F.lit(value)) for value, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
