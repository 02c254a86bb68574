"""Smoothing, rolling statistics, differences and running sums over lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinelane.functions.signal import magnitude
from kinelane.operators.lanes import LANE, Lanes, join_small, running_before
from kinelane.operators.wide import frame_sums
from kinelane.schema import ACC, AXES, GYRO, LENGTH
from kinelane.session import ensure_checkpoints

TIME_STEP = 0.01  # fixed value: nominal 100 Hz


def moving_average(
    df: DataFrame, columns: Sequence[str], width: int, suffix: str = "_smooth", lanes: Lanes = Lanes()
) -> DataFrame:
    """Centred mean with zero-padded edges: the divisor is always ``width``.

    Series shorter than ``width`` have no result of their own length and are left out.
    """
    before, after = width // 2, (width - 1) // 2

    def make(d: DataFrame) -> DataFrame:
        d = frame_sums(d, columns, before, after, 0, lanes)
        means = {f"{c}{suffix}": F.col(f"_{c}_m0") / F.lit(float(width)) for c in columns}
        return d.withColumns(means).drop(*[f"_{c}_m0" for c in columns])

    return lanes.run(lanes.with_length(df).filter(F.col(LENGTH) >= width), before, after, make)


def _moments(x: Column, w: WindowSpec) -> dict[str, Column]:
    """Count, mean and central power sums of a running frame, from built-in aggregates."""
    n, square = F.count(x).over(w), F.var_pop(x).over(w) * F.count(x).over(w)
    cube = F.skewness(x).over(w) * square * F.sqrt(square) / F.sqrt(n)
    fourth = (F.kurtosis(x).over(w) + F.lit(3.0)) * square * square / n
    zero = F.lit(0.0)
    return {
        "n": n,
        "mean": F.coalesce(F.avg(x).over(w), zero),
        "m2": F.coalesce(square, zero),
        "m3": F.coalesce(cube, zero),
        "m4": F.coalesce(fourth, zero),
    }


def _merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Moments of two disjoint sets of samples together."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    n = na + nb
    d = b["mean"] - a["mean"]
    safe = F.nullif(n, F.lit(0.0))
    m2 = a["m2"] + b["m2"] + d * d * na * nb / safe
    m3 = a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (safe * safe)
    m3 = m3 + F.lit(3.0) * d * (na * b["m2"] - nb * a["m2"]) / safe
    m4 = a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (safe * safe * safe)
    m4 = m4 + F.lit(6.0) * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (safe * safe)
    m4 = m4 + F.lit(4.0) * d * (na * b["m3"] - nb * a["m3"]) / safe
    return {"n": n, "mean": a["mean"] + d * nb / safe, "m2": m2, "m3": m3, "m4": m4}


def rolling(
    df: DataFrame,
    columns: Sequence[str],
    width: int,
    stats: Sequence[str] = ("ma", "std"),
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Trailing statistics over ``width`` samples, NULL until ``width`` samples are there.

    ``ma`` mean, ``std`` sample deviation, ``skew`` and ``kurt`` bias-corrected (a constant window
    gives 0 and -3).

    Cost does not grow with ``width``: positions are cut into blocks of ``width``, and a trailing window is
    the tail of one block plus the head of the next. Heads and tails are running aggregates; their
    moments are merged without the cancellation that differences of running sums would bring.
    """
    unknown = set(stats) - {"ma", "std", "skew", "kurt"}
    if unknown:
        raise ValueError(f"unknown rolling statistics {sorted(unknown)}")
    block = "_block"
    inner = Window.partitionBy(*lanes.group, block)
    upto = (Window.unboundedPreceding, 0)
    head = inner.orderBy(lanes.seq).rowsBetween(*upto)
    tail = inner.orderBy(F.col(lanes.seq).desc()).rowsBetween(*upto)
    along = Window.partitionBy(*lanes.group).orderBy(block, lanes.seq)
    offset = F.col(lanes.seq) % F.lit(width)
    parts = ["n", "mean", "m2"] + (["m3", "m4"] if {"skew", "kurt"} & set(stats) else [])
    w = float(width)

    def make(d: DataFrame) -> DataFrame:
        # Dealt by lane once: the windows by block and the one along the lane then need no other shuffle.
        d = d.repartition(*[F.col(c) for c in lanes.group])
        d = d.withColumn(block, F.floor(F.col(lanes.seq) / F.lit(width)).cast("long"))
        d = d.withColumns({f"_{c}_t_{p}": m for c in columns for p, m in _moments(F.col(c), tail).items() if p in parts})
        d = d.withColumns({f"_{c}_h_{p}": m for c in columns for p, m in _moments(F.col(c), head).items() if p in parts})
        # The tail that completes a head starts width - 1 rows earlier; a full head needs none.
        earlier: dict[str, Column] = {}
        for c in columns:
            for p in parts:
                before = F.lag(f"_{c}_t_{p}", width - 1).over(along)
                earlier[f"_{c}_e_{p}"] = F.when(offset < width - 1, before).otherwise(F.lit(0.0))
            changed = F.col(c) != F.lag(c).over(along)
            earlier[f"_{c}_change"] = F.when(changed | F.lag(c).over(along).isNull(), F.col(lanes.seq))
        d = d.withColumns(earlier)
        run = along.rowsBetween(*upto)
        d = d.withColumns({f"_{c}_since": F.max(f"_{c}_change").over(run) for c in columns})
        made: dict[str, Column] = {}
        for c in columns:
            a = {p: F.col(f"_{c}_e_{p}") if p in parts else F.lit(0.0) for p in ("n", "mean", "m2", "m3", "m4")}
            b = {p: F.col(f"_{c}_h_{p}") if p in parts else F.lit(0.0) for p in ("n", "mean", "m2", "m3", "m4")}
            m = _merged(a, b)
            flat = F.col(lanes.seq) - F.col(f"_{c}_since") >= F.lit(width - 1)
            m2 = F.nullif(m["m2"], F.lit(0.0))
            values = {
                "ma": F.when(flat, F.col(c)).otherwise(m["mean"]),
                "std": F.when(flat, F.lit(0.0)).otherwise(F.sqrt(m["m2"] / F.lit(w - 1.0))) if width > 1 else None,
            }
            if width > 2:
                scale = (w * (w - 1.0)) ** 0.5 / (w - 2.0) * w**0.5
                skew = F.lit(scale) * m["m3"] / (m2 * F.sqrt(m2))
                values["skew"] = F.when(flat, F.lit(0.0)).otherwise(F.coalesce(skew, F.lit(0.0)))
            if width > 3:
                outer = (w - 1.0) / ((w - 2.0) * (w - 3.0))
                kurt = F.lit(outer) * (F.lit((w + 1.0) * w) * m["m4"] / (m2 * m2) - F.lit(3.0 * (w - 1.0)))
                values["kurt"] = F.when(flat, F.lit(-3.0)).otherwise(F.coalesce(kurt, F.lit(-3.0)))
            for s in stats:
                value = values.get(s)
                full = F.when(m["n"] == w, value) if value is not None else F.lit(None)
                made[f"{c}_{s}"] = full.cast("double")
        return d.select("*", *[v.alias(k) for k, v in made.items()])

    kept = [*df.columns, *[f"{c}_{s}" for c in columns for s in stats]]
    # Whole blocks: a window reaches up to width - 1 rows back, and that row's tail runs to its block's end.
    return lanes.run(df, width - 1, 0, make).select(*kept)


def differences(
    df: DataFrame,
    velocity: Sequence[str] = (),
    acceleration: Sequence[str] = (),
    absolute: Sequence[str] = (),
    interval: str | None = None,
    step: float = TIME_STEP,
    timestamps: str | None = None,
    fill: bool = False,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """First and second differences per step, absolute differences and sample intervals.

    ``timestamps`` (epoch ms) replaces the fixed ``step`` by the measured interval in seconds.
    ``fill`` turns the missing leading values into 0.
    """
    w = lanes.window

    def make(d: DataFrame) -> DataFrame:
        made: dict[str, Column] = {}
        if timestamps is None:
            dt: Column = F.lit(step)
        else:
            dt = F.nullif(F.col(timestamps) - F.lag(timestamps).over(w), F.lit(0)) / F.lit(1000.0)
        for c in velocity:
            made[f"{c}_velocity"] = (F.col(c) - F.lag(c).over(w)) / dt
        for c in acceleration:
            second = F.col(c) - F.lit(2.0) * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
            made[f"{c}_acceleration"] = second / (dt * dt)
        for c in absolute:
            made[f"{c}_diff"] = F.abs(F.col(c) - F.lag(c).over(w))
        if fill:
            made = {k: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for k, v in made.items()}
        if interval is not None:
            made["delta_t"] = F.coalesce(F.col(interval) - F.lag(interval).over(w), F.lit(0))
        return d.withColumns(made)

    return lanes.run(df, 2 if acceleration else 1, 0, make)


def running_sum(df: DataFrame, columns: dict[str, str], lanes: Lanes = Lanes()) -> DataFrame:
    """Cumulative sums ``{source: target}``: inside each lane, plus the totals of earlier lanes."""
    tagged = lanes.tag(df)
    names = list(columns)
    totals = tagged.groupBy(*lanes.group).agg(*[F.sum(c).alias(c) for c in names])
    offsets = running_before(totals, lanes.keys, LANE, names)
    upto = lanes.window.rowsBetween(Window.unboundedPreceding, 0)
    # Summed first: the join then finds the rows partitioned and sorted by (series, lane).
    local = tagged.withColumns({f"_in_{c}": F.sum(c).over(upto) for c in names})
    return (
        local.join(offsets, lanes.group)
        .withColumns({columns[c]: F.col(f"_in_{c}") + F.col(f"{c}_before") for c in names})
        .drop(LANE, *[f"{c}_before" for c in names], *[f"_in_{c}" for c in names])
    )


def integrate(
    df: DataFrame, columns: dict[str, str], timestamp: str, lanes: Lanes = Lanes()
) -> DataFrame:
    """Velocity as the running sum of acceleration times the sample interval (first interval 0).

    One scan and one shuffle of the rows: interval and running sum are taken in the same pass over a lane and written
    down. Totals of lanes are its last rows, a handful, and the offsets they make come back by a join.
    """
    w = lanes.window
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    timed = lanes.spread(df, 1, 0).withColumn("delta_t", F.coalesce(F.col(timestamp) - F.lag(timestamp).over(w), F.lit(0)))
    sums = {f"_in_{c}": F.sum(F.when(lanes.owned(), F.col(c) * F.col("delta_t"))).over(upto) for c in columns}
    ensure_checkpoints(df.sparkSession)
    local = timed.withColumns(sums).filter(lanes.owned()).checkpoint(eager=True)
    totals = local.groupBy(*lanes.group).agg(*[F.max_by(f"_in_{c}", lanes.seq).alias(c) for c in columns])
    offsets = running_before(totals, lanes.keys, LANE, list(columns))
    return (
        join_small(local, offsets, lanes.group)
        .withColumns({target: F.col(f"_in_{c}") + F.col(f"{c}_before") for c, target in columns.items()})
        .drop(LANE, *[f"{c}_before" for c in columns], *[f"_in_{c}" for c in columns])
    )


def motion_features(
    df: DataFrame,
    width: int = 50,
    acc: Sequence[str] = tuple(ACC),
    gyro: Sequence[str] = tuple(GYRO),
    step: float = TIME_STEP,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """The eleven model inputs in one shuffle: smoothed axes, angular velocities, two magnitudes.

    The halo covers smoothing plus the difference, so both windows share partitioning and sort.
    """
    axes = [*acc, *gyro]
    before, after = width // 2, (width - 1) // 2
    frame = lanes.frame(before, after)

    def make(d: DataFrame) -> DataFrame:
        d = d.withColumns({f"{c}_smooth": F.sum(c).over(frame) / F.lit(float(width)) for c in axes})
        d = d.withColumns(
            {
                f"{c}_velocity": F.coalesce(
                    (F.col(f"{c}_smooth") - F.lag(f"{c}_smooth").over(lanes.window)) / F.lit(step), F.lit(0.0)
                )
                for c in gyro
            }
        )
        return d.withColumns(
            {
                "acc_magnitude": magnitude(*[f"{c}_smooth" for c in acc]),
                "gyro_magnitude": magnitude(*[f"{c}_smooth" for c in gyro]),
            }
        )

    ready = lanes.with_length(df).filter(F.col(LENGTH) >= width)
    return lanes.run(ready, before + 1, after, make)


FEATURES_6 = [f"{c}_smooth" for c in AXES]
FEATURES_11 = [*FEATURES_6, *[f"{c}_velocity" for c in GYRO], "acc_magnitude", "gyro_magnitude"]
