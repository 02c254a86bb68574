"""Peak finding: strict local maxima with plateaus, height, distance and prominence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelane.functions.signal import half_even, middle
from kinelane.operators.lanes import LANE, LANE_ROWS, Lanes
from kinelane.schema import LENGTH
from kinelane.session import ensure_checkpoints


#: Samples scanned together for prominences; a group of numbers, not of windows.
PROMINENCE_ROWS = 1 << 15


def local_maxima(df: DataFrame, column: str, height: float | None = None, lanes: Lanes = Lanes()) -> DataFrame:
    """Samples (or flat tops) higher than both neighbours: ``seq`` = middle, ``left`` and ``right`` ends.

    Series ends are never peaks. A flat top may be longer than a lane: its two ends are then matched
    from the lanes' open and closing ends only.
    """
    x, pos, w = F.col(column), F.col(lanes.seq), lanes.window
    prev, nxt = F.col("_prev"), F.col("_next")

    def edges(d: DataFrame) -> DataFrame:
        return d.withColumns({"_prev": F.lag(x).over(w), "_next": F.lead(x).over(w)})

    spread = edges(lanes.spread(df.select(*lanes.keys, lanes.seq, column), 1, 1))
    rising = F.coalesce(prev < x, F.lit(False))
    opens = lanes.owned() & (F.isnull(prev) | (prev != x)) & (nxt == x)
    spread = spread.withColumn(
        "_open",
        F.last(F.when(opens, F.struct(pos.alias("at"), rising.alias("up"))), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    last_owned = (pos + 1) % F.lit(lanes.rows) == 0
    single = (prev < x) & (x > nxt)
    closing = (prev == x) & (x > nxt)
    kind = (
        F.when(single | (closing & F.col("_open.up")), "peak")
        .when(closing & F.col("_open").isNull(), "close")
        .when(last_owned & (nxt == x) & F.col("_open").isNotNull(), "open")
    )
    marks = lanes.keep(spread.withColumn("_kind", kind).filter("_kind is not null").select(
        *lanes.keys, lanes.seq, column, LANE, "_kind", "_open",
        F.when((F.col("_kind") == "peak") & single, pos).otherwise(F.col("_open.at")).alias("left"),
    ))
    # Finished peaks stay in groups of one lane; only marks of flat tops that cross lanes meet per series.
    scope = F.when(F.col("_kind") == "peak", lanes.lane_of()).otherwise(F.lit(-1))
    across = (
        Window.partitionBy(*lanes.keys, "_scope")
        .orderBy(lanes.seq)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = F.last(F.when(F.col("_kind") == "open", F.col("_open")), ignorenulls=True).over(across)
    found = (
        marks.withColumn("_scope", scope)
        .withColumn("_far", F.when(F.col("_kind") == "close", carried))
        .filter((F.col("_kind") == "peak") | F.col("_far.up"))
        .withColumn("left", F.coalesce(F.col("left"), F.col("_far.at")))
        .withColumn("right", pos)
        .withColumn(lanes.seq, F.floor((F.col("left") + F.col("right")) / F.lit(2)).cast("long"))
    )
    if height is not None:
        found = found.filter(x >= height)
    return found.select(*lanes.keys, lanes.seq, column, "left", "right")


def _greedy(at: np.ndarray, x: np.ndarray, state: np.ndarray, distance: int) -> np.ndarray:
    """Highest first: 0 open, 1 kept, 2 dropped, 3 unknown. What hangs on an unknown peak is unknown too."""
    first = np.searchsorted(at, at - distance, side="right")
    last = np.searchsorted(at, at + distance, side="left")
    settled = state == 1
    for i in np.flatnonzero(settled):
        around = state[first[i] : last[i]]
        around[around != 1] = 2
    for i in np.lexsort((at, x))[::-1]:
        if settled[i] or state[i] == 2:
            continue
        around = state[first[i] : last[i]]
        if state[i] == 3:
            around[around == 0] = 3
        else:
            around[around != 1] = 2
            state[i] = 1
    return state


def _sorted_zone(zone: pa.Table, seq: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    zone = zone.take(pa.array(np.argsort(zone.column(seq).to_numpy())))
    return zone, zone.column(seq).to_numpy(), zone.column("_x").to_numpy(), zone.column("_state").to_numpy().copy()


def _decide(keys: list[str], seq: str, distance: int, rows: int, halo: int):
    """Greedy choice on one lane and its halo, leaving open what depends on peaks beyond the halo."""

    def decide(zone: pa.Table) -> pa.Table:
        zone, at, x, state = _sorted_zone(zone, seq)
        lane = zone.column(LANE)[0].as_py()
        low, high = lane * rows - halo, (lane + 1) * rows - 1 + halo
        near_edge = ((at - distance + 1 < low) & (low > 0)) | (at + distance - 1 > high)
        state[near_edge & (state == 0)] = 3
        state = _greedy(at, x, state, distance)
        own = pa.array((at >= lane * rows) & (at < (lane + 1) * rows) & (state != 2))
        kept = zone.select([*keys, seq, "_x"]).append_column("_state", pa.array((state == 1).astype("int32")))
        return kept.filter(own)

    return decide


#: In place of a position: no open peak of the zone is kept; the zone is unknown.
NONE, UNKNOWN = -1, -2


def _border_maps(keys: list[str], seq: str, distance: int, rows: int):
    """What each outcome of the neighbour's border zone makes of the lane's own zone on the other side.

    A border zone is the ``distance`` positions of a lane next to a border; at most one of its peaks is kept. For side 1
    the input is the first zone of the next lane and the output the lane's own first zone; for side -1 it is mirrored.
    """

    def maps(zone: pa.Table) -> pa.Table:
        zone, at, x, state = _sorted_zone(zone, seq)
        lane = zone.column(LANE)[0].as_py()
        low, high = lane * rows, (lane + 1) * rows
        left, right = at < low, at >= high
        was_open = state == 0
        found: list[tuple[int, int | None, int | None, int]] = []
        for side, given, other, zone_out in (
            (1, right, left, (at >= low) & (at < low + distance)),
            (-1, left, right, (at >= high - distance) & (at < high)),
        ):
            if not (was_open & zone_out).any():
                continue

            def outcome(hyp: int, given=given, other=other, zone_out=zone_out) -> int:
                now = state.copy()
                now[other & was_open] = 3
                now[given & was_open] = 3 if hyp == UNKNOWN else 2
                if hyp >= 0:
                    now[given & was_open & (at == hyp)] = 1
                now = _greedy(at, x, now, distance)
                if (now[zone_out & was_open] == 3).any():
                    return UNKNOWN
                kept = at[zone_out & was_open & (now == 1)]
                return int(kept[0]) if len(kept) else NONE

            alone = outcome(UNKNOWN)
            ask = at[given & was_open].tolist()
            if alone != UNKNOWN or not ask:
                found.append((side, None, None, alone))
                continue
            found.append((side, lane + side, UNKNOWN, UNKNOWN))
            found += [(side, lane + side, hyp, outcome(hyp)) for hyp in [NONE, *ask]]
        columns = [pa.array([row[i] for row in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        own = zone.select(keys).take(pa.array([0] * len(found), pa.int64()))
        for name, values in zip(("side", "to", "hyp", "out"), columns, strict=True):
            own = own.append_column(name, values)
        return own.append_column("lane", pa.array([lane] * len(found), pa.int64()))

    return maps


def _follow(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Border maps joined with those they point to until none points on: each step doubles the lanes they reach over."""
    lane = [*keys, "side", "lane"]
    whole = Window.partitionBy(*lane)
    told = F.when(F.col("hyp").isNull() | (F.col("hyp") != UNKNOWN), F.col("out"))
    while True:
        # One outcome whatever comes in: the lane points nowhere.
        agreed = F.min(told).over(whole)
        same = (agreed == F.max(told).over(whole)) & (agreed != UNKNOWN)
        maps = maps.withColumns({"_same": same | F.col("to").isNull(), "_agreed": F.coalesce(agreed, F.lit(UNKNOWN))})
        ended = maps.filter("_same").select(
            *lane, F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("hyp"), F.col("_agreed").alias("out")
        )
        maps = ended.distinct().unionByName(maps.filter("not _same").drop("_same", "_agreed")).checkpoint(eager=True)
        pointing = maps.filter("to is not null")
        if pointing.isEmpty():
            return maps
        ahead = maps.select(*keys, "side", F.col("lane").alias("to"), F.col("out").alias("hyp"), F.col("to").alias("_to"), F.col("hyp").alias("_hyp"))
        moved = pointing.join(ahead, [*keys, "side", "to", "hyp"]).select(
            *lane, F.col("_to").alias("to"), F.col("_hyp").alias("hyp"), "out"
        )
        maps = maps.filter("to is null").unionByName(moved)


def keep_distance(peaks: DataFrame, column: str, distance: int, lanes: Lanes = Lanes()) -> DataFrame:
    """Highest peaks first, dropping every other peak closer than ``distance`` (ties: the later one wins).

    A round decides the peaks whose higher neighbours are all known inside a lane and its halo. Peaks that hang on
    each other across lanes wait for the next round; lanes keep their size. Where a round leaves over half of the
    waiting peaks open (a rising series holds one chain of all its peaks), chains are contracted: what can pass a border
    is which peak of its zone is kept, so every lane with open peaks is reduced to a table from the outcome of one
    border zone to that of the other. The tables are joined along the chain in a logarithmic number of steps, and the
    outcomes they give settle the zones, which cuts the chain into lanes for the next round. Chains that rise to both
    sides through the same lanes leave zones unknown, which later rounds settle lane by lane.
    """
    if distance <= 1:
        return peaks
    ensure_checkpoints(peaks.sparkSession)
    keys, seq = list(lanes.keys), lanes.seq
    types = dict(peaks.dtypes)
    key_types = [f"`{k}` {types[k]}" for k in keys]
    schema = ", ".join([*key_types, f"`{seq}` bigint, _x double, _state int"])
    map_schema = ", ".join([*key_types, "side int, `to` bigint, hyp bigint, out bigint, lane bigint"])
    states = peaks.select(*keys, seq, F.col(column).cast("double").alias("_x"), F.lit(0).alias("_state"))
    rows, halo = max(lanes.rows, 2 * distance), 4 * distance
    zone = Lanes(keys=tuple(keys), seq=seq, rows=rows)
    waiting = None
    while True:
        states = (
            zone.spread(states, halo, halo)
            .groupBy(*zone.group)
            .applyInArrow(_decide(keys, seq, distance, rows, halo), schema)
            .checkpoint(eager=True)
        )
        before, waiting = waiting, states.filter("_state = 0").count()
        if not waiting:
            return states.select(*keys, seq, F.col("_x").alias(column))
        if before is None or waiting <= before // 2:
            continue  # most peaks hang on the next lane only
        near = zone.spread(states, distance, distance)
        active = near.filter("_state = 0").select(*zone.group).distinct()
        maps = near.join(active, zone.group, "left_semi").groupBy(*zone.group).applyInArrow(
            _border_maps(keys, seq, distance, rows), map_schema
        )
        known = _follow(maps, keys).filter(F.col("out") != UNKNOWN)
        outcomes = known.groupBy(*keys, F.col("lane").alias(LANE)).agg(
            F.max(F.when(F.col("side") == 1, F.col("out"))).alias("_first"),
            F.max(F.when(F.col("side") == -1, F.col("out"))).alias("_last"),
        )
        place = F.pmod(F.col(seq), F.lit(rows))
        outcome = F.when(place < distance, F.col("_first"))
        outcome = F.coalesce(outcome, F.when(place >= rows - distance, F.col("_last")))
        settled = F.when(F.col("_state") == 1, 1).when(outcome.isNull(), F.col("_state")).when(outcome == F.col(seq), 1).otherwise(2)
        states = (
            zone.tag(states)
            .join(outcomes, zone.group, "left")
            .withColumn("_state", settled.cast("int"))
            .filter("_state <> 2")
            .select(*keys, seq, "_x", "_state")
        )


def _tree(samples: DataFrame, column: str, lanes: Lanes, fan: int, depth: int) -> list[DataFrame]:
    """Nodes over the lanes of a series. Level 0 has a lane's samples as children, level k the nodes below.

    A child is ``(id, hi, lo)``; a node has at most ``max(lanes.rows, fan)`` of them.
    """
    keys = list(lanes.keys)
    tagged = lanes.tag(samples).withColumnRenamed(LANE, "node")
    child = F.struct(F.col(lanes.seq).alias("id"), F.col(column).alias("hi"), F.col(column).alias("lo"))
    levels = [tagged.groupBy(*keys, "node").agg(F.array_sort(F.collect_list(child)).alias("children"))]
    below = tagged.groupBy(*keys, "node").agg(F.max(column).alias("hi"), F.min(column).alias("lo"))
    for _ in range(depth):
        ids = below.withColumnRenamed("node", "id")
        grouped = ids.withColumn("node", F.floor(F.col("id") / F.lit(fan)).cast("long")).groupBy(*keys, "node")
        levels.append(grouped.agg(F.array_sort(F.collect_list(F.struct("id", "hi", "lo"))).alias("children")))
        below = grouped.agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return levels


def _visit(asked: DataFrame, nodes: DataFrame, level: int, fan: int, keys: list[str], down: bool) -> DataFrame:
    """Move the open questions of one level: to the nearest higher child on their side, or one level up.

    ``found`` is the level whose child ``at`` is known to hold a higher sample (NULL while climbing).
    """
    left = F.col("side") < 0
    if down:
        active, node = F.col("found") == level + 1, F.col("at")
    else:
        active, node = F.isnull("found"), F.floor(F.col("at") / F.lit(fan)).cast("long")
    active = F.coalesce(active, F.lit(False))
    # Idle rows get keys no node has, spread so that they do not meet in one partition.
    idle = F.lit(-1) - F.pmod(F.col("peak"), F.lit(4096))
    rows = asked.withColumn("_active", active).withColumn("node", F.when(active, node).otherwise(idle))
    rows = rows.join(nodes, [*keys, "node"], "left")
    v, at = F.col("v"), F.col("at")
    nothing = F.struct(F.lit(None).cast("bigint").alias("hit"), F.lit(None).cast("double").alias("low"))

    def step(seen: Column, c: Column) -> Column:
        """One pass over the children: the nearest higher one so far and the lowest value since."""
        passed = F.struct(seen["hit"].alias("hit"), F.least(seen["low"], c["lo"]).alias("low"))
        stop = F.struct(c["id"].alias("hit"), F.lit(None).cast("double").alias("low"))
        onward = F.struct(c["id"].alias("hit"), seen["low"].alias("low"))
        to_left = F.when(c["hi"] > v, stop).otherwise(passed)
        to_right = F.when(seen["hit"].isNotNull(), seen).when(c["hi"] > v, onward).otherwise(passed)
        moved = F.when(left, to_left).otherwise(to_right)
        if down:
            return moved
        beside = F.when(left, c["id"] < at).otherwise(c["id"] > at)
        return F.when(beside, moved).otherwise(seen)

    rows = rows.withColumn("_walk", F.aggregate("children", nothing, step))
    hit, moved = F.col("_walk.hit"), F.col("_active")
    return rows.select(
        *keys,
        "peak",
        "v",
        "side",
        F.when(moved, F.coalesce(hit, F.col("node"))).otherwise(at).alias("at"),
        F.when(moved, F.least("lowest", F.col("_walk.low"))).otherwise(F.col("lowest")).alias("lowest"),
        F.when(moved & hit.isNotNull(), F.lit(level)).otherwise(F.col("found")).alias("found"),
    )


def _lowest_before(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position ``at``: the lowest value back to the nearest strictly higher sample, and whether there is one.

    Tables of the greatest and least of every 2**k samples; all positions walk back together, by the longest stretches
    that hold nothing higher first.
    """
    tops, lows = [x], [x]
    while 2 << (len(tops) - 1) <= len(x):
        step = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-step], tops[-1][step:]))
        lows.append(np.minimum(lows[-1][:-step], lows[-1][step:]))
    here, lowest = at.copy(), x[at]
    for k in range(len(tops) - 1, -1, -1):
        start = here - (1 << k)
        free = np.flatnonzero(start >= 0)
        free = free[tops[k][start[free]] <= x[at[free]]]
        lowest[free] = np.minimum(lowest[free], lows[k][start[free]])
        here[free] = start[free]
    return lowest, here > 0


def prominences(
    df: DataFrame,
    peaks: DataFrame,
    column: str,
    minimum: float | None = None,
    lanes: Lanes = Lanes(rows=PROMINENCE_ROWS),
    fan: int = 256,
    depth: int | None = None,
) -> DataFrame:
    """``prominence`` of each peak: its height over the higher of the two lowest points that lie between
    it and the nearest higher sample (or the end of the series) on either side.

    A scan inside each lane answers nearly all sides. What is open climbs a tree of lane extremes until a
    node has a higher child on that side, then goes down into it: every step is an equi-join of the open
    questions with nodes of at most ``fan`` children, so neither the length of a series nor the distance
    to the higher sample matters. ``depth`` levels cover ``lanes.rows * fan**depth`` samples; by default
    it follows the longest series.
    """
    keys, seq = list(lanes.keys), lanes.seq
    if depth is None:
        longest = df.agg(F.max(seq)).first()[0] or 0
        depth, span = 0, lanes.rows
        while span <= longest:
            depth, span = depth + 1, span * fan
    samples = df.select(*keys, seq, F.col(column).cast("double").alias(column))
    types = dict(samples.dtypes)
    schema = ", ".join(
        [*[f"`{k}` {types[k]}" for k in keys], "peak bigint, v double, side int, at bigint, lowest double, found int"]
    )

    def ask(rows: pa.Table, tops: pa.Table) -> pa.Table:
        at = tops.column(seq).to_numpy()
        position = rows.column(seq).to_numpy()
        x = rows.column(column).to_numpy()[np.argsort(position)] if len(at) else np.empty(0)
        i = at - position.min() if len(at) else at
        back, forth = _lowest_before(x, i), _lowest_before(x[::-1], len(x) - 1 - i)
        both = pa.concat_tables([tops, tops])
        made = {k: both.column(k) for k in keys}
        made["peak"] = both.column(seq)
        made["v"] = pa.array(np.concatenate([x[i], x[i]]))
        made["side"] = pa.array(np.repeat(np.array([-1, 1], dtype="int32"), len(i)))
        made["at"] = both.column(LANE)
        made["lowest"] = pa.array(np.concatenate([back[0], forth[0]]))
        made["found"] = pa.array(np.where(np.concatenate([back[1], forth[1]]), 0, -1).astype("int32"))
        return pa.table(made)

    # New aliases keep the two inputs apart when the peaks come from the same rows.
    tops = lanes.tag(peaks.select(*keys, seq)).select(*[F.col(c).alias(c) for c in [*lanes.group, seq]])
    asked = (
        lanes.tag(samples).groupBy(*lanes.group).cogroup(tops.groupBy(*lanes.group)).applyInArrow(ask, schema)
    ).withColumn("found", F.nullif("found", F.lit(-1)))
    if depth > 0:
        # Written down, so that the few open questions can go on alone without a second scan.
        ensure_checkpoints(df.sparkSession)
        asked = asked.checkpoint(eager=True)
        answered, asked = asked.filter(F.col("found") == 0), asked.filter(F.isnull("found"))
        tree = _tree(samples, column, lanes, fan, depth)
        for level in range(1, depth + 1):
            asked = _visit(asked, tree[level], level, fan, keys, down=False)
        for level in range(depth - 1, -1, -1):
            asked = _visit(asked, tree[level], level, fan, keys, down=True)
        asked = answered.unionByName(asked)
    out = asked.groupBy(*keys, F.col("peak").alias(seq)).agg(
        F.any_value("v").alias(column), (F.any_value("v") - F.max("lowest")).alias("prominence")
    )
    return out if minimum is None else out.filter(F.col("prominence") >= minimum)


def find_peaks(
    df: DataFrame,
    column: str,
    height: float | None = None,
    distance: int | None = None,
    prominence: float | None = None,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Peaks that pass the given conditions, applied in this order.

    Prominence reads the samples several times (scan and tree), so they are written down once first.
    """
    if prominence is not None:
        ensure_checkpoints(df.sparkSession)
        df = df.select(*lanes.keys, lanes.seq, column).checkpoint(eager=True)
    found = local_maxima(df, column, height, lanes)
    if distance is not None:
        found = keep_distance(found, column, distance, lanes)
    if prominence is not None:
        found = prominences(df, found, column, prominence, Lanes(lanes.keys, lanes.seq, PROMINENCE_ROWS if lanes.rows == LANE_ROWS else lanes.rows))
    return found


def windowed_peaks(
    df: DataFrame, column: str, width: int, height: float | None = None, lanes: Lanes = Lanes()
) -> DataFrame:
    """Peaks of every window ``[i, i+width)``, repeats kept: one row per (window start, peak).

    A flat top counts in the windows that hold all of it and a sample on each side.
    """
    found = lanes.attach(
        local_maxima(df, column, height, lanes), lanes.with_length(df).groupBy(*lanes.keys).agg(F.max(LENGTH).alias(LENGTH))
    )
    first = F.greatest(F.col("right") - F.lit(width - 2), F.lit(0))
    last = F.least(F.col("left") - F.lit(1), F.col(LENGTH) - F.lit(width))
    return found.filter(first <= last).select(
        *lanes.keys, F.explode(F.sequence(first, last)).alias("start"), lanes.seq, column
    )


def count_peaks(df: DataFrame, peaks: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Peaks per series, 0 for series without any."""
    series = df.groupBy(*keys).agg(F.lit(0).cast("long").alias("_none"))
    counts = peaks.groupBy(*keys).agg(F.count("*").alias("_some"))
    return series.join(counts, list(keys), "left").select(
        *keys, F.coalesce("_some", "_none").alias("peaks")
    )


def melt_axes(df: DataFrame, columns: Sequence[str], keys: Sequence[str], seq: str) -> DataFrame:
    """One row per (sample, axis), so that axes are series of their own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keys, seq, LENGTH, F.inline(pairs))


def consensus_repetitions(
    df: DataFrame,
    columns: Sequence[str],
    width: int = 100,
    prominence: float = 0.4,
    lanes: Lanes = Lanes(),
) -> DataFrame:
    """Repetitions per series: median over the axes of their prominent peaks after smoothing and scaling."""
    from kinelane.operators.savgol import SMOOTH_LANES, savgol
    from kinelane.operators.scaling import minmax_series

    smooth_lanes = Lanes(lanes.keys, lanes.seq, min(lanes.rows, SMOOTH_LANES.rows))
    smoothed = savgol(df, columns, width, suffix="", lanes=smooth_lanes)
    axes = melt_axes(smoothed, columns, lanes.keys, lanes.seq)
    axis_lanes = Lanes((*lanes.keys, "axis"), lanes.seq, lanes.rows)
    scaled = minmax_series(axes, ["x"], suffix="", lanes=axis_lanes)
    found = find_peaks(scaled, "x", prominence=prominence, lanes=axis_lanes)
    names = {c: f"peaks_{c}" for c in columns}
    # Every series that was smoothed is listed, also with no peak on any axis.
    none = smoothed.groupBy(*lanes.keys).agg(*[F.lit(0).cast("long").alias(f"_{n}") for n in names.values()])
    counts = found.groupBy(*lanes.keys).agg(
        *[F.count(F.when(F.col("axis") == c, 1)).alias(n) for c, n in names.items()]
    )
    out = none.join(counts, list(lanes.keys), "left").select(
        *lanes.keys, *[F.coalesce(n, f"_{n}").alias(n) for n in names.values()]
    )
    return out.withColumn("repetitions", half_even(middle([F.col(n) for n in names.values()])))
