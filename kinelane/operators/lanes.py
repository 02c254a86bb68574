"""Ordered series that are too long for one task.

Every recording has dense positions ``seq`` = 0..n-1 and its length ``n`` on each row. A *lane* is a
run of ``rows`` consecutive positions of one series. Operators with bounded reach copy the few rows
next to a lane border into the neighbour (the halo), work on ``(series, lane)`` groups and keep only
the rows a lane owns. So one series may hold any share of the data: no group ever exceeds a lane
plus its halo, and results equal those of one long window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinelane.schema import LENGTH, SEQ, SERIES
from kinelane.session import ensure_checkpoints

# Below 4,096 rows Spark's window operator keeps a group in plain memory, so lane + halo stays under.
LANE_ROWS = 3584
SLOT_ROWS = 1 << 20
LANE = "_lane"
# A table of at most this many rows of a few numbers (some 20 MB) may be broadcast.
BROADCAST_ROWS = 100_000


def settle(small: DataFrame) -> tuple[DataFrame, bool]:
    """Write an aggregate down and say whether it is small enough to broadcast.

    Spark cannot know the size of an aggregate before it runs, so it would shuffle the large side of a join
    even for a handful of groups. The aggregate is needed anyway; measuring it first avoids that shuffle.
    """
    ensure_checkpoints(small.sparkSession)
    fixed = small.checkpoint(eager=True)
    return fixed, fixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with an aggregate: by broadcast if its measured size allows, else by shuffle."""
    fixed, fits = settle(small)
    return rows.join(F.broadcast(fixed) if fits else fixed, list(keys), how)


@dataclass(frozen=True)
class Lanes:
    keys: tuple[str, ...] = (SERIES,)
    seq: str = SEQ
    rows: int = LANE_ROWS

    @property
    def group(self) -> list[str]:
        return [*self.keys, LANE]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.seq)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.group)

    def frame(self, before: int, after: int) -> WindowSpec:
        return self.window.rowsBetween(-before, after)

    def lane_of(self, position: Column | None = None) -> Column:
        position = F.col(self.seq) if position is None else position
        return F.floor(position / F.lit(self.rows)).cast("long")

    def tag(self, df: DataFrame) -> DataFrame:
        return df.withColumn(LANE, self.lane_of())

    def spread(self, df: DataFrame, before: int, after: int) -> DataFrame:
        """Copy each row into every lane that reaches it."""
        if before == 0 and after == 0:
            return self.tag(df)
        pos = F.col(self.seq)
        first = self.lane_of(F.greatest(pos - F.lit(after), F.lit(0)))
        last = self.lane_of(pos + F.lit(before))
        return df.withColumn(LANE, F.explode(F.sequence(first, last)))

    def owned(self) -> Column:
        return F.col(LANE) == self.lane_of()

    def keep(self, df: DataFrame) -> DataFrame:
        return df.filter(self.owned()).drop(LANE)

    def run(
        self, df: DataFrame, before: int, after: int, step: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """One shuffle: spread, apply ``step`` (any number of lane windows), keep owned rows."""
        return self.keep(step(self.spread(df, before, after)))

    def attach(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        """Add one-row-per-series ``stats`` (with its ``n``) to the rows.

        Few series: broadcast, rows do not move. Many: the statistics are repeated once per lane and joined
        on ``(series, lane)``, so that a long series is spread over many join partitions.
        """
        fixed, fits = settle(stats)
        known = fixed.drop(LENGTH) if LENGTH in df.columns else fixed
        if fits:
            return df.join(F.broadcast(known), list(self.keys))
        lanes = F.sequence(
            F.lit(0).cast("long"),
            F.floor((F.greatest(F.col(LENGTH), F.lit(1)) - 1) / F.lit(self.rows)).cast("long"),
        )
        keyed = fixed.withColumn(LANE, F.explode(lanes)).select(*known.columns, LANE)
        return self.tag(df).join(keyed, self.group).drop(LANE)

    def with_length(self, df: DataFrame) -> DataFrame:
        """Add ``n`` where a source did not provide it (positions are dense, so n = count)."""
        if LENGTH in df.columns:
            return df
        return self.attach(df, df.groupBy(*self.keys).agg(F.count("*").alias(LENGTH)))


def short_series(df: DataFrame, width: int, lanes: Lanes = Lanes()) -> DataFrame:
    """``(series keys, n, reason)`` of the series that operators of this width leave out."""
    sizes = df.groupBy(*lanes.keys).agg(F.count("*").alias(LENGTH)).filter(F.col(LENGTH) < width)
    return sizes.withColumn("reason", F.lit("shorter than the window"))


def running_before(
    totals: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], block: int = 4096
) -> DataFrame:
    """Exclusive running sums of ``columns`` by ``index`` within ``keys``, in two levels.

    First inside blocks of ``block`` consecutive indexes, then over the block totals.
    """
    blocks = totals.withColumn("_block", F.floor(F.col(index) / F.lit(block)).cast("long"))
    earlier = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(*earlier)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*earlier)
    sums = blocks.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    zero = F.lit(0)
    offsets = sums.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{c}").over(outer), zero).alias(f"_o_{c}") for c in columns]
    )
    local = blocks.select(
        *keys,
        index,
        "_block",
        *[F.coalesce(F.sum(c).over(inner), zero).alias(f"_l_{c}") for c in columns],
    )
    return local.join(offsets, [*keys, "_block"]).select(
        *keys, index, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in columns]
    )


def _as_number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    if kind == "date":
        return F.unix_date(F.col(name)).cast("long")
    return F.col(name)


#: Parts into which a part of a long series is cut in one round.
SPLITTERS = 64


def sample_slots(df: DataFrame, order: Sequence[str], keys: Sequence[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``_slot``, an array that orders the rows of a series into parts of at most ``slot_rows`` rows.

    Parts that are too long are cut again by splitters: quantiles, from a mergeable sketch, of the first column of ``order``
    that differs inside the part. A stray value is one row among others there. Rows equal to a splitter are a part of
    their own, which the next column cuts, so that no value is too frequent. Parts stay whole only where their rows agree in
    every number, date and timestamp of ``order``. Series of up to ``slot_rows`` rows are one part.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
    columns = [c for c in order if kinds[c] in plain or kinds[c].startswith("decimal")]
    numbers = []
    for c in columns:
        x = _as_number(df, c).cast("double")
        # Nulls stand before all numbers and NaN after them, as in the order of the rows.
        numbers.append(F.coalesce(F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x), F.lit(float("-inf"))))
    rows = df.withColumns({"_slot": F.array().cast("array<int>"), **{f"_o{i}": x for i, x in enumerate(numbers)}})
    path = [*keys, "_slot"]
    done = None
    while columns:
        differs = F.coalesce(*[F.when(F.min(f"_o{i}") < F.max(f"_o{i}"), F.lit(i)) for i in range(len(columns))])
        sizes = rows.groupBy(*path).agg(F.count("*").alias("_rows"), differs.alias("_at")).filter(F.col("_rows") > slot_rows)
        long, few = settle(sizes.filter("_at is not null"))
        left = [tuple(r) for r in long.agg(F.count("*"), F.sum("_rows"), F.max("_rows")).collect()]
        if not left[0][0] or left == done:
            break
        done = left
        chosen = F.lit(None).cast("double")
        for i in range(len(columns)):
            chosen = F.when(F.col("_at") == i, F.col(f"_o{i}")).otherwise(chosen)
        hint = F.broadcast if few else (lambda d: d)
        marks = F.array(*[F.lit(i / SPLITTERS) for i in range(1, SPLITTERS)])
        sketch = F.array_distinct(F.percentile_approx(chosen, marks, F.lit(20 * SPLITTERS)))
        found = rows.join(hint(long), path).groupBy(*path, "_at").agg(sketch.alias("_cuts"))
        cuts, few = settle(found)
        hint = F.broadcast if few else (lambda d: d)
        placed = rows.join(hint(cuts), path, "left")
        below = F.size(F.filter("_cuts", lambda c: c < chosen))
        place = F.lit(2) * below + F.array_contains("_cuts", chosen).cast("int")
        grown = F.when(F.col("_cuts").isNotNull(), F.concat("_slot", F.array(place))).otherwise(F.col("_slot"))
        rows = placed.withColumn("_slot", grown).drop("_at", "_cuts")
    return rows.drop(*[f"_o{i}" for i in range(len(columns))])


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (SERIES,),
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Add dense positions ``seq`` and the length ``n`` for rows ordered by ``order``.

    Series of up to ``slot_rows`` rows are ranked as they are. Longer ones (found by a first aggregate) are cut into
    slots by ``sample_slots``; positions are the rank inside the slot plus the rows of earlier slots. One shuffle of the
    rows either way. ``order`` must be a total order within a series, so that reruns give the same positions.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias(LENGTH)).filter(F.col(LENGTH) > slot_rows)
    long, few = settle(sizes)
    ordering = [F.col(c).asc_nulls_first() for c in order]
    if long.isEmpty():
        return df.withColumns(
            {
                SEQ: (F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)) - 1).cast("long"),
                LENGTH: F.count("*").over(Window.partitionBy(*keys)),
            }
        )
    hint = F.broadcast if few else (lambda d: d)
    slotted = sample_slots(df, order, keys, slot_rows).join(hint(long), keys, "left")
    counts = slotted.filter(F.col(LENGTH).isNotNull()).groupBy(*keys, "_slot").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(  # one row per slot of a long series
        *keys, "_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_slot")
    # Ranked first: a join by shuffle then finds the rows partitioned and sorted by (keys, slot).
    ranked = slotted.withColumns(
        {
            SEQ: F.row_number().over(inside.orderBy(*ordering)),
            LENGTH: F.coalesce(LENGTH, F.count("*").over(inside)),
        }
    )
    return (
        join_small(ranked, offsets, [*keys, "_slot"], "left")
        .withColumn(SEQ, (F.coalesce("_before", F.lit(0)) + F.col(SEQ) - 1).cast("long"))
        .drop("_slot", "_before")
    )
