"""Exact ranks and quantiles without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelane.operators.lanes import join_small, running_before, settle


#: Rank error of the sketch as a share of a group, and how many of them a bracket reaches to either side.
ACCURACY, REACH = 10_000, 3
#: Different values of a group that one task puts in order.
ORDERED = 1_000_000


def _bracketed(rows: DataFrame, totals: DataFrame, few: bool, keys: list[str], k: int) -> DataFrame:
    """``keys, _base, _v, _c``: rows counted by value inside the brackets, and as one number between two of them.

    ``_base`` is the greatest upper end below a value, so that (``_base``, ``_v``, nulls first) is the order of values.
    """
    x = F.col("_v")
    inside = F.lit(False)
    for i in range(k):
        inside = inside | ((x >= F.col("_q")[i]) & (x <= F.col("_q")[k + i]))
    base = [F.when(F.col("_q")[k + i] < x, F.col("_q")[k + i]) for i in range(k)] + [F.lit(float("-inf"))]
    joined = rows.join(F.broadcast(totals) if few else totals, keys)
    cells = joined.select(*keys, F.greatest(*base).alias("_base"), F.when(inside, x).alias("_v"))
    return cells.groupBy(*keys, "_base", "_v").agg(F.count("*").alias("_c"))


def _placed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Values inside the brackets with ``_first``, the rank of their first row in the group.

    A group with over ORDERED different values is cut by a sketch of these into slots of about that many, which are
    put in order apart and follow each other by their totals.
    """
    between = cells.filter("_v is null").groupBy(*keys).agg(F.collect_list(F.struct("_base", "_c")).alias("_gaps"))
    own = join_small(cells.filter("_v is not null"), between, keys, "left")
    below = F.aggregate(
        F.coalesce("_gaps", F.array().cast("array<struct<_base:double,_c:bigint>>")), F.lit(0).cast("long"),
        lambda a, g: a + F.when(g["_base"] <= F.col("_base"), g["_c"]).otherwise(0),
    )
    own = own.select(*keys, "_v", "_c", below.alias("_below"))
    most = own.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    slots = -(-most // ORDERED)
    if slots < 2:
        own = own.withColumns({"_slot": F.lit(0), "_slot_before": F.lit(0)})
    else:
        marks = F.array(*[F.lit(i / slots) for i in range(1, slots)])
        cuts = own.groupBy(*keys).agg(F.percentile_approx("_v", marks, F.lit(10 * slots)).alias("_cuts"))
        own = join_small(own, cuts, keys)
        own = own.withColumn("_slot", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        totals = own.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_slot_c"))
        before = running_before(totals, keys, "_slot", ["_slot_c"]).withColumnRenamed("_slot_c_before", "_slot_before")
        own = join_small(own, before, [*keys, "_slot"])
    earlier = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_below") + F.col("_slot_before") + F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    return own.select(*keys, "_v", "_c", first.alias("_first"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Linear-interpolation quantiles per group, as ``(keys, p, value)`` rows; null values take no part."""
    return _quantiles(df, keys, value, probabilities, [], accuracy)[0]


def _quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], also: Sequence[Column], accuracy: int = ACCURACY
) -> tuple[DataFrame, DataFrame]:
    """Quantiles, and a table of the aggregates ``also`` (of the value, as ``_v``) per group from the same first pass.

    Two passes over the rows. The first one makes a mergeable quantile sketch of each group, whose values at ranks a
    little below and above a wanted one bracket it. The second counts rows: by value inside the brackets (some
    thousandths of a group), as one number between them. Ranks decide, so an outlier widens nothing, and a value that
    repeats is one row. Brackets that miss a rank, against the sketch's promise, are made four times as wide.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    marks = sorted({float(p) for p in probabilities})
    reach, k = REACH / accuracy, len(marks)
    while True:
        ends = [max(p - reach, 0.0) for p in marks] + [min(p + reach, 1.0) for p in marks]
        sketch = F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy))
        totals, few = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n"), sketch.alias("_q"), *also))
        cells = settle(_bracketed(rows, totals, few, keys, k))[0]
        wanted = totals.select(*keys, "_n", F.explode(F.array(*[F.lit(p) for p in marks])).alias("p"))
        wanted = wanted.withColumn("_at", F.col("p") * (F.col("_n") - 1).cast("double"))
        ranks = wanted.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.floor("_at"), F.ceil("_at"))))).alias("_ranks"))
        placed = join_small(_placed(cells, keys), ranks, keys)
        mine = F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_c")))
        picked = settle(placed.select(*keys, F.explode(mine).alias("_rank"), "_v"))[0]  # a few per group
        if picked.count() == (ranks.agg(F.sum(F.size("_ranks"))).first()[0] or 0):
            break
        reach *= 4
    low = picked.select(*keys, F.col("_rank").alias("_lr"), F.col("_v").alias("_lv"))
    high = picked.select(*keys, F.col("_rank").alias("_hr"), F.col("_v").alias("_hv"))
    named = wanted.withColumns({"_lr": F.floor("_at"), "_hr": F.ceil("_at")})
    share = F.col("_at") - F.col("_lr")
    found = named.join(low, [*keys, "_lr"]).join(high, [*keys, "_hr"])
    found = found.select(*keys, "p", (F.col("_lv") + (F.col("_hv") - F.col("_lv")) * share).alias(value))
    return found, totals.drop("_q")


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, 10/25/50/75/90 % and max of each column per group."""
    keys = list(keys)
    marks = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    # One row per value only where columns are described together; built without a shuffle.
    long = df.select(*keys, F.inline(pairs))
    group = [*keys, "column"]
    also = [F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")]
    q, basic = _quantiles(long, group, "x", list(marks.values()), also)
    wide = q.groupBy(*group).agg(*[F.max(F.when(F.col("p") == p, F.col("x"))).alias(name) for name, p in marks.items()])
    basic = basic.select(*group, F.col("_n").alias("count"), "mean", "std", "min", "max")
    every = df.select(*keys, F.explode(F.array(*map(F.lit, columns))).alias("column")).distinct()
    return every.join(basic, group, "left").withColumn("count", F.coalesce("count", F.lit(0))).join(wide, group, "left")
