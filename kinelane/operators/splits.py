"""Exact-size random splits, plain and stratified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelane.operators.lanes import join_small, settle

DIGEST_DIGITS = 32
DIGITS = 3  # hex digits of one level: 4,096 even buckets
ORDERED = 1_000_000  # rows of a bucket that one task puts in order


def _digest(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _cuts(df: DataFrame, by: list[str], shares: Sequence[float], digest: Column) -> DataFrame:
    """Digest of the last row of each part per group: ``cut0``, ``cut1``, ... (at ``ceil(share * n)`` rows).

    Rank selection by digits: bucket counts give the bucket that holds a cut, and a bucket of over ORDERED rows is
    counted by its next digits, until the rows of the bucket can be put in order.
    """
    hashed = df.select(*by, digest.alias("_d"))
    totals = hashed.groupBy(*by).agg(F.count("*").alias("_n"))
    # Shares add up from the start, each step as a share of what is left (as two-step splits do).
    sizes: list[Column] = []
    left = F.col("_n")
    for share in shares:
        size = F.ceil(F.round(F.lit(share) * left, 9))
        sizes.append((sizes[-1] if sizes else F.lit(0)) + size)
        left = left - size
    targets = F.array(*[F.struct(F.lit(i).alias("i"), s.cast("long").alias("_k")) for i, s in enumerate(sizes)])
    # The row wanted of each cut, counted from 1 inside the bucket ``_b`` of digits known so far.
    wanted = settle(totals.select(*by, F.inline(targets)).filter("_k > 0").withColumn("_b", F.lit("")))[0]
    digits = 0
    while True:
        bucket = [*by, "_b"]
        placed = hashed.withColumn("_b", F.substring("_d", 1, digits)) if digits else hashed.withColumn("_b", F.lit(""))
        inside = join_small(placed, wanted.select(*bucket).distinct(), bucket, "left_semi")
        finer = inside.withColumn("_next", F.substring("_d", 1, digits + DIGITS))
        counts = finer.groupBy(*bucket, "_next").agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*bucket).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        found = spans.join(wanted.drop("_c"), bucket).filter((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
        found = found.select(*by, F.col("_next").alias("_b"), "i", (F.col("_k") - F.col("_before")).alias("_k"), "_c")
        wanted, _ = settle(found)
        digits += DIGITS
        if digits >= DIGEST_DIGITS or (wanted.agg(F.max("_c")).first()[0] or 0) <= ORDERED:
            break
    bucket = [*by, "_b"]
    placed = hashed.withColumn("_b", F.substring("_d", 1, digits))
    picked = (
        join_small(placed, wanted.select(*bucket).distinct(), bucket, "left_semi")
        .withColumn("_k", F.row_number().over(Window.partitionBy(*bucket).orderBy("_d")))
        .join(wanted.drop("_c"), [*bucket, "_k"])
    )
    return picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("i") == i, F.col("_d"))).alias(f"cut{i}") for i in range(len(shares))]
    )


def random_split(
    df: DataFrame,
    keys: Sequence[str],
    shares: Sequence[float] = (0.2,),
    names: Sequence[str] = ("test", "train"),
    stratify: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``part``: rows in digest order, the first ``ceil(share * n)`` in the first part and so on.

    ``keys`` identify a row. With ``stratify`` sizes hold within each class. The rows themselves are not
    shuffled: each compares its digest with the cut of its class.
    """
    # Rows without a class are a class of their own: a join on the column itself would lose them.
    by = ["_all"] if not stratify else ["_no", "_all"]
    whole = F.lit(1) if not stratify else F.coalesce(F.col(stratify).cast("string"), F.lit(""))
    rows = df.withColumn("_all", whole)
    rows = rows.withColumn("_no", F.col(stratify).isNull()) if stratify else rows
    rows = rows.withColumn("_d", _digest(keys, seed))
    cuts = _cuts(rows.drop("_d"), by, shares, _digest(keys, seed))
    joined = join_small(rows, cuts, by)
    chain: Column | None = None
    for i, name in enumerate(names[:-1]):
        hit = F.col("_d") <= F.col(f"cut{i}")
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    assert chain is not None
    out = joined.withColumn("part", chain.otherwise(names[-1]))
    return out.drop("_d", "_all", "_no", *[f"cut{i}" for i in range(len(shares))])


def class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Add ``n / (classes * n_class)`` so that classes weigh the same; rows without a class get weight 0."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(total), how="cross").select(
        label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(weight)
    )
    return join_small(df, weights, [label], "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)))
