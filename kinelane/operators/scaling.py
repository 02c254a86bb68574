"""Min-max and standard scaling, per series or from stored parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelane.operators.lanes import Lanes
from kinelane.schema import LENGTH


def _minmax(x: Column, low: Column, high: Column) -> Column:
    """A constant column maps to 0; a missing value stays missing."""
    spread = F.nullif(high - low, F.lit(0.0))
    return F.when(x.isNotNull(), F.coalesce((x - low) / spread, F.lit(0.0)))


def minmax_series(
    df: DataFrame, columns: Sequence[str], suffix: str = "_scaled", lanes: Lanes = Lanes()
) -> DataFrame:
    """``(x - min) / (max - min)`` within each series."""
    made = [f(c).alias(f"_{s}_{c}") for c in columns for s, f in (("lo", F.min), ("hi", F.max))]
    stats = df.groupBy(*lanes.keys).agg(F.count("*").alias(LENGTH), *made)
    drop = [f"_{s}_{c}" for c in columns for s in ("lo", "hi")]
    return (
        lanes.attach(df, stats)
        .withColumns({f"{c}{suffix}": _minmax(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in columns})
        .drop(*drop)
    )


def standardise_series(
    df: DataFrame, columns: Sequence[str], suffix: str = "_trans", lanes: Lanes = Lanes(), keep: bool = False
) -> DataFrame:
    """``(x - mean) / population deviation`` within each series; a constant column has scale 1.

    ``keep`` leaves ``<column>_mean_`` and ``<column>_scale_`` on the rows for ``inverse``.
    """
    made = []
    for c in columns:
        made += [
            F.avg(c).alias(f"{c}_mean_"),
            F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_scale_"),
        ]
    stats = df.groupBy(*lanes.keys).agg(F.count("*").alias(LENGTH), *made)
    out = lanes.attach(df, stats).withColumns(
        {f"{c}{suffix}": (F.col(c) - F.col(f"{c}_mean_")) / F.col(f"{c}_scale_") for c in columns}
    )
    return out if keep else out.drop(*[f"{c}_{s}_" for c in columns for s in ("mean", "scale")])


def inverse(df: DataFrame, columns: Sequence[str], suffix: str = "_trans", to: str = "_back") -> DataFrame:
    """Undo ``standardise_series(keep=True)``."""
    return df.withColumns(
        {
            f"{c}{to}": F.col(f"{c}{suffix}") * F.col(f"{c}_scale_") + F.col(f"{c}_mean_")
            for c in columns
        }
    )


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parameter table ``(column, min, max)``: one row per column, fitted over all rows."""
    wide = df.agg(*[f(c).alias(f"{s}{i}") for i, c in enumerate(columns) for s, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"lo{i}").cast("double").alias("min"),
                F.col(f"hi{i}").cast("double").alias("max"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parameter table ``(column, mean, scale)`` with the population deviation."""
    wide = df.agg(*[f(c).alias(f"{s}{i}") for i, c in enumerate(columns) for s, f in (("m", F.avg), ("d", F.stddev_pop))])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m{i}").alias("mean"),
                F.coalesce(F.nullif(F.col(f"d{i}"), F.lit(0.0)), F.lit(1.0)).alias("scale"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def _one_row(params: DataFrame, columns: Sequence[str], fields: tuple[str, str]) -> DataFrame:
    pick = [
        F.max(F.when(F.col("column") == c, F.col(f))).alias(f"_{f}_{c}") for c in columns for f in fields
    ]
    return params.agg(*pick)


def apply_minmax(df: DataFrame, params: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Scale with stored parameters (a single row after pivoting). Values outside the range are kept."""
    row = _one_row(params, columns, ("min", "max"))
    return (
        df.join(F.broadcast(row), how="cross")
        .withColumns({f"{c}{suffix}": _minmax(F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}")) for c in columns})
        .drop(*row.columns)
    )


def apply_standard(df: DataFrame, params: DataFrame, columns: Sequence[str], suffix: str = "_trans") -> DataFrame:
    row = _one_row(params, columns, ("mean", "scale"))
    return (
        df.join(F.broadcast(row), how="cross")
        .withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_scale_{c}") for c in columns})
        .drop(*row.columns)
    )


def save_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)
