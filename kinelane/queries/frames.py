"""Smoothing, rolling and difference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.functions.signal import magnitude
from kinelane.operators.frames import differences, integrate, motion_features, moving_average, rolling
from kinelane.operators.lanes import Lanes
from kinelane.operators.savgol import compare_filters, savgol, savgol_nearest
from kinelane.queries import Query
from kinelane.queries.common import EM, EV, US, r, rounded
from kinelane.schema import AXES, LENGTH, SEQ, SERIES
from kinelane.sources.recordings import embedding_series, epoch_us, event_series

KEYS = [SERIES, SEQ]


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type with whole milliseconds as the recording's timestamp."""
    return event_series(spark, folder).withColumn("ms", F.floor(epoch_us("ts") / 1000).cast("long"))


def _ma(width: int, source: str, columns: list[str], suffix: str = "_smooth") -> str:
    frame = f"(PARTITION BY series_id ORDER BY seq ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)"
    cols = ", ".join(f"{r(f'sum({c}) OVER {frame} / {width}.0')} AS {c}{suffix}" for c in columns)
    return f"SELECT series_id, seq, {cols} FROM {source} WHERE n >= {width}"


def _rolling_sql(width: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY seq ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"

    def stat(f: str, fill: str | None = None, digits: int = 6) -> str:
        inner = f"{f}(value) OVER {frame}"
        if fill:
            inner = f"coalesce(CASE WHEN isfinite({inner}) THEN {inner} END, {fill})"
        return f"CASE WHEN count(*) OVER {frame} = {width} THEN {r(inner, digits)} END"

    return f"""
WITH {EV}
SELECT series_id, seq, {stat('avg')} AS value_ma, {stat('stddev_samp')} AS value_std,
       {stat('skewness', '0.0', 4)} AS value_skew, {stat('kurtosis', '-3.0', 4)} AS value_kurt FROM ev"""


def _rolling(spark: SparkSession, folder: str) -> DataFrame:
    out = rolling(event_series(spark, folder), ["value"], 100, ["ma", "std", "skew", "kurt"])
    return out.select(
        *KEYS,
        *[F.round(f"value_{s}", 6).alias(f"value_{s}") for s in ("ma", "std")],
        *[F.round(f"value_{s}", 4).alias(f"value_{s}") for s in ("skew", "kurt")],
    )


def savgol_sql(width: int, source: str, column: str, edges: bool = True, out: str = "_smooth") -> str:
    """Least-squares quadratic by its hat matrix, one weighted sum of ``width`` samples per row."""
    half, mid = width // 2, (width - 1) / 2.0
    c = (width**2 - 1) / 12.0
    s2 = width * c
    s4 = width * (width**2 - 1) * (3 * width**2 - 7) / 240.0 - s2 * s2 / width
    before = (width - 1) // 2
    return f"""
p AS (SELECT series_id, seq, n,
        CASE WHEN seq < {half} THEN 0 WHEN seq >= n - {half} THEN n - {width} ELSE seq - {before} END AS s,
        CASE WHEN seq < {half} THEN seq - {mid} WHEN seq >= n - {half} THEN seq - (n - {width}) - {mid} ELSE 0.0 END AS u
      FROM {source} WHERE n >= {width}{'' if edges else f' AND seq >= {half} AND seq < n - {half}'}),
h AS (SELECT p.series_id, p.seq,
        sum(x.{column} * (1.0 / {width} + CAST(u AS DOUBLE) * (x.seq - s - {mid}) / {s2}
            + (CAST(u AS DOUBLE) * u - {c}) * (CAST(x.seq - s - {mid} AS DOUBLE) * (x.seq - s - {mid}) - {c}) / {s4})) AS y
      FROM p JOIN {source} x ON x.series_id = p.series_id AND x.seq BETWEEN p.s AND p.s + {width - 1}
      GROUP BY p.series_id, p.seq)"""


NEAREST_SQL = f"""
WITH {US},
e AS (SELECT series_id, max(CASE WHEN seq = 0 THEN value END) AS first, max(CASE WHEN seq = n - 1 THEN value END) AS last
      FROM us GROUP BY series_id),
g AS (SELECT series_id, seq, n,
        sum(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 109 PRECEDING AND 110 FOLLOWING) AS s FROM us)
SELECT g.series_id, seq, {r('(s + greatest(109 - seq, 0) * first + greatest(seq + 110 - (n - 1), 0) * last) / 220.0')} AS value_smooth
FROM g JOIN e ON g.series_id = e.series_id"""

W = "(PARTITION BY series_id ORDER BY seq)"


def _differences(spark: SparkSession, folder: str) -> DataFrame:
    out = differences(
        _timed(spark, folder), velocity=["value"], acceleration=["value"], absolute=["value"], interval="ms"
    )
    return out.select(
        *KEYS,
        *[F.round(c, 4).alias(c) for c in ("value_velocity", "value_acceleration", "value_diff")],
        F.col("delta_t").cast("long").alias("delta_t"),
    )


def _real_time(spark: SparkSession, folder: str) -> DataFrame:
    out = differences(_timed(spark, folder), velocity=["value"], timestamps="ms", fill=True)
    return rounded(out, KEYS, ["value_velocity"])


def _integrate(spark: SparkSession, folder: str) -> DataFrame:
    hours = event_series(spark, folder).withColumn("hours", epoch_us("ts") / F.lit(3.6e9))
    return rounded(integrate(hours, {"value": "vel_value"}, "hours"), KEYS, ["vel_value"], 4)


def _motion(spark: SparkSession, folder: str) -> DataFrame:
    out = motion_features(embedding_series(spark, folder), width=20)
    names = [f"{c}_smooth" for c in AXES] + [f"{c}_velocity" for c in AXES[3:]] + ["acc_magnitude", "gyro_magnitude"]
    return rounded(out, KEYS, names)


_SM = ", ".join(
    f"sum({c}) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20.0 AS {c}_smooth"
    for c in AXES
)
_MAG = {p: f"sqrt({p}_x_smooth * {p}_x_smooth + {p}_y_smooth * {p}_y_smooth + {p}_z_smooth * {p}_z_smooth)" for p in ("acc", "gyro")}
MOTION_SQL = f"""
WITH {EM}, sm AS (SELECT series_id, seq, {_SM} FROM em WHERE n >= 20)
SELECT series_id, seq, {', '.join(f"{r(f'{c}_smooth')} AS {c}_smooth" for c in AXES)},
  {', '.join(f"{r(f'coalesce(({c}_smooth - lag({c}_smooth) OVER {W}) / 0.01, 0.0)')} AS {c}_velocity" for c in AXES[3:])},
  {r(_MAG['acc'])} AS acc_magnitude, {r(_MAG['gyro'])} AS gyro_magnitude
FROM sm"""


def _full(width: int, key: str = "event_type"):
    return lambda s, d: rounded(savgol(event_series(s, d, key), ["value"], width), KEYS, ["value_smooth"])


def _magnitude(spark: SparkSession, folder: str) -> DataFrame:
    rows = embedding_series(spark, folder)
    both = rows.withColumns({"acc_magnitude": magnitude(*AXES[:3]), "gyro_magnitude": magnitude(*AXES[3:])})
    return rounded(both, KEYS, ["acc_magnitude", "gyro_magnitude"])


def _compare(spark: SparkSession, folder: str) -> DataFrame:
    both = compare_filters(event_series(spark, folder), ["value"])
    gap = F.col("value_savgol") - F.col("value_moving_avg")
    return both.groupBy(SERIES).agg(
        F.count("*").alias("samples"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rms_difference")
    )


QUERIES = {
    "moving_average": Query(
        lambda s, d: rounded(moving_average(event_series(s, d), ["value"], 50), KEYS, ["value_smooth"]),
        f"WITH {EV} {_ma(50, 'ev', ['value'])}",
    ),
    "moving_average_short": Query(
        lambda s, d: rounded(moving_average(event_series(s, d, "user_id"), ["value"], 5), KEYS, ["value_smooth"]),
        f"WITH {US} {_ma(5, 'us', ['value'])}",
    ),
    "rolling_moments": Query(_rolling, _rolling_sql(100)),
    "differences": Query(
        _differences,
        f"""
WITH {EV}, t AS (SELECT *, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms FROM ev)
SELECT series_id, seq, {r(f'(value - lag(value) OVER {W}) / 0.01', 4)} AS value_velocity,
  {r(f'(value - 2 * lag(value, 1) OVER {W} + lag(value, 2) OVER {W}) / 0.0001', 4)} AS value_acceleration,
  {r(f'abs(value - lag(value) OVER {W})', 4)} AS value_diff, coalesce(ms - lag(ms) OVER {W}, 0) AS delta_t
FROM t""",
    ),
    "velocity_real_time": Query(
        _real_time,
        f"""
WITH {EV}, t AS (SELECT *, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms FROM ev)
SELECT series_id, seq,
  {r(f'coalesce((value - lag(value) OVER {W}) / (nullif(ms - lag(ms) OVER {W}, 0) / 1000.0), 0.0)')} AS value_velocity
FROM t""",
    ),
    "integrate": Query(
        _integrate,
        f"""
WITH {EV}, t AS (SELECT *, epoch_us(ts) / 3.6e9 AS hours FROM ev),
g AS (SELECT series_id, seq, value * coalesce(hours - lag(hours) OVER {W}, 0) AS term FROM t)
SELECT series_id, seq, {r('sum(term) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING)', 4)} AS vel_value FROM g""",
    ),
    "motion_features": Query(_motion, MOTION_SQL),
    "savgol_interior": Query(
        lambda s, d: rounded(savgol(event_series(s, d), ["value"], 101, edges=False), KEYS, ["value_smooth"]),
        f"WITH {EV}, {savgol_sql(101, 'ev', 'value', edges=False)} SELECT series_id, seq, {r('y')} AS value_smooth FROM h",
    ),
    "savgol_full": Query(
        _full(101),
        f"WITH {EV}, {savgol_sql(101, 'ev', 'value')} SELECT series_id, seq, {r('y')} AS value_smooth FROM h",
    ),
    "savgol_51": Query(
        _full(51, "user_id"),
        f"WITH {US}, {savgol_sql(51, 'us', 'value')} SELECT series_id, seq, {r('y')} AS value_smooth FROM h",
    ),
    "savgol_even": Query(
        _full(100),
        f"WITH {EV}, {savgol_sql(100, 'ev', 'value')} SELECT series_id, seq, {r('y')} AS value_smooth FROM h",
    ),
    "savgol_nearest": Query(
        lambda s, d: rounded(savgol_nearest(event_series(s, d, "user_id"), ["value"], 220), KEYS, ["value_smooth"]),
        NEAREST_SQL,
    ),
    "filter_compare": Query(
        _compare,
        f"""
WITH {EV}, {savgol_sql(101, 'ev', 'value')},
m AS (SELECT series_id, seq, n,
        sum(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50.0 AS ma FROM ev)
SELECT m.series_id, count(*) AS samples, {r('sqrt(avg((y - ma) * (y - ma)))')} AS rms_difference
FROM m JOIN h ON h.series_id = m.series_id AND h.seq = m.seq GROUP BY m.series_id""",
    ),
    "magnitude": Query(
        _magnitude,
        f"""
WITH {EM}
SELECT series_id, seq, {r('sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)')} AS acc_magnitude,
  {r('sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z)')} AS gyro_magnitude FROM em""",
    ),
    "series_positions": Query(
        lambda s, d: event_series(s, d).select(SERIES, "event_id", SEQ, LENGTH),
        f"WITH {EV} SELECT series_id, event_id, seq, n FROM ev",
    ),
}
