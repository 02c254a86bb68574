"""Augmentation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.operators.augment import add_noise, jitter, resample, resample_cubic, resample_linear, rotate, variants
from kinelane.queries import Query
from kinelane.queries.common import EM, EV, US, r, rounded
from kinelane.schema import AXES, LENGTH, SEQ, SERIES
from kinelane.sources.recordings import embedding_series, epoch_us, event_series

KEYS = [SERIES, SEQ]
START_US = 1704067200000000  # the first day of the events


def normals_sql(seed: int, count: int = 6) -> list[str]:
    """The same draws: 32-bit words of an MD5 as two uniforms, then Box-Muller."""
    out = []
    for stream in range((count + 1) // 2):
        digest = f"md5(series_id || ':' || seq || ':{seed}:{stream}')"
        u, v = (f"((CAST(('0x' || substr({digest}, {at}, 8)) AS BIGINT) + 0.5) / 4294967296.0)" for at in (1, 9))
        out += [f"sqrt(-2.0 * ln(CAST({u} AS DOUBLE))) * {f}({2 * math.pi!r} * CAST({v} AS DOUBLE))" for f in ("cos", "sin")]
    return out[:count]


def _stamped(spark: SparkSession, folder: str) -> DataFrame:
    """Six-axis series with two made-up clocks: 10 ms apart, the second 6 ms later."""
    return embedding_series(spark, folder).withColumns(
        {"timestamp_acc": F.col("vec_id") * 10, "timestamp_gyro": F.col("vec_id") * 10 + 6}
    )


def _linear(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_series(spark, folder, "user_id").withColumn("hours", (epoch_us("ts") - F.lit(START_US)) / F.lit(3.6e9))
    out = resample_linear(rows, ["hours"])
    return out.select(*KEYS, LENGTH, F.round("hours", 6).alias("hours"))


def _cubic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(resample_cubic(event_series(spark, folder, "user_id"), ["value"]), KEYS, ["value"])


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(variants(_stamped(spark, folder)), [*KEYS, "variant"], ["timestamp_acc", "timestamp_gyro", *AXES], 5)


NOISE_SQL = ", ".join(f"{r(f'{a} + 0.02 * {z}')} AS {a}" for a, z in zip(AXES, normals_sql(42)))
JITTER_SQL = ", ".join(
    f"{r(f'{a} + 0.01 * stddev_pop({a}) OVER (PARTITION BY series_id) * {z}')} AS {a}" for a, z in zip(AXES, normals_sql(43))
)


def spline_sql(source: str, column: str = "value") -> str:
    """Spline second derivatives by forward elimination and back substitution along each series."""
    return f"""
y AS (SELECT series_id, seq, n, {column} AS y, 6 * (lead({column}) OVER w - 2 * {column} + lag({column}) OVER w) AS r
      FROM {source} WHERE n >= 4 WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
fwd AS (
  SELECT series_id, seq, n, CAST(0 AS DOUBLE) AS c, CAST(r / 6 AS DOUBLE) AS d FROM y WHERE seq = 1
  UNION ALL
  SELECT y.series_id, y.seq, y.n, CASE WHEN y.seq = y.n - 2 THEN 0 ELSE 1 / (4 - f.c) END,
         CASE WHEN y.seq = y.n - 2 THEN y.r / 6 ELSE (y.r - f.d) / (4 - f.c) END
  FROM fwd f JOIN y ON y.series_id = f.series_id AND y.seq = f.seq + 1 WHERE y.seq <= y.n - 2),
bwd AS (
  SELECT series_id, seq, n, d AS m FROM fwd WHERE seq = n - 2
  UNION ALL
  SELECT f.series_id, f.seq, f.n, f.d - f.c * b.m FROM bwd b JOIN fwd f ON f.series_id = b.series_id AND f.seq = b.seq - 1),
ends AS (SELECT series_id, seq, m FROM bwd
  UNION ALL SELECT a.series_id, 0, 2 * a.m - b.m FROM bwd a JOIN bwd b ON b.series_id = a.series_id AND b.seq = 2 WHERE a.seq = 1
  UNION ALL SELECT a.series_id, a.n - 1, 2 * a.m - b.m FROM bwd a JOIN bwd b ON b.series_id = a.series_id AND b.seq = a.n - 3 WHERE a.seq = a.n - 2),
knots AS (SELECT y.series_id, y.seq, y.n, y.y, e.m FROM y JOIN ends e ON e.series_id = y.series_id AND e.seq = y.seq),
outs AS (SELECT series_id, n, unnest(range(2 * n)) AS k FROM knots WHERE seq = 0),
cells AS (SELECT *, least((k * (n - 1)) // (2 * n - 1), n - 2) AS cell FROM outs),
spot AS (SELECT *, CAST(k * (n - 1) - cell * (2 * n - 1) AS DOUBLE) / (2 * n - 1) AS t FROM cells),
spline AS (SELECT a.series_id, a.k AS seq, (1 - t) * p.y + t * q.y
      + ((power(1 - t, 3) - (1 - t)) * p.m + (power(t, 3) - t) * q.m) / 6 AS value
  FROM spot a JOIN knots p ON p.series_id = a.series_id AND p.seq = a.cell JOIN knots q ON q.series_id = a.series_id AND q.seq = a.cell + 1)"""


def variants_sql(digits: int = 5) -> str:
    """The four variants, each as its own query's twin makes it, with both clocks."""
    clocks = ("vec_id * 10", "vec_id * 10 + 6")
    plain = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for c, n in zip(clocks, ("timestamp_acc", "timestamp_gyro"), strict=True))
    noisy = ", ".join(f"{r(f'{a} + 0.02 * {z}', digits)} AS {a}" for a, z in zip(AXES, normals_sql(42)))
    jittered = ", ".join(f"{r(f'{a} + 0.01 * stddev_pop({a}) OVER (PARTITION BY series_id) * {z}', digits)} AS {a}" for a, z in zip(AXES, normals_sql(43)))
    c, d = "cos(radians(10))", "sin(radians(10))"
    rotated = ", ".join(f"{r(f'{c} * {p}_x - {d} * {p}_y', digits)} AS {p}_x, {r(f'{d} * {p}_x + {c} * {p}_y', digits)} AS {p}_y, {r(f'{p}_z', digits)} AS {p}_z" for p in ("acc", "gyro"))
    made = [f"SELECT series_id, seq, '{name}' AS variant, {plain}, {axes} FROM em" for name, axes in (("noisy", noisy), ("jittered", jittered), ("rotated", rotated))]
    share = "(CAST(s.k * (s.n - 1) - s.cell * (2 * s.n - 1) AS DOUBLE) / (2 * s.n - 1))"
    times = ", ".join(f"{r(f'{c.replace('vec_id', 'p.vec_id')} + (q.vec_id - p.vec_id) * 10 * {share}', digits)} AS {n}" for c, n in zip(clocks, ("timestamp_acc", "timestamp_gyro"), strict=True))
    splines = "".join(
        f" JOIN (WITH RECURSIVE {EM}, {spline_sql('em', a)} SELECT series_id, seq, value AS {a} FROM spline) USING (series_id, seq)" for a in AXES
    )
    axes = ", ".join(f"{r(a, digits)} AS {a}" for a in AXES)
    return f"""
WITH {EM}, o AS (SELECT series_id, n, unnest(range(2 * n)) AS k FROM em WHERE seq = 0 AND n >= 4),
s AS (SELECT *, least((k * (n - 1)) // (2 * n - 1), n - 2) AS cell FROM o),
i AS (SELECT s.series_id, CAST(s.k AS BIGINT) AS seq, {times} FROM s JOIN em p ON p.series_id = s.series_id AND p.seq = s.cell
      JOIN em q ON q.series_id = s.series_id AND q.seq = s.cell + 1)
{" UNION ALL ".join(made)}
UNION ALL SELECT series_id, seq, 'interpolated' AS variant, timestamp_acc, timestamp_gyro, {axes} FROM i{splines}"""


QUERIES = {
    "noise": Query(
        lambda s, d: rounded(add_noise(embedding_series(s, d)), KEYS, AXES), f"WITH {EM} SELECT series_id, seq, {NOISE_SQL} FROM em"
    ),
    "jitter": Query(
        lambda s, d: rounded(jitter(embedding_series(s, d)), KEYS, AXES), f"WITH {EM} SELECT series_id, seq, {JITTER_SQL} FROM em"
    ),
    "rotate": Query(
        lambda s, d: rounded(rotate(embedding_series(s, d)), KEYS, AXES),
        f"WITH {EM} SELECT series_id, seq, "
        + ", ".join(
            f"{r(f'cos(radians(10)) * {p}_x - sin(radians(10)) * {p}_y')} AS {p}_x, {r(f'sin(radians(10)) * {p}_x + cos(radians(10)) * {p}_y')} AS {p}_y, {r(f'{p}_z')} AS {p}_z"
            for p in ("acc", "gyro")
        )
        + " FROM em",
    ),
    "resample_linear": Query(
        _linear,
        f"""
WITH {US}, t AS (SELECT series_id, seq, n, (epoch_us(ts) - {START_US}) / 3.6e9 AS hours FROM us),
o AS (SELECT series_id, n, unnest(range(2 * n)) AS k FROM t WHERE seq = 0),
c AS (SELECT *, CASE WHEN n > 1 THEN least((k * (n - 1)) // (2 * n - 1), n - 2) ELSE 0 END AS cell FROM o)
SELECT c.series_id, CAST(k AS BIGINT) AS seq, 2 * c.n AS n,
  {r('a.hours + coalesce((b.hours - a.hours) * (CAST(k * (c.n - 1) - cell * (2 * c.n - 1) AS DOUBLE) / (2 * c.n - 1)), 0)')} AS hours
FROM c JOIN t a ON a.series_id = c.series_id AND a.seq = cell LEFT JOIN t b ON b.series_id = c.series_id AND b.seq = cell + 1""",
    ),
    "resample_cubic": Query(
        _cubic, f"WITH RECURSIVE {US}, {spline_sql('us')} SELECT series_id, CAST(seq AS BIGINT) AS seq, {r('value')} AS value FROM spline"
    ),
    "augment_all": Query(_variants, variants_sql()),
}
