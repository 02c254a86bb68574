"""Window, segment, split and concatenation queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.functions.windows_udtf import register_window_starts
from kinelane.operators.lanes import Lanes
from kinelane.operators.learning import per_column, per_series
from kinelane.operators.splits import class_weights, random_split
from kinelane.operators.windows import (
    chronological_split,
    concatenate,
    drop_last,
    forecast_windows,
    segment_features,
    segment_rows,
    sequence_targets,
    shift_ahead,
    sliding_windows,
    union_labelled,
)
from kinelane.queries import Query
from kinelane.queries.common import EM, EV, US, r, rounded
from kinelane.schema import AXES, SEQ, SERIES
from kinelane.sources.recordings import embedding_series, event_series, table


def _sum(channel: int) -> Column:
    return F.aggregate("features", F.lit(0.0), lambda a, v: a + v[channel])


def _weighted(channel: int) -> Column:
    """Depends on the order of the samples, unlike their sum."""
    marked = F.transform("features", lambda v, i: v[channel] * (i + 1))
    return F.aggregate(marked, F.lit(0.0), lambda a, v: a + v)


def _digest(windows: DataFrame, channels: list[str], *extra: str) -> DataFrame:
    made = []
    for i, c in enumerate(channels):
        made += [F.round(_sum(i), 6).alias(f"{c}_sum"), F.round(_weighted(i), 6).alias(f"{c}_weighted")]
    return windows.select(SERIES, "window_id", "start", F.size("features").cast("long").alias("samples"), *made, *extra)


def _digest_sql(cte: str, source: str, width: int, step: int, channels: list[str], reach: int, target: int | None = None) -> str:
    made = ", ".join(
        f"{r(f'sum(x.{c})')} AS {c}_sum, {r(f'sum(x.{c} * (x.seq - w.start + 1))')} AS {c}_weighted" for c in channels
    )
    aim = f", max(t.{channels[0]}) AS target" if target is not None else ""
    join = f"JOIN {source} t ON t.series_id = w.series_id AND t.seq = w.start + {target}" if target is not None else ""
    return f"""
WITH {cte}, w AS (SELECT series_id, seq AS start FROM {source} WHERE seq % {step} = 0 AND seq + {reach} <= n)
SELECT w.series_id, CAST(w.start // {step} AS BIGINT) AS window_id, w.start, count(*) AS samples, {made}{aim}
FROM w JOIN {source} x ON x.series_id = w.series_id AND x.seq BETWEEN w.start AND w.start + {width - 1} {join}
GROUP BY w.series_id, w.start"""


def _sliding(width: int, step: int):
    return lambda s, d: _digest(sliding_windows(event_series(s, d), ["value"], width, step), ["value"])


def _six_axes(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(sliding_windows(embedding_series(spark, folder), AXES, 20, 10), AXES)


def _segments(keep_last: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = segment_rows(event_series(spark, folder, "user_id"), 10, keep_last)
        return rows.groupBy(SERIES).agg(
            F.count("*").alias("rows"), F.count_distinct("segment").alias("segments")
        )

    return run


def _segments_sql(op: str) -> str:
    return f"""
WITH {US} SELECT series_id, count(*) AS rows, count(DISTINCT seq // 10) AS segments
FROM us WHERE (seq // 10) * 10 {op} n - 10 GROUP BY series_id"""


def _segment_features(spark: SparkSession, folder: str) -> DataFrame:
    out = segment_features(embedding_series(spark, folder), label="label", width=20)
    return out.select(SERIES, "segment", "label", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))])


_NAMES = [*AXES, "acc_magnitude", "gyro_magnitude"]
SEGMENT_SQL = f"""
WITH {EM}, m AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_magnitude,
    sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) AS gyro_magnitude FROM em WHERE (seq // 20) * 20 < n - 20)
SELECT series_id, CAST(seq // 20 AS BIGINT) AS segment, any_value(label) AS label,
  {', '.join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_samp({c})')} AS {c}_std" for c in _NAMES)}
FROM m GROUP BY series_id, seq // 20"""


def _segment_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = segment_rows(event_series(spark, folder, "event_type", "user_id"), 10)
    return rows.groupBy(SERIES, "segment").agg(F.mode(F.col("user_id") % 7, True).alias("label"))


MODE_SQL = f"""
WITH {EV}, c AS (SELECT series_id, CAST(seq // 10 AS BIGINT) AS segment, user_id % 7 AS label, count(*) AS k
  FROM ev WHERE (seq // 10) * 10 < n - 10 GROUP BY ALL)
SELECT series_id, segment, label FROM c
QUALIFY row_number() OVER (PARTITION BY series_id, segment ORDER BY k DESC, label) = 1"""


def _chrono(first: float, second: float):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = chronological_split(event_series(spark, folder, "user_id"), first, second)
        return rows.groupBy(SERIES, "part").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))

    return run


def _chrono_sql(first: float, second: float) -> str:
    a, b = (f"floor(CAST({x} AS DOUBLE) * n)" for x in (first, second))
    return f"""
WITH {US}, p AS (SELECT *, CASE WHEN seq < {a} THEN 'train' WHEN seq < {a} + {b} THEN 'valid' ELSE 'test' END AS part FROM us)
SELECT series_id, part, count(*) AS rows, {r('sum(value)', 4)} AS total FROM p GROUP BY series_id, part"""


def _by_user(spark: SparkSession, folder: str) -> DataFrame:
    return event_series(spark, folder, "user_id")


def _concat(spark: SparkSession, folder: str) -> DataFrame:
    joined = concatenate(_by_user(spark, folder).select(SERIES, SEQ, "n", "value"), into="all").select(
        F.col("dataset").alias(SERIES), F.col("global_seq").alias(SEQ), F.col("total").alias("n"), "value"
    )
    return segment_rows(joined, 100).groupBy("segment").agg(
        F.count("*").alias("rows"), F.round(F.avg("value"), 6).alias("value_mean"), F.round(F.stddev_samp("value"), 6).alias("value_std")
    )


CONCAT_SQL = f"""
WITH {US}, z AS (SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS k FROM events GROUP BY user_id),
o AS (SELECT series_id, coalesce(sum(k) OVER (ORDER BY md5(series_id), series_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs,
        sum(k) OVER () AS total FROM z),
g AS (SELECT CAST(offs + seq AS BIGINT) AS gs, total, value FROM us JOIN o USING (series_id))
SELECT CAST(gs // 100 AS BIGINT) AS segment, count(*) AS rows, {r('avg(value)')} AS value_mean, {r('stddev_samp(value)')} AS value_std
FROM g WHERE (gs // 100) * 100 < total - 100 GROUP BY gs // 100"""


def _top(spark: SparkSession, folder: str) -> DataFrame:
    return event_series(spark, folder).select(SERIES, SEQ, "value").orderBy(SERIES, SEQ).limit(110)


def _sorted(spark: SparkSession, folder: str) -> DataFrame:
    rows = shift_ahead(event_series(spark, folder, "user_id"), "value", 5, "later")
    made = rows.withColumns({"predicted": (F.col("value") > 50).cast("int"), "true_label": (F.col("later") > 50).cast("int")})
    return made.select(SERIES, SEQ, "predicted", "true_label").orderBy("predicted", SERIES, SEQ)


def _union(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings read from several sources as one table."""
    a = event_series(spark, folder).select(F.concat(F.lit("type_"), SERIES).alias(SERIES), SEQ, "value")
    b = event_series(spark, folder, "user_id").select(F.concat(F.lit("user_"), SERIES).alias(SERIES), SEQ, "value")
    return a.unionByName(b).groupBy(SERIES).agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))


def _udtf(spark: SparkSession, folder: str) -> DataFrame:
    register_window_starts(spark)
    sizes = event_series(spark, folder, "user_id").groupBy(SERIES).agg(F.count("*").cast("int").alias("n"))
    sizes.createOrReplaceTempView("kinelane_sizes")
    return spark.sql("SELECT s.series_id, w.window_id, w.start FROM kinelane_sizes s, LATERAL window_starts(s.n, 20, 10) w")


def _split(stratify: str | None, two_step: bool = False):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "embeddings").select("vec_id", "label")
        if two_step:
            return random_split(rows, ["vec_id"], (0.2, 0.25), ("test", "valid", "train"), stratify)
        return random_split(rows, ["vec_id"], stratify=stratify)

    return run


def _split_sql(partition: str, two_step: bool = False) -> str:
    rest = "WHEN rn <= t + ceil(round(0.25 * (n - t), 9)) THEN 'valid' " if two_step else ""
    return f"""
WITH h AS (SELECT vec_id, label, row_number() OVER ({partition} ORDER BY md5(vec_id || ':42')) AS rn, count(*) OVER ({partition}) AS n FROM embeddings),
c AS (SELECT *, ceil(round(0.2 * n, 9)) AS t FROM h)
SELECT vec_id, label, CASE WHEN rn <= t THEN 'test' {rest}ELSE 'train' END AS part FROM c"""


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "event_type")
    out = class_weights(rows, "event_type")
    return out.select("event_id", "event_type", F.round("weight", 6).alias("weight"))


def _union_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of two sets of recordings (even and odd users), each cut by itself, as one labelled set."""
    rows = event_series(spark, folder, "user_id")
    odd = F.col(SERIES).cast("long") % 2
    made = {k: sliding_windows(rows.filter(odd == k), ["value"], 20, 10) for k in (0, 1)}
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v[0])
    return union_labelled(made).select(SERIES, "window_id", "label", F.round(total, 6).alias("total"))


def _per_column(spark: SparkSession, folder: str) -> DataFrame:
    """A user's column function on several columns."""
    made = per_column(embedding_series(spark, folder), AXES, lambda c: F.sqrt(F.abs(c)), "_root")
    return rounded(made, [SERIES, SEQ], [f"{a}_root" for a in AXES])


def _spans(pdf: pd.DataFrame) -> pd.DataFrame:
    ordered = pdf.sort_values("seq")
    steps = ordered["value"].diff().abs().sum()
    return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "rows": [len(pdf)], "path": [float(steps)]})


def _per_series(spark: SparkSession, folder: str) -> DataFrame:
    """A user's pandas function on every recording: the length of the way its values take."""
    rows = event_series(spark, folder, "user_id").select(SERIES, SEQ, "value")
    return rounded(per_series(rows, _spans, "series_id string, rows long, path double"), [SERIES, "rows"], ["path"])


QUERIES = {
    "sliding_windows": Query(_sliding(100, 50), _digest_sql(EV, "ev", 100, 50, ["value"], 100)),
    "sliding_windows_dense": Query(_sliding(100, 10), _digest_sql(EV, "ev", 100, 10, ["value"], 100)),
    "sliding_windows_axes": Query(_six_axes, _digest_sql(EM, "em", 20, 10, AXES, 20)),
    "window_starts_udtf": Query(
        _udtf,
        f"WITH {US} SELECT series_id, CAST(seq // 10 AS BIGINT) AS window_id, seq AS start FROM us WHERE seq % 10 = 0 AND seq + 20 <= n",
    ),
    "segments": Query(_segments(False), _segments_sql("<")),
    "segments_keep_last": Query(_segments(True), _segments_sql("<=")),
    "segment_features": Query(_segment_features, SEGMENT_SQL),
    "segment_label": Query(_segment_label, MODE_SQL),
    "forecast_windows": Query(
        lambda s, d: _digest(forecast_windows(event_series(s, d), "value"), ["value"], "target"),
        _digest_sql(EV, "ev", 20, 1, ["value"], 21, 20),
    ),
    "sequence_targets": Query(
        lambda s, d: _digest(sequence_targets(_by_user(s, d), ["value"], "value", 30), ["value"], "target"),
        _digest_sql(US, "us", 30, 1, ["value"], 31, 30),
    ),
    "sequence_targets_trimmed": Query(
        lambda s, d: _digest(sequence_targets(_by_user(s, d), ["value"], "value", 12, trim_tail=True), ["value"], "target"),
        _digest_sql(US, "us", 12, 1, ["value"], 24, 12),
    ),
    "chrono_split": Query(_chrono(3 / 5, 1 / 5), _chrono_sql(3 / 5, 1 / 5)),
    "chrono_split_swapped": Query(_chrono(1 / 5, 3 / 5), _chrono_sql(1 / 5, 3 / 5)),
    "drop_last_rows": Query(
        lambda s, d: drop_last(_by_user(s, d)).select(SERIES, SEQ, "n", "value"),
        f"WITH {US} SELECT series_id, seq, n - 2 AS n, value FROM us WHERE seq < n - 2",
    ),
    "shifted_labels": Query(
        lambda s, d: shift_ahead(_by_user(s, d), "value", 30).select(SERIES, SEQ, "value", "true_label"),
        f"WITH {US} SELECT a.series_id, a.seq, a.value, b.value AS true_label FROM us a JOIN us b ON a.series_id = b.series_id AND b.seq = a.seq + 30",
    ),
    "concat_segments": Query(_concat, CONCAT_SQL),
    "top_rows": Query(_top, f"WITH {EV} SELECT series_id, seq, value FROM ev ORDER BY series_id, seq LIMIT 110"),
    "sorted_results": Query(
        _sorted,
        f"""WITH {US} SELECT a.series_id, a.seq, CAST(a.value > 50 AS INTEGER) AS predicted, CAST(b.value > 50 AS INTEGER) AS true_label
FROM us a JOIN us b ON a.series_id = b.series_id AND b.seq = a.seq + 5 ORDER BY predicted, a.series_id, a.seq""",
    ),
    "union_recordings": Query(
        _union,
        f"""SELECT 'type_' || event_type AS series_id, count(*) AS rows, {r('sum(value)', 4)} AS total FROM events GROUP BY event_type
UNION ALL SELECT 'user_' || user_id, count(*), {r('sum(value)', 4)} FROM events GROUP BY user_id""",
    ),
    "split_random": Query(_split(None), _split_sql("")),
    "split_stratified": Query(_split("label"), _split_sql("PARTITION BY label")),
    "split_two_steps": Query(_split("label", True), _split_sql("PARTITION BY label", True)),
    "class_weights": Query(
        _weights,
        f"""WITH c AS (SELECT event_type, count(*) AS k FROM events GROUP BY event_type)
SELECT event_id, e.event_type, {r('(SELECT sum(k) FROM c) / ((SELECT count(*) FROM c) * CAST(k AS DOUBLE))')} AS weight
FROM events e JOIN c ON e.event_type = c.event_type""",
    ),
    "union_window_sets": Query(
        _union_sets,
        f"""WITH {US}, w AS (SELECT series_id, unnest(range(0, n - 19, 10)) AS s FROM us WHERE seq = 0 AND n >= 20)
SELECT w.series_id, CAST(w.s // 10 AS BIGINT) AS window_id, CAST(CAST(w.series_id AS BIGINT) % 2 AS INTEGER) AS label, {r('sum(value)')} AS total
FROM w JOIN us ON us.series_id = w.series_id AND us.seq BETWEEN w.s AND w.s + 19 GROUP BY w.series_id, w.s""",
    ),
    "per_column": Query(
        _per_column, f"WITH {EM} SELECT series_id, seq, " + ", ".join(f"{r(f'sqrt(abs({a}))')} AS {a}_root" for a in AXES) + " FROM em"
    ),
    "per_series": Query(
        _per_series,
        f"""WITH {US}, d AS (SELECT series_id, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY seq)) AS d FROM us)
SELECT series_id, count(*) AS rows, {r('coalesce(sum(d), 0)')} AS path FROM d GROUP BY series_id""",
    ),
}
