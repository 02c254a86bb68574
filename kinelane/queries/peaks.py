"""Peak and repetition queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.operators.peaks import consensus_repetitions, count_peaks, find_peaks, local_maxima, windowed_peaks
from kinelane.queries import Query
from kinelane.queries.common import EM, EV, US, r
from kinelane.queries.frames import savgol_sql
from kinelane.schema import AXES, SEQ, SERIES
from kinelane.sources.recordings import embedding_series, event_series


def maxima_sql(source: str, column: str = "value", name: str = "pk", where: str = "true") -> str:
    """Runs of equal samples that are higher than the run before and the run after."""
    return f"""
{name}_c AS (SELECT *, CASE WHEN {column} = lag({column}) OVER (PARTITION BY series_id ORDER BY seq) THEN 0 ELSE 1 END AS changed FROM {source}),
{name}_i AS (SELECT *, sum(changed) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM {name}_c),
{name}_g AS (SELECT series_id, island, min(seq) AS lo, max(seq) AS hi, any_value({column}) AS v FROM {name}_i GROUP BY series_id, island),
{name}_n AS (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY island) AS pv, lead(v) OVER (PARTITION BY series_id ORDER BY island) AS nv FROM {name}_g),
{name} AS (SELECT series_id, CAST((lo + hi) // 2 AS BIGINT) AS seq, lo, hi, v FROM {name}_n WHERE pv < v AND nv < v AND ({where}))"""


def distance_sql(peaks: str, distance: int) -> str:
    """Rounds of: drop what is near a kept peak, keep what is highest among the undecided near it."""
    near = f"(PARTITION BY series_id ORDER BY seq RANGE BETWEEN {distance - 1} PRECEDING AND {distance - 1} FOLLOWING)"
    return f"""
ranked AS (SELECT series_id, seq, v, row_number() OVER (PARTITION BY series_id ORDER BY v, seq) AS pr FROM {peaks}),
st AS (
  SELECT 0 AS round, series_id, seq, v, pr, 0 AS state FROM ranked
  UNION ALL
  SELECT round + 1, series_id, seq, v, pr,
         CASE WHEN state <> 0 THEN state WHEN kept_near > 0 THEN 2 WHEN pr = best_near THEN 1 ELSE 0 END
  FROM (SELECT *, count(*) FILTER (state = 0) OVER () AS undecided,
               count(*) FILTER (state = 1) OVER {near} AS kept_near,
               max(CASE WHEN state = 0 THEN pr END) OVER {near} AS best_near FROM st) q
  WHERE undecided > 0),
kept AS (SELECT series_id, seq, v FROM st WHERE state = 1 AND round = (SELECT max(round) FROM st))"""


def prominence_sql(source: str, peaks: str, column: str = "value") -> str:
    return f"""
lefts AS (SELECT p.series_id, p.seq, max(y.seq) AS at FROM {peaks} p LEFT JOIN {source} y
          ON y.series_id = p.series_id AND y.seq < p.seq AND y.{column} > p.v GROUP BY p.series_id, p.seq),
rights AS (SELECT p.series_id, p.seq, min(y.seq) AS at FROM {peaks} p LEFT JOIN {source} y
          ON y.series_id = p.series_id AND y.seq > p.seq AND y.{column} > p.v GROUP BY p.series_id, p.seq),
lmin AS (SELECT b.series_id, b.seq, min(x.{column}) AS low FROM lefts b JOIN {source} x
         ON x.series_id = b.series_id AND x.seq <= b.seq AND x.seq > coalesce(b.at, -1) GROUP BY b.series_id, b.seq),
rmin AS (SELECT b.series_id, b.seq, min(x.{column}) AS low FROM rights b JOIN {source} x
         ON x.series_id = b.series_id AND x.seq >= b.seq AND x.seq < coalesce(b.at, 9223372036854775807) GROUP BY b.series_id, b.seq),
prom AS (SELECT p.series_id, p.seq, p.v, p.v - greatest(l.low, q.low) AS prominence
         FROM {peaks} p JOIN lmin l ON l.series_id = p.series_id AND l.seq = p.seq
         JOIN rmin q ON q.series_id = p.series_id AND q.seq = p.seq)"""


_LONG = " UNION ALL ".join(f"SELECT series_id || ':{a}' AS series_id, seq, n, {a} AS value FROM em" for a in AXES)
CONSENSUS_SQL = f"""
WITH {EM}, lg AS ({_LONG}), {savgol_sql(20, 'lg', 'value')},
sc AS (SELECT series_id, seq, coalesce((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 0.0) AS value
       FROM h WINDOW w AS (PARTITION BY series_id)),
{maxima_sql('sc')}, {prominence_sql('sc', 'pk')},
cnt AS (SELECT k.series_id, count(p.seq) AS peaks FROM (SELECT DISTINCT series_id FROM sc) k
        LEFT JOIN (SELECT * FROM prom WHERE prominence >= 0.4) p ON p.series_id = k.series_id GROUP BY k.series_id),
sp AS (SELECT split_part(series_id, ':', 1) AS series_id, split_part(series_id, ':', 2) AS axis, peaks FROM cnt)
SELECT series_id, {', '.join(f"max(CASE WHEN axis = '{a}' THEN peaks END) AS peaks_{a}" for a in AXES)},
       CAST(round_even(median(peaks), 0) AS INTEGER) AS repetitions
FROM sp GROUP BY series_id"""


def _repetitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_series(spark, folder, "user_id")
    return count_peaks(rows, find_peaks(rows, "value", height=50.0, distance=10))


def _windowed(spark: SparkSession, folder: str) -> DataFrame:
    out = windowed_peaks(event_series(spark, folder), "value", 50, height=80.0)
    return out.groupBy(SERIES, "start").agg(F.count("*").alias("peaks"), F.sum(SEQ).alias("positions"))


QUERIES = {
    "peaks_all": Query(
        lambda s, d: local_maxima(event_series(s, d), "value").select(SERIES, SEQ, "left", "right", "value"),
        f'WITH {EV}, {maxima_sql("ev")} SELECT series_id, seq, lo AS "left", hi AS "right", v AS value FROM pk',
    ),
    "peaks_height": Query(
        lambda s, d: find_peaks(event_series(s, d), "value", height=50.0).select(SERIES, SEQ, "value"),
        f"WITH {EV}, {maxima_sql('ev', where='v >= 50')} SELECT series_id, seq, v AS value FROM pk",
    ),
    "peaks_distance": Query(
        lambda s, d: find_peaks(event_series(s, d), "value", height=0.5, distance=100).select(SERIES, SEQ, "value"),
        f"WITH RECURSIVE {EV}, {maxima_sql('ev', where='v >= 0.5')}, {distance_sql('pk', 100)} SELECT series_id, seq, v AS value FROM kept",
    ),
    "peaks_prominence": Query(
        lambda s, d: find_peaks(event_series(s, d), "value", prominence=40.0).select(
            SERIES, SEQ, "value", F.round("prominence", 6).alias("prominence")
        ),
        f"""WITH {EV}, {maxima_sql('ev')}, {prominence_sql('ev', 'pk')}
SELECT series_id, seq, v AS value, {r('prominence')} AS prominence FROM prom WHERE prominence >= 40.0""",
    ),
    "peaks_windowed": Query(
        _windowed,
        f"""WITH {EV}, {maxima_sql('ev', where='v >= 80')}, z AS (SELECT DISTINCT series_id, n FROM ev),
x AS (SELECT pk.series_id, pk.seq, unnest(generate_series(greatest(hi - 48, 0), least(lo - 1, n - 50))) AS start
      FROM pk JOIN z ON z.series_id = pk.series_id)
SELECT series_id, start, count(*) AS peaks, CAST(sum(seq) AS BIGINT) AS positions FROM x GROUP BY series_id, start""",
    ),
    "rep_count": Query(
        _repetitions,
        f"""WITH RECURSIVE {US}, {maxima_sql('us', where='v >= 50')}, {distance_sql('pk', 10)}
SELECT s.series_id, count(k.seq) AS peaks FROM (SELECT DISTINCT series_id FROM us) s
LEFT JOIN kept k ON k.series_id = s.series_id GROUP BY s.series_id""",
    ),
    "rep_consensus": Query(lambda s, d: consensus_repetitions(embedding_series(s, d), AXES, width=20), CONSENSUS_SQL),
}
