"""Scaling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinelane.operators.scaling import (
    apply_minmax,
    apply_standard,
    fit_minmax,
    fit_standard,
    inverse,
    minmax_series,
    standardise_series,
)
from kinelane.operators.learning import series_means
from kinelane.queries import Query
from kinelane.queries.common import EM, EV, US, r, rounded
from kinelane.schema import AXES, SEQ, SERIES
from kinelane.sources.recordings import embedding_series, event_series

KEYS = [SERIES, SEQ]
SCALED = [f"{a}_scaled" for a in AXES]


def _global(spark: SparkSession, folder: str) -> DataFrame:
    rows = embedding_series(spark, folder)
    return rounded(apply_minmax(rows, fit_minmax(rows, AXES), AXES), KEYS, SCALED)


def _inverse(spark: SparkSession, folder: str) -> DataFrame:
    scaled = standardise_series(event_series(spark, folder), ["value"], keep=True)
    return rounded(inverse(scaled, ["value"]), KEYS, ["value_back"])


def _means(spark: SparkSession, folder: str) -> DataFrame:
    means = series_means(embedding_series(spark, folder), AXES)
    return rounded(apply_standard(means, fit_standard(means, AXES), AXES), [SERIES], [f"{a}_trans" for a in AXES])


QUERIES = {
    "minmax_series": Query(
        lambda s, d: rounded(minmax_series(event_series(s, d, "user_id"), ["value"]), KEYS, ["value_scaled"]),
        f"""WITH {US} SELECT series_id, seq,
{r('coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.0)')} AS value_scaled
FROM us WINDOW w AS (PARTITION BY series_id)""",
    ),
    "minmax_global": Query(
        _global,
        f"WITH {EM} SELECT series_id, seq, "
        + ", ".join(f"{r(f'({a} - min({a}) OVER ()) / (max({a}) OVER () - min({a}) OVER ())')} AS {a}_scaled" for a in AXES)
        + " FROM em",
    ),
    "minmax_parameters": Query(
        lambda s, d: fit_minmax(embedding_series(s, d), AXES),
        f"WITH {EM} " + " UNION ALL ".join(f"SELECT '{a}' AS \"column\", min({a}) AS min, max({a}) AS max FROM em" for a in AXES),
    ),
    "standardise": Query(
        lambda s, d: rounded(standardise_series(event_series(s, d), ["value"]), KEYS, ["value_trans"]),
        f"""WITH {EV} SELECT series_id, seq,
{r('(value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1)')} AS value_trans
FROM ev WINDOW w AS (PARTITION BY series_id)""",
    ),
    "inverse_scale": Query(_inverse, f"WITH {EV} SELECT series_id, seq, {r('value')} AS value_back FROM ev"),
    "standardise_means": Query(
        _means,
        f"WITH {EM}, m AS (SELECT series_id, {', '.join(f'avg({a}) AS {a}' for a in AXES)} FROM em GROUP BY series_id) SELECT series_id, "
        + ", ".join(f"{r(f'({a} - avg({a}) OVER ()) / stddev_pop({a}) OVER ()')} AS {a}_trans" for a in AXES)
        + " FROM m",
    ),
}
