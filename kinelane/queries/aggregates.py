"""Aggregation, evaluation and verdict queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.functions.signal import magnitude, threshold
from kinelane.functions.text import CLASS_NAMES, RULE_C, label
from kinelane.operators.frames import moving_average
from kinelane.operators.lanes import short_series
from kinelane.operators.learning import series_means, silhouette
from kinelane.operators.metrics import (
    binary_evaluation,
    classification_report,
    confusion_cells,
    confusion_matrix,
    regression_metrics,
)
from kinelane.operators.quantiles import describe
from kinelane.operators.verdicts import majority_vote, mean_probability, mean_vector, pointed_document
from kinelane.operators.windows import sequence_targets, shift_ahead
from kinelane.queries import Query
from kinelane.queries.common import EM, EV, US, r, rounded
from kinelane.schema import AXES, SEQ, SERIES
from kinelane.session import ensure_checkpoints
from kinelane.sources.recordings import embedding_series, event_series, table

TRUTH = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END"
GUESS = "CASE WHEN value < 20 THEN 0 WHEN value < 50 THEN 1 WHEN value < 80 THEN 2 ELSE 4 END"


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Four true classes by event type against five predicted ones by value; class 3 is never predicted."""
    return table(spark, folder, "events").select(F.expr(TRUTH).alias("label"), F.expr(GUESS).alias("prediction"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


def _report(df: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    return rounded(classification_report(df, names=names), ["name", "support"], ["precision", "recall", "f1"])


def report_sql(source: str) -> str:
    def ratio(a: str, b: str) -> str:
        return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"

    return f"""
k AS (SELECT label AS k FROM {source} UNION SELECT prediction FROM {source}),
t AS (SELECT k, (SELECT count(*) FROM {source} WHERE label = k) AS support,
        (SELECT count(*) FROM {source} WHERE prediction = k) AS claimed,
        (SELECT count(*) FROM {source} WHERE prediction = k AND label = k) AS hits FROM k),
p AS (SELECT *, {ratio('hits', 'claimed')} AS p, {ratio('hits', 'support')} AS q FROM t),
f AS (SELECT *, {ratio('2 * p * q', 'p + q')} AS f FROM p),
rep AS (
  SELECT CAST(k AS VARCHAR) AS name, p, q, f, support FROM f
  UNION ALL SELECT 'accuracy', sum(hits) * 1.0 / sum(support), sum(hits) * 1.0 / sum(support), sum(hits) * 1.0 / sum(support), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(q * support) / sum(support), sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)
SELECT name, {r('p')} AS precision, {r('q')} AS recall, {r('f')} AS f1, support FROM rep"""


def _describe(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics per class of the name on both magnitudes of the smoothed axes.

    Recordings are users; names and the axes (multiples of the value) stand for the files' ones.
    """
    rows = event_series(spark, folder, "user_id")
    axes = {a: F.col("value") * (i + 1) for i, a in enumerate(AXES)}
    made = moving_average(rows.withColumns(axes), AXES, 5, suffix="")
    made = made.withColumns({"acc_magnitude": magnitude(*AXES[:3]), "gyro_magnitude": magnitude(*AXES[3:])})
    named = made.withColumn("class", label(F.expr(USER_NAME), RULE_C)).filter(F.col("class").isNotNull())
    ensure_checkpoints(spark)  # written down, since statistics are two passes
    named = named.select("class", "acc_magnitude", "gyro_magnitude").checkpoint(eager=True)
    out = describe(named, ["class"], ["acc_magnitude", "gyro_magnitude"])
    return rounded(out, ["class", "column", "count"], ["mean", "std", "min", "p10", "p25", "p50", "p75", "p90", "max"])


# A recording's name, from its user; one in four has no known class.
USER_NAME = """CASE CAST(series_id AS INTEGER) % 4 WHEN 0 THEN 'Flexion_cuello_' WHEN 1 THEN 'extension_cuello_'
  WHEN 2 THEN 'IDLE_cuello_' ELSE 'otro_' END || series_id"""
_DESCRIBE = ", ".join(
    ["count(x) AS count", f"{r('avg(x)')} AS mean", f"{r('stddev_samp(x)')} AS std", f"{r('min(x)')} AS min"]
    + [f"{r(f'quantile_cont(x, {p / 100})')} AS p{p}" for p in (10, 25, 50, 75, 90)]
    + [f"{r('max(x)')} AS max"]
)


def _forecast_error(spark: SparkSession, folder: str) -> DataFrame:
    """Persistence forecast: each value predicts the next one."""
    rows = shift_ahead(event_series(spark, folder), "value", 1, "next")
    out = regression_metrics(rows, "next", "value")
    return rounded(out, ["n"], ["mae", "huber", "mape"], 4)


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select((F.col("value") > 50).cast("int").alias("label"), (F.col("user_id") % 101 / 100.0).alias("p"))
    return rounded(binary_evaluation(rows, "label", "p"), ["n"], ["accuracy", "loss"])


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return event_series(spark, folder, "user_id").withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp((F.lit(50.0) - F.col("value")) / 20.0)))


def _verdict_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mean_probability(_scores(spark, folder)), [SERIES, "windows", "class"], ["score"])


def _verdict_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Six numbers stand for class scores; four of them are used."""
    rows = embedding_series(spark, folder).withColumn("probs", F.array(*AXES[:4]))
    out = mean_vector(rows, "probs", 4)
    return rounded(out, [SERIES, "class", "class_name"], ["p0", "p1", "p2", "p3", "score"])


def _vote(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_series(spark, folder, "user_id").withColumn("prediction", (F.floor("value") % 5).cast("int"))
    return majority_vote(rows)


def _pointer(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event stands for the live session and points at its user's document."""
    events = table(spark, folder, "events")
    sessions = events.select(F.col("user_id").alias("document_id"), F.col("ts").alias("updated_at"))
    docs = events.select(F.col("user_id").alias("doc_id"), "event_id", "value")
    return pointed_document(docs, sessions).select("doc_id", "event_id", "value")


def _short(spark: SparkSession, folder: str) -> DataFrame:
    """Series that a window of 60 rejects."""
    return short_series(event_series(spark, folder, "user_id"), 60)


def _evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """Hold-out report of a threshold on the mean of the last 12 samples against the sample that follows."""
    rows = event_series(spark, folder, "user_id").withColumn("label", (F.col("value") > 50).cast("int"))
    pairs = sequence_targets(rows, ["value"], "label", 12, trim_tail=True)
    mean = F.aggregate("features", F.lit(0.0), lambda a, v: a + v[0]) / 12.0
    scored = pairs.select(F.col("target").alias("label"), threshold(mean, 50.0).alias("prediction"))
    return _report(scored)


def _silhouette(spark: SparkSession, folder: str) -> DataFrame:
    rows = embedding_series(spark, folder).withColumn("cluster", F.col("label") % 3)
    return rounded(silhouette(rows, AXES), ["points"], ["silhouette"])


_DIST = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in AXES)
SILHOUETTE_SQL = f"""
WITH {EM}, q AS (SELECT *, label % 3 AS c FROM em),
d AS (SELECT a.vec_id, a.c, b.c AS o, sum({_DIST}) AS t, count(*) AS k FROM q a, q b GROUP BY a.vec_id, a.c, b.c),
s AS (SELECT vec_id, max(CASE WHEN c = o THEN t / nullif(k - 1, 0) END) AS a, max(CASE WHEN c = o THEN k END) AS own,
        min(CASE WHEN c <> o THEN t / k END) AS b FROM d GROUP BY vec_id)
SELECT {r('avg(CASE WHEN own = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END)')} AS silhouette, count(*) AS points FROM s"""

J = f"j AS (SELECT {TRUTH} AS label, {GUESS} AS prediction FROM events)"
Q = "q AS (SELECT quality AS label, toxic AS prediction FROM labels)"
QUERIES = {
    "series_means": Query(
        lambda s, d: rounded(series_means(embedding_series(s, d), AXES), [SERIES], AXES),
        f"WITH {EM} SELECT series_id, {', '.join(f'{r(f'avg({a})')} AS {a}' for a in AXES)} FROM em GROUP BY series_id",
    ),
    "class_describe": Query(
        _describe,
        f"""WITH {US}, m AS (SELECT series_id, n, sum(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS v FROM us),
k AS (SELECT CASE CAST(series_id AS INTEGER) % 4 WHEN 0 THEN 'Flexion' WHEN 1 THEN 'Extension' WHEN 2 THEN 'Idle' END AS class, v FROM m WHERE n >= 5),
l AS (SELECT class, 'acc_magnitude' AS "column", sqrt(v * v + 2 * v * 2 * v + 3 * v * 3 * v) AS x FROM k WHERE class IS NOT NULL
  UNION ALL SELECT class, 'gyro_magnitude', sqrt(4 * v * 4 * v + 5 * v * 5 * v + 6 * v * 6 * v) FROM k WHERE class IS NOT NULL)
SELECT class, "column", {_DESCRIBE} FROM l GROUP BY class, "column" """,
    ),
    "confusion": Query(
        lambda s, d: confusion_cells(judged(s, d)),
        f"""WITH {J}, k AS (SELECT label AS k FROM j UNION SELECT prediction FROM j)
SELECT a.k AS label, b.k AS prediction, (SELECT count(*) FROM j WHERE label = a.k AND prediction = b.k) AS count FROM k a, k b""",
    ),
    "confusion_matrix": Query(
        lambda s, d: confusion_matrix(_quality(s, d), [0, 1]),
        f"""WITH {Q} SELECT label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1
FROM q GROUP BY label""",
    ),
    "class_report": Query(lambda s, d: _report(judged(s, d)), f"WITH {J}, {report_sql('j')}"),
    "class_report_named": Query(
        lambda s, d: _report(judged(s, d), CLASS_NAMES),
        f"WITH {J}, {report_sql('j')}".replace(
            "SELECT name, (round(p",
            "SELECT CASE name WHEN '0' THEN 'Flexión' WHEN '1' THEN 'Extensión' WHEN '2' THEN 'Idle' WHEN '3' THEN 'Flex baja' ELSE name END AS name, (round(p",
        ),
    ),
    "class_report_binary": Query(lambda s, d: _report(_quality(s, d)), f"WITH {Q}, {report_sql('q')}"),
    "regression_metrics": Query(
        _forecast_error,
        f"""WITH {EV}, e AS (SELECT b.value AS y, b.value - a.value AS e FROM ev a JOIN ev b ON a.series_id = b.series_id AND b.seq = a.seq + 1)
SELECT count(*) AS n, {r('avg(abs(e))', 4)} AS mae,
  {r('avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END)', 4)} AS huber, {r('avg(abs(e / nullif(y, 0))) * 100', 4)} AS mape FROM e""",
    ),
    "binary_evaluation": Query(
        _evaluation,
        f"""WITH e AS (SELECT CAST(value > 50 AS INTEGER) AS l, user_id % 101 / 100.0 AS p FROM events),
c AS (SELECT l, p, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM e)
SELECT count(*) AS n, {r('avg(CASE WHEN CAST(p > 0.5 AS INTEGER) = l THEN 1.0 ELSE 0.0 END)')} AS accuracy,
  {r('avg(CASE WHEN l = 1 THEN -ln(q) ELSE -ln(1 - q) END)')} AS loss FROM c""",
    ),
    "evaluate_threshold": Query(
        _evaluate,
        f"""WITH {US}, w AS (SELECT series_id, seq AS start FROM us WHERE seq + 24 <= n),
m AS (SELECT w.series_id, w.start, sum(x.value) / 12.0 AS m FROM w JOIN us x ON x.series_id = w.series_id AND x.seq BETWEEN w.start AND w.start + 11 GROUP BY ALL),
j AS (SELECT CAST(t.value > 50 AS INTEGER) AS label, CAST(m.m > 50 AS INTEGER) AS prediction
      FROM m JOIN us t ON t.series_id = m.series_id AND t.seq = m.start + 12), {report_sql('j')}""",
    ),
    "verdict_mean": Query(
        _verdict_mean,
        f"""WITH v AS (SELECT CAST(user_id AS VARCHAR) AS series_id, avg(1.0 / (1.0 + exp((50.0 - value) / 20.0))) AS s, count(*) AS windows FROM events GROUP BY user_id)
SELECT series_id, windows, CAST(s >= 0.5 AS INTEGER) AS class, {r('s')} AS score FROM v""",
    ),
    "verdict_vector": Query(
        _verdict_vector,
        f"""WITH {EM}, m AS (SELECT series_id, {', '.join(f'avg({a}) AS p{i}' for i, a in enumerate(AXES[:4]))} FROM em GROUP BY series_id),
k AS (SELECT *, greatest(p0, p1, p2, p3) AS b FROM m),
c AS (SELECT *, CASE WHEN p0 = b THEN 0 WHEN p1 = b THEN 1 WHEN p2 = b THEN 2 ELSE 3 END AS class FROM k)
SELECT series_id, class, CASE class WHEN 0 THEN 'Flexión' WHEN 1 THEN 'Extensión' WHEN 2 THEN 'Idle' ELSE 'Flex baja' END AS class_name,
  {', '.join(f'{r(f"p{i}")} AS p{i}' for i in range(4))}, {r('b')} AS score FROM c""",
    ),
    "verdict_majority": Query(
        _vote,
        f"""WITH {US}, c AS (SELECT series_id, CAST(floor(value) AS INTEGER) % 5 AS class, count(*) AS votes FROM us GROUP BY ALL)
SELECT series_id, class, votes FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY votes DESC, class) = 1""",
    ),
    "pointer_lookup": Query(
        _pointer,
        """SELECT user_id AS doc_id, event_id, value FROM events
WHERE user_id = (SELECT arg_max(user_id, ts) FROM events)""",
    ),
    "rejected_series": Query(
        _short,
        """SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS n, 'shorter than the window' AS reason
FROM events GROUP BY user_id HAVING count(*) < 60""",
    ),
    "series_sizes": Query(
        lambda s, d: event_series(s, d, "user_id").groupBy(SERIES).agg(F.count("*").alias("rows"), F.max(SEQ).alias("last")),
        "SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS rows, count(*) - 1 AS last FROM events GROUP BY user_id",
    ),
    "silhouette": Query(_silhouette, SILHOUETTE_SQL),
}
