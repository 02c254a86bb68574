"""Streaming queries: files as a stream, results in a table of the shared folder."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.operators.scaling import apply_minmax, fit_minmax
from kinelane.queries import Query
from kinelane.queries.common import EV, r
from kinelane.schema import SEQ, SERIES
from kinelane.sources.recordings import event_series, table
from kinelane.streaming.live import (
    MOVING,
    STILL,
    count_windows,
    detect_motion,
    followed_feed,
    motion_messages,
    time_windows,
    to_table,
    with_end,
)
from kinelane.session import work_path

FILE_ROWS = 1_000_000  # rows of a file of the written feed


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table as a file stream (the pattern keeps a single file or a folder of parts readable)."""
    schema = table(spark, folder, name).schema
    pattern = f"{folder}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(pattern)


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Signups as the sessions that point at a user's feed."""
    events = _stream(spark, folder, "events").filter("event_type = 'signup'")
    return events.select(F.col("user_id").alias("document_id"), F.col("ts").alias("updated_at"))


def _motion(spark: SparkSession, folder: str) -> DataFrame:
    """Live rows of the user whose session is newest, scaled with stored parameters and scored with a stored model.

    The model tells errors from other events by value and hour.
    """
    events = table(spark, folder, "events").withColumn("hour", F.hour("ts").cast("double"))
    params = fit_minmax(events, ["value", "hour"])
    train = apply_minmax(events, params, ["value", "hour"]).withColumn("label", (F.col("event_type") == "error").cast("int"))
    steps = [
        VectorAssembler(inputCols=["value_scaled", "hour_scaled"], outputCol="features"),
        LogisticRegression(labelCol="label", maxIter=100),
    ]
    model = Pipeline(stages=steps).fit(train)
    live = followed_feed(_stream(spark, folder, "events"), _sessions(spark, folder), key="user_id")
    live = live.withColumn("hour", F.hour("ts").cast("double"))
    scored = detect_motion(apply_minmax(live, params, ["value", "hour"]), model)
    return to_table(scored.select("user_id", "event_id", "message"), "stream-motion")


def _pointer(spark: SparkSession, folder: str) -> DataFrame:
    """Live rows of the user whose session is newest, scaled, with the message of a fixed limit in the model's place."""
    params = fit_minmax(table(spark, folder, "events"), ["value"])
    live = followed_feed(_stream(spark, folder, "events"), _sessions(spark, folder), key="user_id")
    scored = apply_minmax(live, params, ["value"]).withColumn("prediction", (F.col("value_scaled") > 0.25).cast("int"))
    return to_table(motion_messages(scored).select("user_id", "event_id", "message"), "stream-pointer")


def _count_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered recordings are written as a stream's input and cut into windows as they arrive."""
    source = work_path(spark, "stream-source")
    rows = event_series(spark, folder).select(SERIES, SEQ, "value")
    files = max(6, -(-rows.count() // FILE_ROWS))
    rows.repartitionByRange(files, SEQ).write.parquet(source)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    out = to_table(count_windows(feed, ["value"], 100, 10), "stream-windows", empty_batches=False)
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v[0])
    return out.select(
        SERIES, "window_id", "start", F.size("features").cast("long").alias("samples"), F.round(total, 6).alias("value_sum")
    )


def _time_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows every half hour: the 1 s / 100 ms windows of a live sensor at this table's pace.

    The feed is ended after its last row, so that the last windows go out as well.
    """
    feed = _stream(spark, folder, "events").select(
        F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    feed, end = with_end(feed, "ts")
    last = table(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    out = time_windows(feed, ["value"], width="1 hour", slide="30 minutes", late="10 minutes")
    made = to_table(out, "stream-time", then=lambda: end((last or datetime(2000, 1, 1)) + timedelta(hours=3)))
    return made.select(
        SERIES, F.unix_micros("start").alias("start_us"), "samples", F.round("value_mean", 5).alias("value_mean"), F.round("value_std", 5).alias("value_std")
    )


QUERIES = {
    "stream_motion": Query(_motion),
    "stream_pointer": Query(
        _pointer,
        f"""
WITH s AS (SELECT ts AS updated_at, max(CAST(user_id AS VARCHAR)) AS document_id FROM events WHERE event_type = 'signup' GROUP BY ts),
m AS (SELECT min(value) AS low, max(value) AS high FROM events)
SELECT e.user_id, e.event_id, CASE WHEN (e.value - m.low) / (m.high - m.low) > 0.25 THEN '{MOVING}' ELSE '{STILL}' END AS message
FROM events e ASOF JOIN s ON e.ts >= s.updated_at CROSS JOIN m WHERE CAST(e.user_id AS VARCHAR) = s.document_id""",
    ),
    "stream_count_windows": Query(
        _count_windows,
        f"""
WITH {EV}, w AS (SELECT series_id, seq AS start FROM ev WHERE seq % 10 = 0 AND seq + 100 <= n)
SELECT w.series_id, CAST(w.start // 10 AS BIGINT) AS window_id, w.start, count(*) AS samples, {r('sum(x.value)')} AS value_sum
FROM w JOIN ev x ON x.series_id = w.series_id AND x.seq BETWEEN w.start AND w.start + 99 GROUP BY w.series_id, w.start""",
    ),
    "stream_time_windows": Query(
        _time_windows,
        f"""
WITH x AS (SELECT event_type AS series_id, value, unnest([epoch_us(ts) // 1800000000 * 1800000000, epoch_us(ts) // 1800000000 * 1800000000 - 1800000000]) AS start_us FROM events)
SELECT series_id, CAST(start_us AS BIGINT) AS start_us, count(*) AS samples, {r('avg(value)', 5)} AS value_mean, {r('stddev_samp(value)', 5)} AS value_std
FROM x GROUP BY series_id, start_us""",
    ),
}
