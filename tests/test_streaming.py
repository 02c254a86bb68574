"""Stream results equal batch results whatever the micro-batches."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from kinelane.operators.lanes import Lanes
from kinelane.operators.windows import sliding_windows
from kinelane.plans.pipelines import watch
from kinelane.streaming.live import _with_newest, count_windows, followed_feed, pointed_feed, to_table
from kinelane.functions.windows_udtf import register_window_starts
from series import frame

VALUES = {"a": np.arange(230.0), "b": np.arange(95.0) * 2, "c": np.arange(9.0)}


def _feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        rows.to_parquet(folder / f"{i:03d}.parquet")
    return spark.readStream.schema("series_id string, seq long, x double").option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("seed", [0, 1])
def test_count_windows_from_any_batches(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = pd.concat([pd.DataFrame({"series_id": k, "seq": np.arange(len(v)), "x": v}) for k, v in VALUES.items()])
    shuffled = rows.sample(frac=1, random_state=seed)
    cuts = np.sort(rng.integers(0, len(rows), 3))
    batches = [shuffled.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    batches.append(rows.head(120))  # a document sent again
    feed = _feed(spark, tmp_path, [b for b in batches if len(b)])
    got = to_table(count_windows(feed, ["x"], 20, 7, Lanes(rows=50)), "t", empty_batches=False).toPandas()
    want = sliding_windows(frame(spark, VALUES), ["x"], 20, 7).toPandas()

    def key(df):
        return sorted((r.series_id, int(r.window_id), int(r.start), tuple(f[0] for f in r.features)) for r in df.itertuples())

    assert key(got) == key(want)


def test_count_windows_forget_what_is_idle(spark, tmp_path):
    """A document sent again is ignored inside the term and new after it; a gap holds up the windows over it only."""
    rows = pd.DataFrame({"series_id": "a", "seq": np.arange(60), "x": np.arange(60.0)})
    feed = _feed(spark, tmp_path, [rows[rows.seq != 30], rows.head(20)])

    def later():
        time.sleep(4)
        rows.head(25).to_parquet(tmp_path / "900.parquet")

    got = to_table(count_windows(feed, ["x"], 10, 5, Lanes(rows=40), timedelta(seconds=3)), "t", then=later, empty_batches=False).toPandas()
    starts = sorted(got.start.tolist())
    assert starts == sorted([0, 5, 10, 15, 20, 35, 40, 45, 50] + [0, 5, 10, 15])
    assert all(f[0][0] == s and f[-1][0] == s + 9 for s, f in zip(got.start, got.features))


def test_feed_follows_the_newest_session(spark, tmp_path):
    """A session that comes while the stream runs switches the feed; integers above 2**53 and nulls pass unchanged."""
    day = datetime(2024, 1, 1)
    at = [day + timedelta(seconds=i) for i in range(40)]
    for name in ("rows", "sessions"):
        (tmp_path / name).mkdir()

    def rows(part):
        many = [(k, at[i], (1 << 60) + i, None if i % 3 else float(i)) for i in part for k in "abc"]
        return spark.createDataFrame(many, "series_id string, ts timestamp, id long, x double")

    def send(df, name):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    sessions = "document_id string, updated_at timestamp"
    send(rows(range(20)), "rows")
    send(spark.createDataFrame([("a", at[3]), ("b", at[10]), ("c", None), (None, at[12])], sessions), "sessions")

    def later():
        send(spark.createDataFrame([("c", at[25]), ("a", at[25]), ("a", at[35])], sessions), "sessions")
        send(rows(range(20, 40)), "rows")

    feed = spark.readStream.schema("series_id string, ts timestamp, id long, x double").parquet(str(tmp_path / "rows"))
    news = spark.readStream.schema(sessions).parquet(str(tmp_path / "sessions"))
    got = to_table(followed_feed(feed, news, slots=3, late="5 seconds"), "t", then=later).collect()
    want = {(k, i) for k, part in (("a", range(3, 10)), ("b", range(10, 25)), ("c", range(25, 35)), ("a", range(35, 40))) for i in part}
    assert {(r.series_id, r.id - (1 << 60)) for r in got} == want and len(got) == len(want)
    assert all(r.x == (None if (r.id - (1 << 60)) % 3 else float(r.id - (1 << 60))) for r in got)


def test_sessions_are_not_copied_to_every_slot(spark, tmp_path):
    """What the sessions become grows with them, not with the slots; spans of all sizes follow the same pointers."""
    rng = np.random.default_rng(6)
    day = datetime(2024, 1, 1)
    many = [("abc"[k], day + timedelta(seconds=int(t)), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 9000, 900)))]
    points = [("abc"[k], day + timedelta(seconds=int(t))) for k, t in zip(rng.integers(0, 3, 200), rng.integers(3000, 7000, 200))]
    spark.createDataFrame(many, "series_id string, ts timestamp, id long").repartition(3).write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame(points, "document_id string, updated_at timestamp").repartition(2).write.parquet(str(tmp_path / "sessions"))
    feed = spark.readStream.schema("series_id string, ts timestamp, id long").parquet(str(tmp_path / "rows"))
    news = spark.readStream.schema("document_id string, updated_at timestamp").parquet(str(tmp_path / "sessions"))
    want = []
    for k, t, i in many:
        before = [(u, d) for d, u in points if u <= t]
        if before and max(before)[1] == k:
            want.append(i)
    for seconds in (7, 600, 100_000):
        got = to_table(followed_feed(feed, news, slots=16, span=timedelta(seconds=seconds)), f"t{seconds}").collect()
        assert sorted(r.id for r in got) == sorted(want), seconds
    made = []
    sent = pa.RecordBatch.from_pydict({"at": np.arange(1000), "name": ["a"] * 1000})
    for batch in _with_newest(100)(iter([sent])):
        made += batch.column("_last").to_pylist()
    assert made.count(False) == 1000 and made.count(True) == 10


def test_watch_hands_messages_to_the_action(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from kinelane.operators.scaling import apply_minmax, fit_minmax

    rows = frame(spark, VALUES)
    scaler = fit_minmax(rows, ["x"])
    train = apply_minmax(rows, scaler, ["x"]).selectExpr("*", "CAST(x > 100 AS INT) AS label")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x_scaled"], outputCol="features"), LogisticRegression()]).fit(train)
    (tmp_path / "in").mkdir()
    pdf = pd.concat([pd.DataFrame({"series_id": k, "seq": np.arange(len(v)), "x": v}) for k, v in VALUES.items()])
    feed = _feed(spark, tmp_path / "in", [pdf])
    pointer = spark.createDataFrame([("a",)], "document_id string")
    seen = {}

    def action(batch, _):
        for r in batch.groupBy("series_id", "message").count().collect():
            seen[(r.series_id, r.message)] = r["count"]

    watch(feed, pointer, scaler, model, ["x"], action, str(tmp_path / "ck")).awaitTermination()
    assert set(k for k, _ in seen) == {"a"} and sum(seen.values()) == 230
    assert seen[("a", "Movimiento detectado")] > 100 and seen[("a", "No hay movimiento")] > 50


def test_pointed_feed_without_a_session(spark):
    rows = frame(spark, VALUES)
    nobody = spark.createDataFrame([], "document_id string")
    assert pointed_feed(rows, nobody).count() == 0


def test_window_starts_in_sql(spark):
    register_window_starts(spark)
    got = [(r.window_id, r.start) for r in spark.sql("SELECT * FROM window_starts(35, 20, 7)").collect()]
    assert got == [(0, 0), (1, 7), (2, 14)]
