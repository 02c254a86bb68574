"""Live feeds: session pointer, motion detection, count windows and time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from kinelane.operators.lanes import LANE, Lanes
from kinelane.schema import SEQ, SERIES
from kinelane.session import work_path

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
SHARES = 4  # state slots that share the rows of one span of time
MOVING, STILL = "Movimiento detectado", "No hay movimiento"  # fixed values


def pointed_feed(feed: DataFrame, pointer: DataFrame, key: str = SERIES, document: str = "document_id") -> DataFrame:
    """Rows of the live document only (stream-static join with a one-row pointer that does not change; see ``followed_feed``)."""
    return feed.join(F.broadcast(pointer.select(F.col(document).alias(key))), key, "inner")


def motion_messages(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return scored.withColumn("message", F.when(F.col(prediction) == 1, MOVING).otherwise(STILL))


def detect_motion(scaled: DataFrame, model: PipelineModel) -> DataFrame:
    """Predict each (scaled) snapshot row and name the outcome."""
    return motion_messages(model.transform(scaled))


def _pointed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose document the pointer named at their time; a slot's state holds the pointers that may still count."""
    held = [np.array(v, t) for v, t in zip(state.get, (np.int64, object))] if state.exists else [np.array([], np.int64), np.array([], object)]
    known, asked = [held], []
    for pdf in batches:
        points = pdf["_is_session"].to_numpy(bool)
        known.append([pdf["_at"].to_numpy(np.int64)[points], pdf["_document"].to_numpy(object)[points]])
        if not points.all():
            asked.append(pdf[~points])
    pointers = pd.DataFrame({"at": np.concatenate([k[0] for k in known]), "name": np.concatenate([k[1] for k in known])})
    # Of two at one time the greater name counts.
    pointers = pointers.sort_values(["at", "name"]).drop_duplicates("at", keep="last")
    if not len(pointers):
        return
    at, names = pointers["at"].to_numpy(), pointers["name"].to_numpy()
    # Rows before the watermark do not come any more: of the pointers up to it, the newest is enough.
    past = max(0, int(np.searchsorted(at, state.getCurrentWatermarkMs() * 1000, "right")) - 1)
    if not (np.array_equal(at[past:], held[0]) and np.array_equal(names[past:], held[1])):
        state.update((at[past:].tolist(), names[past:].tolist()))
    for pdf in asked:
        place = np.searchsorted(at, pdf["_at"].to_numpy(), "right") - 1
        live = (place >= 0) & (names[np.maximum(place, 0)] == pdf["_document"].to_numpy())
        if live.any():
            yield pdf.loc[live, ["_row"]]


def _with_newest(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sessions as they are, and after them the newest one of each span of time (of a task's rows) once more as ``_last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest: dict[int, tuple[int, str]] = {}
        for batch in batches:
            own = pd.DataFrame({"at": batch.column(0).to_numpy(), "name": batch.column(1).to_pandas()})
            yield pa.RecordBatch.from_pydict({"_at": batch.column(0), "_document": batch.column(1), "_last": np.zeros(len(own), bool)})
            last = own.assign(span=own["at"] // span).sort_values(["at", "name"]).drop_duplicates("span", keep="last")
            for s, *found in zip(last["span"].tolist(), last["at"].tolist(), last["name"].tolist()):
                newest[s] = max(newest.get(s, tuple(found)), tuple(found))
        found = list(newest.values())
        for i in range(0, len(found), 10_000):
            at, names = zip(*found[i : i + 10_000])
            yield pa.RecordBatch.from_pydict({"_at": pa.array(at, pa.int64()), "_document": pa.array(names, pa.string()), "_last": np.ones(len(at), bool)})

    return run


def followed_feed(
    feed: DataFrame,
    sessions: DataFrame,
    key: str = SERIES,
    ts: str = "ts",
    document: str = "document_id",
    updated: str = "updated_at",
    late: str = "10 minutes",
    slots: int = 64,
    span: timedelta = timedelta(minutes=10),
) -> DataFrame:
    """Rows of the document that the newest session named at their time; both sides are streams.

    A new session switches the feed while it runs. Rows are dealt to ``slots`` by their span of time and, inside a span, by
    hash, so a busy document is not one state key. A session goes to the slots of its own span; to all others goes the
    newest one of a span only, since no other of it can count after the span. A slot keeps the sessions after the
    watermark and the last one before it.
    A row is judged when it arrives, by the sessions known then: a session that comes after its rows changes none of
    them. Rows and sessions later than ``late`` are dropped, as are rows without time or document. Of sessions of one time
    the greater name counts.
    """
    row = F.array(F.struct(*feed.columns))  # as a list, since pandas would make integers beside nulls floats
    micros = max(1, span // timedelta(microseconds=1))
    share = min(SHARES, slots)  # slots of one span
    turns = max(1, slots // share)
    turn = lambda at: F.pmod(F.floor(at / F.lit(micros)), F.lit(turns)).cast("int") * share
    time, named = F.col(ts).cast("timestamp"), F.col(key).cast("string")
    slot = turn(F.unix_micros(time)) + F.pmod(F.xxhash64(key, ts), F.lit(share)).cast("int")
    rows = feed.filter(time.isNotNull() & named.isNotNull()).select(
        slot.alias("_slot"), time.alias("_time"), named.alias("_document"), row.alias("_row"), F.lit(False).alias("_is_session")
    )
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    sent = sessions.filter(F.col(updated).isNotNull() & F.col(document).isNotNull()).select(
        F.unix_micros(F.col(updated).cast("timestamp")).alias("_at"), F.col(document).cast("string").alias("_document")
    )
    sent = sent.mapInArrow(_with_newest(micros), "_at long, _document string, _last boolean")
    own, every = (F.array(*[F.lit(i) for i in range(n)]) for n in (share, turns * share))
    to = F.when(F.col("_last"), every).otherwise(F.transform(own, lambda i: turn(F.col("_at")) + i))
    points = sent.select(
        F.explode(to).alias("_slot"), F.timestamp_micros("_at").alias("_time"), "_document", none.alias("_row"), F.lit(True).alias("_is_session")
    )
    both = rows.unionByName(points).withWatermark("_time", late).withColumn("_at", F.unix_micros("_time"))
    schema = StructType([StructField("_row", rows.schema["_row"].dataType)])
    live = both.groupBy("_slot").applyInPandasWithState(
        _pointed, schema, "at array<bigint>, document array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return live.select(F.col("_row")[0].alias("_row")).select("_row.*")


def count_windows(
    stream: DataFrame,
    columns: Sequence[str],
    width: int,
    step: int,
    lanes: Lanes = Lanes(rows=1000),
    term: timedelta = timedelta(hours=1),
) -> DataFrame:
    """Full windows of ``width`` samples every ``step`` samples, as soon as all their samples are there.

    State is kept per lane, not per series: a row goes to every lane whose windows may need it, so one busy series is
    spread over the cluster. A lane holds the samples of its open windows, at most its own rows plus ``width - 1``, and
    which windows are out; when its last window is out the samples go at once. A lane for which nothing comes for ``term``
    of processing time is forgotten, whether finished or idle. So a document that is sent again is ignored inside the term,
    and taken as a new one after it. A sample that is missing holds up the windows over it only. Null samples are NaN.
    """
    keys, seq, columns = list(lanes.keys), lanes.seq, list(columns)
    rows, size, patience = lanes.rows, len(columns), max(1, round(term.total_seconds() * 1000))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end = (int(key[-1]) + 1) * rows
        starts = np.arange(-(-(end - rows) // step) * step, end, step, dtype=np.int64)
        now, fresh = state.getCurrentProcessingTimeMs(), (end - rows, [], [], [], None)
        since, later, at, flat, until = state.get if state.exists else fresh
        if until is not None and until < now:  # rows came in the same batch as the end of the term
            since, later, at, flat, _ = fresh
        done = (starts < since) | np.isin(starts, np.array(later, np.int64))
        places, values = [np.array(at, np.int64)], [np.array(flat, float).reshape(-1, size)]
        for pdf in batches:
            places.append(pdf[seq].to_numpy(np.int64))
            values.append(pdf[columns].to_numpy(float))
        at, came = np.unique(np.concatenate(places), return_index=True)  # of a position the sample that came first
        samples = np.concatenate(values)[came]
        left = np.searchsorted(at, starts)
        right = left + width - 1
        # Positions are distinct and sorted: a window is full if its ends are width - 1 places apart.
        full = ~done & (right < len(at))
        full[full] &= (at[left[full]] == starts[full]) & (at[right[full]] == starts[full] + width - 1)
        ready = np.flatnonzero(full)
        open_starts = starts[~(done | full)]
        since = int(open_starts[0]) if len(open_starts) else end
        before = np.searchsorted(open_starts, at, "right") - 1
        needed = before >= 0
        needed[needed] = open_starts[before[needed]] > at[needed] - width
        later = starts[(done | full) & (starts > since)].tolist()
        state.update((since, later, at[needed].tolist(), samples[needed].ravel().tolist(), now + patience))
        state.setTimeoutDuration(patience)
        if len(ready):
            named = {k: [v] * len(ready) for k, v in zip(keys, key)}
            features = [samples[left[i] : left[i] + width].tolist() for i in ready]
            yield pd.DataFrame({**named, "window_id": starts[ready] // step, "start": starts[ready], "features": features})

    types = dict(stream.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    spread = lanes.spread(stream, 0, width - 1).select(*keys, LANE, F.col(seq).cast("long").alias(seq), *columns)
    return spread.groupBy(*lanes.group).applyInPandasWithState(
        advance,
        f"{named}, window_id bigint, start bigint, features array<array<double>>",
        "start bigint, later array<bigint>, at array<bigint>, vals array<double>, until bigint",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def time_windows(
    stream: DataFrame,
    columns: Sequence[str],
    ts: str = "ts",
    width: str = "1 second",
    slide: str = "100 milliseconds",
    late: str = "10 seconds",
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Mean and sample deviation per event-time window; rows later than ``late`` are dropped."""
    made = [f(c).alias(f"{c}_{s}") for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, width, slide).alias("w"), *keys)
        .agg(F.count("*").alias("samples"), *made)
    )
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in ("w", *keys)])


def with_end(stream: DataFrame, ts: str) -> tuple[DataFrame, Callable[[datetime], None]]:
    """A feed that can be ended, and the function that ends it.

    A window goes out once the watermark has passed its end, so the last ones of a finished feed would stay open. The
    end is a row without key at the given time, read from a source of its own after all others.
    """
    spark, path = stream.sparkSession, work_path(stream.sparkSession, "stream-end")
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(path)

    def end(at: datetime) -> None:
        row = tuple(at if f.name == ts else None for f in schema)
        spark.createDataFrame([row], StructType([StructField(f.name, f.dataType) for f in schema])).coalesce(1).write.mode("append").parquet(path)

    return stream.unionByName(spark.readStream.schema(schema).parquet(path)), end


def to_table(
    stream: DataFrame, name: str, mode: str = "append", then: Callable[[], None] | None = None, empty_batches: bool = True
) -> DataFrame:
    """Run a stream over all available input into a table in the shared folder and read it back.

    ``then`` is called when the input is used up, and the stream goes on from there with what came meanwhile. State that
    ends by the clock (``count_windows``) asks for one more batch for ever; without ``empty_batches`` the run ends with
    the input.
    """
    spark = stream.sparkSession
    path = work_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
    )
    usual = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, str(empty_batches and usual == "true").lower())
    try:
        writer.start().awaitTermination()
        if then is not None:
            then()
            writer.start().awaitTermination()
    finally:
        spark.conf.set(EMPTY_BATCHES, usual)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def for_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run an action on every micro-batch (messages, a database of the user's choice, ...)."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
