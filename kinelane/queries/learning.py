"""Learning and scoring queries (results depend on the learner, so they are checked by row counts here
and by properties in the tests)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.operators.frames import FEATURES_11, motion_features
from kinelane.operators.lanes import number_rows
from kinelane.operators.learning import (
    FOREST_GRID,
    binary_window_model,
    cluster,
    forecaster,
    forest_parts,
    forest_search,
    forest_votes,
    history,
    members,
    multiclass_window_model,
    project_2d,
    score_windows,
    series_means,
    window_vectors,
)
from kinelane.operators.metrics import classification_report, regression_metrics
from kinelane.operators.scaling import apply_minmax, apply_standard, fit_minmax, fit_standard
from kinelane.operators.splits import class_weights, random_split
from kinelane.operators.verdicts import mean_probability, mean_vector
from kinelane.operators.windows import forecast_windows, segment_features, sliding_windows
from kinelane.functions.signal import magnitude
from kinelane.functions.text import CLASS_NAMES
from kinelane.queries import Query
from kinelane.queries.common import EM, r, rounded
from kinelane.schema import AXES, LENGTH, SEQ, SERIES
from kinelane.session import ensure_checkpoints, work_path
from kinelane.sources.recordings import embedding_series, event_series, table

ROW_FEATURES = [*AXES, "acc_magnitude", "gyro_magnitude"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Eight features per sample and a two-class truth."""
    rows = embedding_series(spark, folder).withColumns(
        {"acc_magnitude": magnitude(*AXES[:3]), "gyro_magnitude": magnitude(*AXES[3:]), "label": F.col("label") % 2}
    )
    return apply_minmax(rows, fit_minmax(rows, ROW_FEATURES), ROW_FEATURES)


def _split(df: DataFrame, keys: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    ensure_checkpoints(df.sparkSession)  # written down: a fit reads its part many times
    parts = random_split(df, keys, stratify=label).checkpoint(eager=True)
    return parts.filter("part = 'train'"), parts.filter("part = 'test'")


def _report(df: DataFrame) -> DataFrame:
    return rounded(classification_report(df), ["name", "support"], ["precision", "recall", "f1"])


def _forest_rows(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _split(_rows(spark, folder), [SERIES, SEQ])
    parts = forest_parts(train, [f"{c}_scaled" for c in ROW_FEATURES], trees=100, depth=30)
    scored = forest_votes(test, parts, train.count())
    return _report(scored.select("label", F.col("prediction").cast("int").alias("prediction")))


def _segments(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Statistics of segments of 100 samples; series are event types, the axes multiples of the value."""
    rows = event_series(spark, folder).withColumns({a: F.col("value") * (i + 1) for i, a in enumerate(AXES)})
    rows = rows.withColumn("label", F.length(SERIES) % 2)
    ensure_checkpoints(spark)  # written down: the bounds, the split and the weights each read them
    made = segment_features(rows, label="label", width=100).checkpoint(eager=True)
    names = [c for c in made.columns if c.endswith(("_mean", "_std"))]
    scaled = apply_minmax(made, fit_minmax(made, names), names)
    return scaled, [f"{c}_scaled" for c in names]


def _forest_segments(spark: SparkSession, folder: str) -> DataFrame:
    scaled, names = _segments(spark, folder)
    train, test = _split(scaled, [SERIES, "segment"])
    train = class_weights(train).checkpoint(eager=True)
    scored = forest_votes(test, forest_parts(train, names, trees=100, depth=30, weight="weight"), train.count())
    return _report(scored.select("label", F.col("prediction").cast("int").alias("prediction")))


def _forest_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The whole search, 18 candidates by five folds, on the training segments; accuracy of each over the folds."""
    scaled, names = _segments(spark, folder)
    train, _ = _split(scaled, [SERIES, "segment"])
    found = forest_search(class_weights(train), names)
    rows = [(i, *(c[n] for n in FOREST_GRID), float(a)) for i, (c, a) in enumerate(zip(found.candidates, found.accuracies, strict=True))]
    return spark.createDataFrame(rows, "candidate int, num_trees int, max_depth int, min_rows int, accuracy double")


def _recordings(spark: SparkSession, folder: str, classes: int) -> DataFrame:
    """Six-axis series by class: the labels modulo the number of classes, in id order."""
    axes = [F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate(AXES)]
    series = (F.col("label") % classes).cast("string").alias(SERIES)
    return number_rows(table(spark, folder, "embeddings").select(series, "vec_id", *axes), ["vec_id"])


def _labelled_windows(rows: DataFrame, columns: list[str], width: int) -> DataFrame:
    return window_vectors(sliding_windows(rows, columns, width, 10)).withColumn("label", F.col(SERIES).cast("int"))


def _window_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 100 samples by six axes, two classes; verdicts from the windows held out."""
    train, test = _split(_labelled_windows(_recordings(spark, folder, 2), AXES, 100), [SERIES, "window_id"])
    model = binary_window_model(train, iterations=100)
    scored = model.transform(test).withColumn("p", vector_to_array("probability")[1])
    return rounded(mean_probability(scored), [SERIES, "windows", "class"], ["score"], 3)


def _window_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 50 samples by eleven features, four classes; verdicts from the windows held out."""
    rows = motion_features(_recordings(spark, folder, 4)).select(SERIES, SEQ, LENGTH, *FEATURES_11)
    train, test = _split(_labelled_windows(rows, FEATURES_11, 50), [SERIES, "window_id"])
    model = multiclass_window_model(train, inputs=50 * len(FEATURES_11), iterations=100)
    scored = model.transform(test).withColumn("probs", vector_to_array("probability"))
    return rounded(mean_vector(scored, "probs", 4), [SERIES, "class", "class_name"], ["p0", "p1", "p2", "p3"], 3)


def _forecast(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "pairs")  # written down by column: the split reads the keys only, the fit its part
    forecast_windows(event_series(spark, folder), "value").write.parquet(path)
    parts = random_split(window_vectors(spark.read.parquet(path)), [SERIES, "window_id"])
    model = forecaster(parts.filter("part = 'train'"), iterations=100)
    return rounded(regression_metrics(model.transform(parts.filter("part = 'test'")), "target", "prediction"), ["n"], ["mae", "huber", "mape"], 3)


def _training_history(spark: SparkSession, folder: str) -> DataFrame:
    """Objective per iteration of the two-class window model on its training part."""
    train, _ = _split(_labelled_windows(_recordings(spark, folder, 2), AXES, 100), [SERIES, "window_id"])
    return history(train, binary_window_model(train, iterations=100))


def _standard_means(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Standardised means per user; value and five parts of the time stand for the axes."""
    rows = event_series(spark, folder, "user_id")
    parts = [F.col("value"), *[F.date_part(F.lit(p), "ts") for p in ("HOUR", "MINUTE", "SECOND", "DAY", "DOW")]]
    wide = rows.withColumns({a: part.cast("double") for a, part in zip(AXES, parts, strict=True)})
    means = series_means(wide, AXES)
    return apply_standard(means, fit_standard(means, AXES), AXES), [f"{a}_trans" for a in AXES]


def _cluster(spark: SparkSession, folder: str) -> DataFrame:
    rows, names = _standard_means(spark, folder)
    return members(cluster(rows, names)[0])


def _pca(spark: SparkSession, folder: str) -> DataFrame:
    rows, names = _standard_means(spark, folder)
    return rounded(project_2d(rows, names)[0], [SERIES], ["pc1", "pc2"], 4)


def _load():
    def model(batch: np.ndarray) -> np.ndarray:
        """A fixed linear score per class on the mean of the window."""
        mean = batch.mean(axis=1)
        weights = np.linspace(-1.0, 1.0, mean.shape[1] * 4, dtype=np.float32).reshape(mean.shape[1], 4)
        raw = np.exp(mean @ weights)
        return raw / raw.sum(axis=1, keepdims=True)

    return model


def _score(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own model on 50-sample windows, then the verdict per series."""
    scored = score_windows(sliding_windows(_recordings(spark, folder, 4), AXES, 50, 25), _load)
    return rounded(mean_vector(scored, "probs", 4), [SERIES, "class", "class_name"], ["p0", "p1", "p2", "p3"], 4)


EM_BY_FOUR = EM.replace("CAST(label AS VARCHAR) AS series_id", "CAST(label % 4 AS VARCHAR) AS series_id").replace("PARTITION BY label", "PARTITION BY label % 4")


def _score_sql() -> str:
    """The same fixed model: softmax of a linear score of the window's means, averaged per series."""
    weights = np.linspace(-1.0, 1.0, len(AXES) * 4, dtype=np.float32).reshape(len(AXES), 4)
    raw = [" + ".join(f"{a} * {float(weights[i, c])!r}" for i, a in enumerate(AXES)) for c in range(4)]
    names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLASS_NAMES.items())
    return f"""
WITH {EM_BY_FOUR}, w AS (SELECT series_id, unnest(range(0, n - 49, 25)) AS s FROM em WHERE seq = 0 AND n >= 50),
m AS (SELECT w.series_id, s, {", ".join(f"avg({a}) AS {a}" for a in AXES)}
      FROM w JOIN em ON em.series_id = w.series_id AND em.seq BETWEEN s AND s + 49 GROUP BY w.series_id, s),
e AS (SELECT series_id, {", ".join(f"exp({x}) AS e{c}" for c, x in enumerate(raw))} FROM m),
p AS (SELECT series_id, {", ".join(f"avg(e{c} / (e0 + e1 + e2 + e3)) AS p{c}" for c in range(4))} FROM e GROUP BY series_id),
k AS (SELECT *, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS class FROM p)
SELECT series_id, class, CASE class {names} END AS class_name, {", ".join(f"{r(f'p{c}', 4)} AS p{c}" for c in range(4))} FROM k"""


QUERIES = {
    "forest_rows": Query(_forest_rows),
    "forest_segments": Query(_forest_segments),
    "forest_grid": Query(_forest_grid),
    "window_binary": Query(_window_binary),
    "window_multiclass": Query(_window_multiclass),
    "forecast": Query(_forecast),
    "training_history": Query(_training_history),
    "cluster": Query(_cluster),
    "pca2": Query(_pca),
    "score_windows": Query(_score, _score_sql()),
}
