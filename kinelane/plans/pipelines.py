"""The four jobs: documents to recordings, recordings to a model, model to verdicts, live detection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.functions.signal import magnitude
from kinelane.functions.text import RULE_D, label, strip_accents
from kinelane.operators.frames import FEATURES_11, motion_features
from kinelane.operators.lanes import short_series
from kinelane.operators.learning import forest, forest_search, multiclass_window_model, window_vectors
from kinelane.operators.parsing import LINE_NO, explode_lines, parse_tolerant
from kinelane.operators.savgol import savgol
from kinelane.operators.scaling import apply_minmax, fit_minmax
from kinelane.operators.splits import class_weights, random_split
from kinelane.operators.verdicts import majority_vote, mean_vector
from kinelane.operators.windows import segment_features, sliding_windows
from kinelane.schema import AXES, SEQ, SERIES
from kinelane.session import ensure_checkpoints
from kinelane.sources.recordings import read_documents
from kinelane.streaming.live import detect_motion, for_each_batch, pointed_feed

ROW_FEATURES = [*[f"{a}_smooth" for a in AXES], "acc_magnitude", "gyro_magnitude"]


def documents_to_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw documents of a folder as ``(recordings, rejected lines)``.

    The document's name is the key as it is, since names may differ by accents alone; ``name`` is it without them.
    Positions of recordings are dense, those of rejected lines are line numbers.
    """
    return lines_to_recordings(explode_lines(read_documents(spark, path)))


def lines_to_recordings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered raw lines as ``(recordings, rejected lines)``, as ``documents_to_recordings`` does."""
    good, bad = parse_tolerant(lines)
    return good.withColumn("name", strip_accents(F.col(SERIES))), bad.withColumnRenamed(SEQ, LINE_NO)


def too_short(recordings: DataFrame, width: int = 50, smooth: int = 50) -> DataFrame:
    """Recordings without a verdict, and why: shorter than the smoothing or than one window."""
    return short_series(recordings, max(width, smooth))


def labelled_windows(
    recordings: DataFrame,
    width: int = 50,
    step: int = 10,
    smooth: int = 50,
    rule: Sequence[tuple[str, int | str]] = RULE_D,
    strict: bool = True,
) -> DataFrame:
    """Windows over the eleven features with the class of the recording's name.

    ``strict`` stops at an unknown name; otherwise such recordings are left out.
    """
    features = motion_features(recordings, smooth).select(SERIES, SEQ, *FEATURES_11)
    windows = sliding_windows(features, FEATURES_11, width, step)
    named = windows.withColumn("label", label(strip_accents(F.col(SERIES)), rule, strict=strict))
    return named.filter(F.col("label").isNotNull())


class Trained(NamedTuple):
    """A fitted model, its scaler, and the scored test part.

    The split table is written down (a checkpoint), since fitting reads it many times and the test part reads it again.
    """

    model: PipelineModel
    scaler: DataFrame
    test: DataFrame


def _written(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def train_windows(recordings: DataFrame, width: int = 50, step: int = 10, classes: int = 4, iterations: int = 100) -> Trained:
    """Four-class window model on 80 % of the windows; the rest comes back scored."""
    windows = window_vectors(labelled_windows(recordings, width, step))
    parts = _written(random_split(windows, [SERIES, "window_id"]))
    model = multiclass_window_model(
        parts.filter("part = 'train'"), inputs=width * len(FEATURES_11), classes=classes, iterations=iterations
    )
    none = recordings.sparkSession.createDataFrame([], "column string, min double, max double")
    return Trained(model, none, model.transform(parts.filter("part = 'test'")))


def window_verdicts(recordings: DataFrame, model: PipelineModel, width: int = 50, step: int = 25, classes: int = 4) -> DataFrame:
    """Class per recording from the mean of its windows' probabilities; ``too_short`` has the recordings without one."""
    features = motion_features(recordings).select(SERIES, SEQ, *FEATURES_11)
    windows = window_vectors(sliding_windows(features, FEATURES_11, width, step))
    scored = model.transform(windows).withColumn("probs", vector_to_array("probability"))
    return mean_vector(scored, "probs", classes)


def row_features(recordings: DataFrame, width: int = 101) -> DataFrame:
    """Smoothed axes and magnitudes per sample."""
    made = savgol(recordings, AXES, width)
    return made.withColumns(
        {"acc_magnitude": magnitude(*ROW_FEATURES[:3]), "gyro_magnitude": magnitude(*ROW_FEATURES[3:6])}
    )


def train_rows(
    recordings: DataFrame, label_column: str = "label", trees: int = 100, depth: int = 30, fit_on_all: bool = False
) -> Trained:
    """Forest on eight scaled features per sample, stratified 80/20.

    The scaler is fitted on the training rows; ``fit_on_all`` fits it before the split instead.
    """
    features = row_features(recordings).select(SERIES, SEQ, label_column, *ROW_FEATURES)
    rows = _written(random_split(features, [SERIES, SEQ], stratify=label_column))
    train = rows.filter("part = 'train'")
    scaler = fit_minmax(rows if fit_on_all else train, ROW_FEATURES)
    scaled = [f"{c}_scaled" for c in ROW_FEATURES]
    model = forest(scaled, label_column, trees=trees, depth=depth).fit(apply_minmax(train, scaler, ROW_FEATURES))
    return Trained(model, scaler, model.transform(apply_minmax(rows.filter("part = 'test'"), scaler, ROW_FEATURES)))


def row_verdicts(recordings: DataFrame, model: PipelineModel, scaler: DataFrame) -> DataFrame:
    """Class per recording by the majority of its samples."""
    scaled = apply_minmax(row_features(recordings), scaler, ROW_FEATURES)
    voted = model.transform(scaled).withColumn("prediction", F.col("prediction").cast("int"))
    return majority_vote(voted)


def train_segments(
    recordings: DataFrame, label_column: str = "label", width: int = 100, smooth: int = 51, grid: dict | None = None, folds: int = 5
) -> Trained:
    """Forest by grid search on sixteen statistics per segment, classes weighted alike."""
    smoothed = savgol(recordings, AXES, smooth, suffix="")
    segments = segment_features(smoothed, label=label_column, width=width)
    names = [c for c in segments.columns if c.endswith(("_mean", "_std"))]
    parts = _written(random_split(segments, [SERIES, "segment"], stratify="label"))
    train = parts.filter("part = 'train'")
    scaler = fit_minmax(train, names)
    scaled = [f"{c}_scaled" for c in names]
    found = forest_search(class_weights(apply_minmax(train, scaler, names)), scaled, grid=grid, folds=folds)
    model = found.best
    return Trained(model, scaler, model.transform(apply_minmax(parts.filter("part = 'test'"), scaler, names)))


def watch(
    feed: DataFrame,
    pointer: DataFrame,
    scaler: DataFrame,
    model: PipelineModel,
    columns: Sequence[str],
    action: Callable[[DataFrame, int], None],
    checkpoint: str,
):
    """Score the live document's rows as they come and hand each batch of messages to ``action``."""
    live = apply_minmax(pointed_feed(feed, pointer), scaler, columns)
    return for_each_batch(detect_motion(live, model), action, checkpoint)
