"""Sinks: recordings, labelled and augmented files, histories and parameters."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.functions.text import RULE_A, label, strip_accents
from kinelane.operators.lanes import LANE, Lanes, join_small
from kinelane.schema import PROFILES, SEQ, SERIES


def write_recordings(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = tuple(PROFILES["P8_RAW"]),
    partition: Sequence[str] = (),
    mode: str = "errorifexists",
    rows_per_file: int = 1 << 20,
) -> None:
    """One folder of CSV per recording, rows in order, names without accents.

    Where names differ by accents alone, all of them keep theirs, so that no two recordings share a folder.

    A recording of up to ``rows_per_file`` rows is one file. A longer one is written by many tasks, with a
    ``part`` folder per stretch so that its order stays readable from the path.
    """
    lanes = Lanes(rows=rows_per_file)
    plain = strip_accents(F.col(SERIES))
    names = df.select(SERIES).distinct().groupBy(plain.alias("_plain")).agg(F.collect_set(SERIES).alias("_names"))
    shared = names.filter(F.size("_names") > 1).select(F.explode("_names").alias(SERIES), F.lit(True).alias("_shared"))
    tagged = join_small(lanes.tag(df).withColumnRenamed(LANE, "part"), shared, [SERIES], "left")
    named = tagged.withColumn(SERIES, F.when(F.col("_shared"), F.col(SERIES)).otherwise(plain)).drop("_shared")
    folders = [*partition, SERIES, "part"]
    (
        named.repartition(*[F.col(c) for c in folders])
        .sortWithinPartitions(*folders, SEQ)
        .select(*folders, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
        .write.mode(mode)
        .partitionBy(*folders)
        .csv(path, header=True, emptyValue="")
    )


def write_labelled(df: DataFrame, path: str, columns: Sequence[str] = tuple(PROFILES["P8_RAW"])) -> None:
    """Add the constant ``label`` of each recording's name; unknown names are left out. Never overwrites."""
    labelled = df.withColumn("label", label(F.col(SERIES), RULE_A, prefix=True, lower=False))
    write_recordings(labelled.filter(F.col("label").isNotNull()), path, [*columns, "label"])


def write_variants(df: DataFrame, path: str, columns: Sequence[str] = tuple(PROFILES["P8_RAW"])) -> None:
    """Augmented recordings below ``variant=<name>/series_id=<name>_<series>``."""
    named = df.withColumn(SERIES, F.concat_ws("_", "variant", SERIES))
    write_recordings(named, path, columns, partition=["variant"])


def write_record(df: DataFrame, path: str) -> None:
    """A single parsed record with its own column names as header."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def save_model(model: PipelineModel | Transformer, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_history(df_history: DataFrame, params: dict, path: str) -> None:
    """Objective per iteration as CSV and the fit parameters as one JSON row."""
    spark = df_history.sparkSession
    df_history.coalesce(1).write.mode("overwrite").csv(f"{path}/history", header=True)
    text = json.dumps({str(k): str(v) for k, v in params.items()}, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/params")
