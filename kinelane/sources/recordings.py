"""Scans of recording files and raw documents, and the driver's tables read as series."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelane.operators.lanes import Lanes, join_small, number_rows, running_before
from kinelane.schema import AXES, LENGTH, PROFILES, SEQ, SERIES, column_type, kept_columns


WHOLE_BYTES = 4 << 20  # of a file that is read as one value


class Scan(NamedTuple):
    """Typed rows of the good recordings, and ``(series_id, reason)`` of the others."""

    recordings: DataFrame
    rejects: DataFrame


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each text file below ``path`` as ``(doc_id, content)``; the id is the path below it, without suffix."""
    files = spark.read.text(path, wholetext=True)
    return files.select(_name("_metadata.file_path", path).alias("doc_id"), F.col("value").alias("content"))


def _name(column: str, root: str) -> Column:
    """Path below ``root`` without suffix, so that files of the same name in several folders stay apart."""
    scheme = r"^[a-z0-9+.-]+:/*"
    base = re.sub(scheme, "/", root).rstrip("/") + "/"
    whole = F.regexp_replace(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), scheme, "/")
    below = F.element_at(F.split(whole, re.escape(base), 2), -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def _lines_by_size(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(series_id, line_no, line)``: files of up to ``WHOLE_BYTES`` as one value each, longer ones in many splits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)  # sizes only, no content
    least, most = files.agg(F.min("length"), F.max("length")).first()
    if most is None or most <= WHOLE_BYTES:
        return _lines_of_small_files(spark, path, pattern)
    large = _lines_of_large_files(spark, path, pattern, WHOLE_BYTES)
    return large if least > WHOLE_BYTES else large.unionByName(_lines_of_small_files(spark, path, pattern, WHOLE_BYTES))


def _lines_of_small_files(spark: SparkSession, path: str, pattern: str, most: int | None = None) -> DataFrame:
    """``(series_id, line_no, line)`` without a shuffle: one file, of ``most`` bytes if given, is one value."""
    whole = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    if most is not None:
        whole = whole.filter(F.col("_metadata.file_size") <= most)
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    return whole.select(_name("_metadata.file_path", path).alias(SERIES), F.posexplode(lines).alias("line_no", "line"))


def _lines_of_large_files(spark: SparkSession, path: str, pattern: str, over: int | None = None) -> DataFrame:
    """The same for files read in many splits.

    Inside one split rows are read in file order, so the position is the number of rows in earlier splits of the file plus
    the distance from the split's first row. Rows do not move: the offsets, one per split, come to them. With ``over`` only
    files of more bytes are read, whose lines end where those of small files do.
    """
    reader, line = spark.read.option("pathGlobFilter", pattern), F.col("value")
    if over is None:
        raw = reader.text(path)
    else:
        raw = reader.text(path, lineSep="\n").filter(F.col("_metadata.file_size") > over)
        line = F.regexp_replace("value", r"\r\z", "")
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), line.alias("line"))
    rows = rows.filter(F.trim("line") != "").withColumn("_id", F.monotonically_increasing_id())
    counts = rows.groupBy("_file", "_split").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    offsets = running_before(counts, ["_file"], "_split", ["_rows"]).join(counts.drop("_rows"), ["_file", "_split"])
    places = offsets.select("_file", "_split", _name("_file", path).alias(SERIES), (F.col("_rows_before") - F.col("_first")).alias("_shift"))
    return join_small(rows, places, ["_file", "_split"]).select(SERIES, (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def scan_recordings(
    spark: SparkSession, path: str, profile: str = "P8_RAW", large_files: bool = False, check_header: bool = True, pattern: str = "*.csv"
) -> Scan:
    """A directory of recording files, one series per file that fits ``pattern``.

    Files of over ``WHOLE_BYTES`` are read in splits, smaller ones as one value each; with ``large_files`` all in splits.
    The profile gives the columns by position; ``check_header`` also wants the header to name exactly
    them (always for ``P8_RAW``). A series with a wrong header, a wrong column count, a value that is not
    a number or no rows at all goes to the rejects.
    """
    names = PROFILES[profile]
    lines = (_lines_of_large_files if large_files else _lines_by_size)(spark, path, pattern)
    cells = F.split("line", ",", -1)
    body = lines.withColumn("_cells", cells)
    wrong_header = (F.col("line_no") == 0) & (F.trim("line") != ",".join(names))
    wrong_count = F.size("_cells") != len(names)
    typed = {
        name: F.try_element_at("_cells", F.lit(i + 1)).try_cast(column_type(name).simpleString())
        for i, name in enumerate(names)
    }
    bad_value = F.lit(False)
    for name, value in typed.items():
        raw = F.trim(F.coalesce(F.try_element_at("_cells", F.lit(names.index(name) + 1)), F.lit("")))
        bad_value = bad_value | ((raw != "") & value.isNull())
    reason = F.when(wrong_count, "wrong number of columns")
    if check_header:
        reason = F.when(wrong_header, "wrong header").when(wrong_count, "wrong number of columns")
    reason = reason.when((F.col("line_no") > 0) & bad_value, "value is not a number")
    judged = body.withColumn("_reason", reason)
    per_series = judged.groupBy(SERIES).agg(
        (F.count("*") - F.lit(1)).alias(LENGTH), F.min("_reason").alias("reason")
    )
    per_series = per_series.withColumn(
        "reason", F.coalesce("reason", F.when(F.col(LENGTH) == 0, F.lit("no rows")))
    )
    good = per_series.filter(F.col("reason").isNull()).drop("reason")
    rows = judged.filter(F.col("line_no") > 0).withColumns({SEQ: (F.col("line_no") - 1).cast("long"), **typed})
    recordings = Lanes().attach(rows, good).select(
        SERIES, SEQ, F.col(LENGTH).cast("long").alias(LENGTH), *kept_columns(profile)
    )
    rejects = per_series.filter(F.col("reason").isNotNull()).select(SERIES, "reason")
    # Files without any line have no rows above, and readers skip empty files: the paths come from the listing.
    paths = [(p,) for p in spark.read.option("pathGlobFilter", pattern).text(path).inputFiles()]
    listed = spark.createDataFrame(paths, "path string").select(_name("path", path).alias(SERIES))
    blank = listed.join(per_series, SERIES, "left_anti").withColumn("reason", F.lit("no rows"))
    return Scan(recordings, rejects.unionByName(blank))


def scan_written(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Recordings as ``write_recordings`` left them: ``series_id=<name>/part=<k>/*.csv``.

    Order inside a recording is (part, split of the file, row of the split), so even a recording of many
    large parts is numbered from counts per split.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    location = F.col("_metadata.file_path")
    series = F.url_decode(F.regexp_extract(location, r"series_id=([^/]*)/", 1))
    rows = raw.select(
        F.url_decode(series).alias(SERIES),
        F.regexp_extract(location, r"/part=(\d+)/", 1).cast("long").alias("_part"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    header = F.lit(",".join(columns))
    rows = rows.filter((F.col("_split") > 0) | (F.col("line") != header))
    counts = rows.groupBy(SERIES, "_part", "_split").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(SERIES)
    earlier = whole.orderBy("_part", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(  # one row per split of a file
        SERIES, "_part", "_split",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias(LENGTH),
    )
    within = Window.partitionBy(SERIES, "_part", "_split").orderBy("_id")
    cells = F.split("line", ",", -1)
    return (
        rows.withColumn("_k", F.row_number().over(within))
        .join(offsets, [SERIES, "_part", "_split"])
        .select(
            SERIES,
            (F.col("_before") + F.col("_k") - 1).cast("long").alias(SEQ),
            LENGTH,
            *[cells[i].try_cast(column_type(c).simpleString()).alias(c) for i, c in enumerate(columns)],
        )
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_us(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")


def event_series(spark: SparkSession, folder: str, key: str = "event_type", *extra: str) -> DataFrame:
    """``events`` as one-channel series by ``key`` in time order: ``series_id, seq, n, value``."""
    rows = table(spark, folder, "events").select(
        F.col(key).cast("string").alias(SERIES), "ts", "event_id", "value", *extra
    )
    return number_rows(rows, ["ts", "event_id"])


def embedding_series(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as six-axis series by label in id order."""
    axes = [F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate(AXES)]
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias(SERIES), "vec_id", "label", *axes)
    return number_rows(rows, ["vec_id"])
