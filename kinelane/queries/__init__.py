"""Driver queries: each key has the Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from kinelane.queries import (
        aggregates,
        augmentation,
        files,
        frames,
        learning,
        lines,
        peaks,
        scaling,
        streams,
        windows,
    )

    found: dict[str, Query] = {}
    for module in (lines, frames, windows, peaks, scaling, aggregates, augmentation, files, learning, streams):
        found.update(module.QUERIES)
    return found
