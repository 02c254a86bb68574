"""SQL face of the window generator: starts of full windows for a series of a given length."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register_window_starts(spark: SparkSession, name: str = "window_starts") -> None:
    """``SELECT * FROM window_starts(n, width, step)`` gives ``(window_id, start)``."""

    @udtf(returnType="window_id bigint, start bigint")
    class WindowStarts:
        def eval(self, n: int, width: int, step: int) -> Iterator[tuple[int, int]]:
            for i, start in enumerate(range(0, n - width + 1, step)):
                yield i, start

    spark.udtf.register(name, WindowStarts)
