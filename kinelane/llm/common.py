"""Shared helpers of the corpus operators: reading tables, Arrow passes and tables written between stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinelane.session import work_path

#: Rows taken together inside a task, and the UTF-8 bytes of text after which a smaller batch is closed.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_pass(df: DataFrame, work: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """``work`` maps columns (Python lists) of a small batch to columns of the result; text sets the batch size."""
    struct = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        for batch in batches:
            for part in small(batch):
                made = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [a if isinstance(a := made[f.name], pa.Array) else pa.array(a, f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, struct)


def filter_pass(df: DataFrame, verdict: Callable[[list[str]], list[bool]], text_column: str = "text") -> DataFrame:
    """Rows of ``df``, with all their columns, that ``verdict`` keeps by their text; null text is judged as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                texts = part.column(part.schema.get_field_index(text_column)).to_pylist()
                yield part.filter(pa.array(verdict([t or "" for t in texts]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows, cut in halves while they hold more than BATCH_BYTES."""
    todo = [batch.slice(i, BATCH_ROWS) for i in range(0, batch.num_rows, BATCH_ROWS)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > BATCH_BYTES:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


def lanes_for(rows: int, per_lane: int) -> int:
    """Number of lanes that hold about ``per_lane`` rows each; grows with the data."""
    return max(1, -(-rows // per_lane))
