"""One answer per recording from the scores of its windows or rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelane.functions.signal import threshold
from kinelane.functions.text import class_name
from kinelane.schema import SERIES


def mean_probability(
    df: DataFrame, probability: str = "p", cut: float = 0.5, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Mean score per series and class 1 from ``cut`` upwards."""
    means = df.groupBy(*keys).agg(F.avg(probability).alias("score"), F.count("*").alias("windows"))
    return means.withColumn("class", threshold("score", cut, inclusive=True))


def mean_vector(
    df: DataFrame,
    probabilities: str | Sequence[Column],
    classes: int,
    keys: Sequence[str] = (SERIES,),
    names: dict[int, str] | None = None,
) -> DataFrame:
    """Mean probability vector per series, its largest class (the first on a tie) and the class name.

    Components are averaged as plain columns, so partial sums are made before the shuffle.
    """
    parts = (
        [F.element_at(F.col(probabilities), i + 1) for i in range(classes)]
        if isinstance(probabilities, str)
        else list(probabilities)
    )
    means = df.groupBy(*keys).agg(*[F.avg(p).alias(f"p{i}") for i, p in enumerate(parts)])
    best = F.greatest(*[F.col(f"p{i}") for i in range(classes)])
    chain = F.lit(classes - 1)
    for i in range(classes - 2, -1, -1):
        chain = F.when(F.col(f"p{i}") == best, F.lit(i)).otherwise(chain)
    out = means.withColumn("class", chain).withColumn("score", best)
    return out.withColumn("class_name", class_name(F.col("class"), names))


def majority_vote(df: DataFrame, prediction: str = "prediction", keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Most frequent prediction per series, the smallest on a tie.

    Counted per (series, prediction) first, so a long series is summed before it is gathered.
    """
    counts = df.groupBy(*keys, prediction).agg(F.count("*").alias("_c"))
    best = F.max_by(F.struct(F.col(prediction), F.col("_c")), F.struct(F.col("_c"), -F.col(prediction)))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{prediction}").alias("class"), F.col("_b._c").alias("votes")
    )


def newest_pointer(sessions: DataFrame, document: str = "document_id", updated: str = "updated_at") -> DataFrame:
    """The document of the newest session, as one row (none if there is no session)."""
    return sessions.agg(F.max_by(document, updated).alias(document)).filter(F.col(document).isNotNull())


def pointed_document(docs: DataFrame, sessions: DataFrame, key: str = "doc_id", document: str = "document_id") -> DataFrame:
    """Rows of the document the newest session points at; empty without a session."""
    pointer = newest_pointer(sessions, document).select(F.col(document).alias(key))
    return docs.join(F.broadcast(pointer), key, "left_semi")
