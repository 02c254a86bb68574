"""Confusion matrix, classification report and regression errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_cells(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, count)`` with zero cells for every pair of classes seen on either side."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("count")
    )
    # Everything below works on the classes, of which there are few: sets of them are merged, never lists of pairs.
    classes = counts.agg(F.collect_set("label").alias("a"), F.collect_set("prediction").alias("b"))
    classes = classes.select(F.array_sort(F.array_union("a", "b")).alias("c"))
    grid = classes.select(F.explode("c").alias("label"), "c").select("label", F.explode("c").alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("long"))
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per true class, one column ``pred_<class>`` per predicted class."""
    counts = [F.count(F.when(F.col(prediction) == c, 1)).alias(f"pred_{c}") for c in classes]
    return df.groupBy(F.col(label).alias("label")).agg(*counts)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", names: dict[int, str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages (0/0 = 0)."""
    cells = confusion_cells(df, label, prediction)
    own = cells.groupBy(F.col("label").alias("k")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("hits"),
    )
    given = cells.groupBy(F.col("prediction").alias("k")).agg(F.sum("count").alias("claimed"))
    per_class = own.join(given, "k").select(
        "k",
        _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        "support",
        "hits",
    )
    p, r = F.col("precision"), F.col("recall")
    per_class = per_class.withColumn("f1", _ratio(F.lit(2.0) * p * r, p + r))
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    name: Column = F.col("k").cast("string")
    if names:
        pairs = [F.lit(v) for item in names.items() for v in item]
        name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("k")), name)
    rows = per_class.select(name.alias("name"), *scores, "support")
    accuracy = F.sum("hits") / total
    summary = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("name"), *[accuracy.alias(s) for s in scores], total.alias("support")
            ),
            F.struct(
                F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], total.alias("support")
            ),
            F.struct(
                F.lit("weighted avg").alias("name"),
                *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return rows.unionByName(summary)


def regression_metrics(df: DataFrame, actual: str, predicted: str, delta: float = 1.0) -> DataFrame:
    """Mean absolute error, Huber loss and mean absolute percentage error in one row."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    huber = F.when(F.abs(e) <= delta, F.lit(0.5) * e * e).otherwise(F.lit(delta) * (F.abs(e) - F.lit(0.5 * delta)))
    return df.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(huber).alias("huber"),
        (F.avg(F.abs(F.try_divide(e, y))) * F.lit(100.0)).alias("mape"),
    )


def binary_evaluation(
    df: DataFrame, label: str, probability: str, cut: float = 0.5, inclusive: bool = False
) -> DataFrame:
    """Accuracy and mean log loss of a probability column (probabilities kept off 0 and 1 by 1e-7)."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-7)), F.lit(1.0 - 1e-7))
    hit = (F.col(probability) >= cut) if inclusive else (F.col(probability) > cut)
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))
    return df.agg(
        F.count("*").alias("n"),
        F.avg((hit.cast("int") == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(loss).alias("loss"),
    )
