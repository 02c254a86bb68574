"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); root is the least node reachable.

    Alternates large-star and small-star rounds, each written to the shared folder, until a round changes nothing; the
    number of rounds grows with the logarithm of the graph. Least neighbours are partial aggregates and are written
    too, so that the joins which hand them back are between tables and may be split where a node has very many links.
    """
    edges = stored(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links")
    mark = None
    while True:
        both = edges.select(F.col("low").alias("v"), F.col("high").alias("u")).union(edges.select(F.col("high").alias("v"), F.col("low").alias("u")))
        least = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "least")
        large = both.filter("u > v").join(least, "v").select(F.col("m").alias("low"), F.col("u").alias("high")).distinct()
        large = stored(large, "large")
        small = stored(large.groupBy("high").agg(F.min("low").alias("m")), "least")
        joined = large.join(small, "high")
        edges = joined.select("high", "m").union(joined.select(F.col("low").alias("high"), "m")).filter("high != m")
        edges = stored(edges.select(F.col("m").alias("low"), "high").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if mark == now:
            break
        mark = now
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())

