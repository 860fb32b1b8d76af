"""The user-item graph of positive events, as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency(events: DataFrame) -> DataFrame:
    """src, dst, weight = 1 / sqrt(degree * degree), both directions; users are 'u...', items 'i...'."""
    edges = events.select(F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("i"), "item_id").alias("dst")).distinct()
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    out = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return out.select("src", "dst", (1 / F.sqrt(F.col("d").cast("double") * F.col("e"))).alias("weight"))


def propagate(edges: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """node, vector: the weighted sum of the neighbours' vectors, as sums per component (partly made before the shuffle)."""
    terms = edges.join(vectors.withColumnRenamed("node", "src"), "src")
    sums = terms.groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col("weight") * F.col("vector")[k]).alias(f"v{k}") for k in range(dim)])
    return sums.select("node", F.array(*[f"v{k}" for k in range(dim)]).alias("vector"))
