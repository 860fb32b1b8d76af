"""Connected components of an edge table, by alternating large and small stars.

Every step is a join and an aggregate over edges; each round's edges are written to the
shared folder, so lineage stays short and nothing but a few counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _least(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the least id m of u and its neighbours, which is a table (kept), so that the join may split a hot u."""
    least = common.keep(spark, edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return edges.join(least, "u"), least


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of ``edges``: node, component (the least node reachable). Loops and repeats do no harm."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = common.keep(spark, pairs, "edges")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = print_of(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        told, least = _least(spark, both)
        large = common.keep(spark, told.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        small, lesser = _least(spark, large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = common.keep(spark, small, "edges")
        common.forget(spark, now, least, lesser, large)
        now, before = after, mark
        mark = print_of(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
