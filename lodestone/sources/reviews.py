"""Where reviews come from: CSV files, and adapters over other tables.

A review table has UserId, ProductId, Score and Time, may have Summary and Text, and may have
``row_order``, any orderable column that stands for the rows' order in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("UserId", "ProductId", "Score", "Time")
OPTIONAL = ("Summary", "Text")
#: What a CSV reader for data analysis takes for missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def require(df: DataFrame, columns, what: str = "The table") -> None:
    """Without a job: the columns are part of the plan."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} is missing required columns: {missing}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Only the known columns are read; tokens for missing values become null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require(raw, REQUIRED, "The file")
    own = [c for c in (*REQUIRED, *OPTIONAL) if c in raw.columns]
    out = raw.select(*[F.when(F.col(c).isin(MISSING), F.lit(None)).otherwise(F.col(c)).alias(c) for c in own], F.monotonically_increasing_id().alias("row_order"))
    return out.withColumn("Score", F.expr("try_cast(Score AS double)"))


def epoch_seconds(column: str):
    """Of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS timestamp_ntz))")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews: the quantity gives the score, part names and types the text."""
    line, orders, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    joined = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("UserId"),
        F.col("l_partkey").cast("string").alias("ProductId"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("Score"),
        epoch_seconds("o_orderdate").alias("Time"),
        F.col("p_name").alias("Summary"),
        F.concat_ws(" ", "p_brand", "p_type").alias("Text"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("row_order"),
    )


#: How much an event tells about a user's liking.
EVENT_SCORES = {"purchase": 5.0, "signup": 4.0, "click": 3.0, "view": 2.0, "error": 1.0}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews without text."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    score = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_SCORES.items()])
    return raw.select(F.col("user_id").cast("string").alias("UserId"), F.get_json_object("props", "$.k").alias("ProductId"), score.alias("Score"), epoch_seconds("ts").alias("Time"), F.col("event_id").alias("row_order"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as reviews of their source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select(F.col("source").alias("UserId"), F.col("doc_id").cast("string").alias("ProductId"), F.col("quality").cast("double").alias("Score"), F.col("doc_id").alias("Time"), F.lit("").alias("Summary"), F.col("text").alias("Text"), F.col("doc_id").alias("row_order"))
