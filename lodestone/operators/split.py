"""Splits by time, as labels on one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.reviews import require


@dataclass(frozen=True)
class Split:
    labelled: DataFrame
    protocol: str

    def part(self, name: str) -> DataFrame:
        return self.labelled.filter(F.col("split") == name).drop("split")

    train = property(lambda self: self.part("train"))
    validation = property(lambda self: self.part("validation"))
    test = property(lambda self: self.part("test"))


def label_per_user(data: DataFrame, min_distinct_timestamps: int = 3) -> DataFrame:
    """A user's last moment is test, the one before validation, the rest train; users with too few moments go."""
    require(data, ("user_id", "timestamp"))
    back = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("timestamp")))
    ranked = data.withColumn("back", back).withColumn("moments", F.max("back").over(Window.partitionBy("user_id")))
    label = F.when(F.col("back") == 1, "test").when(F.col("back") == 2, "validation").otherwise("train")
    return ranked.filter(F.col("moments") >= min_distinct_timestamps).withColumn("split", label).drop("back", "moments")


def per_user_split(data: DataFrame, min_distinct_timestamps: int = 3) -> Split:
    out = label_per_user(data, min_distinct_timestamps)
    if out.isEmpty():
        raise ValueError("no user has events at enough different times")
    return Split(out, "per_user_last_timestamp")


def label_global(data: DataFrame, train_quantile: float = 0.8, validation_quantile: float = 0.9) -> DataFrame:
    """Rows up to the first quantile of all times are train, up to the second validation, the others test."""
    if not 0 < train_quantile < validation_quantile < 1:
        raise ValueError("the quantiles must ascend between 0 and 1")
    first, second = data.agg(F.percentile("timestamp", F.array(F.lit(train_quantile), F.lit(validation_quantile)))).first()[0] or (0.0, 0.0)
    label = F.when(F.col("timestamp") <= first, "train").when(F.col("timestamp") <= second, "validation").otherwise("test")
    return data.withColumn("split", label)


def global_split(data: DataFrame, train_quantile: float = 0.8, validation_quantile: float = 0.9) -> Split:
    out = label_global(data, train_quantile, validation_quantile)
    if out.select("split").distinct().count() < 3:
        raise ValueError("a part of the split would be empty")
    return Split(out, "global_timestamp_quantiles")
