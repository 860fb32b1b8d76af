"""From raw reviews to interactions: copies removed, the last event per pair, k-core."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import review_key
from lodestone.sources.reviews import OPTIONAL, REQUIRED, require

COLUMNS = ("user_id", "item_id", "rating", "timestamp", "Summary", "Text", "is_positive")


#: The steps whose rows are counted, in order.
STEPS = ("required_values", "copy_removal", "pair_aggregation", "k_core")


@dataclass(frozen=True)
class PreparationReport:
    """Rows at the start and after each of ``STEPS``, and facts about what is left."""

    raw_rows: int
    after: dict[str, int]
    facts: dict[str, int | float]

    def to_dict(self) -> dict[str, int | float]:
        return {"raw_rows": self.raw_rows, **{f"after_{step}": self.after[step] for step in STEPS}, **self.facts}

    def __getattr__(self, name: str):
        if not name.startswith("_") and name in (told := self.to_dict()):
            return told[name]
        raise AttributeError(name)


def checkpointing(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says; where it is unset, to a folder of our own in local mode only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not found:
            found = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)


def checkpointed(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpointed and counted, computed once: what a checkpoint would compute a second time is persisted until then."""
    held = df.persist()
    n = held.count()
    out = held.checkpoint()
    held.unpersist()
    return out, n


def required_values(raw: DataFrame) -> DataFrame:
    """Rows with all required values, with both text columns, ids as strings, and ``row_order``."""
    require(raw, REQUIRED, "The dataset")
    for c in OPTIONAL:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(""))
    if "row_order" not in raw.columns:
        raw = raw.withColumn("row_order", F.monotonically_increasing_id())
    raw = raw.dropna(subset=list(REQUIRED))
    return raw.select(F.col("UserId").cast("string").alias("UserId"), F.col("ProductId").cast("string").alias("ProductId"), F.col("Score").cast("double").alias("Score"), F.col("Time"), *OPTIONAL, "row_order").filter(~F.isnan("Score"))


def numeric_time(rows: DataFrame) -> DataFrame:
    """Rows whose time is a number; whole numbers stay whole."""
    if dict(rows.dtypes)["Time"] in ("bigint", "int", "double"):
        return rows
    return rows.withColumn("Time", F.expr("try_cast(Time AS double)")).filter("Time IS NOT NULL AND NOT isnan(Time)")


def drop_copies(rows: DataFrame) -> DataFrame:
    """Of a user's reviews with equal score and text, whatever the product, the earliest stays."""
    w = Window.partitionBy("UserId", "Score", "review_key").orderBy("Time", "ProductId", "row_order")
    return rows.withColumn("review_key", review_key()).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "review_key")


def last_per_pair(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("UserId", "ProductId").orderBy(F.desc("Time"), F.desc("row_order"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def k_core(rows: DataFrame, min_user: int, min_item: int, user: str = "UserId", item: str = "ProductId") -> tuple[DataFrame, int, int]:
    """Users, then items with too few rows go, until nothing changes: rows, their number, rounds.

    A round is two semi joins against counts; each round is checkpointed, so plans stay short.
    """
    checkpointing(rows.sparkSession)
    (now, n), before, rounds = checkpointed(rows), -1, 0
    while before != n:
        before = n
        rounds += 1
        for key, least in ((user, min_user), (item, min_item)):
            now = now.join(now.groupBy(key).count().filter(F.col("count") >= least).select(key), key, "left_semi")
        now, n = checkpointed(now)
    return now, n, rounds


def canonical(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select(F.col("UserId").alias("user_id"), F.col("ProductId").alias("item_id"), F.col("Score").alias("rating"), F.col("Time").alias("timestamp"), *OPTIONAL, (F.col("Score") >= threshold).cast("tinyint").alias("is_positive"), "row_order")


def prepare(raw: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, PreparationReport]:
    """Interactions (COLUMNS and row_order) and the counts of each step; the source is read once."""
    checkpointing(raw.sparkSession)
    seen, counted = Observation(), F.count(F.lit(1)).alias("n")
    kept = Observation()
    timed = numeric_time(required_values(raw.observe(seen, counted)).observe(kept, counted))
    unique, n_unique = checkpointed(drop_copies(timed) if settings.drop_copied_reviews else timed)
    pairs, n_pairs = checkpointed(last_per_pair(unique))
    core, n_core, rounds = k_core(pairs, settings.min_user_interactions, settings.min_item_interactions)
    out = canonical(core, settings.positive_threshold)
    told = out.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.coalesce(F.avg("is_positive"), F.lit(0.0)).alias("positive_fraction")).first()
    after = dict(zip(STEPS, (kept.get["n"], n_unique, n_pairs, n_core), strict=True))
    return out, PreparationReport(seen.get["n"], after, {**told.asDict(), "k_core_rounds": rounds})
