"""Choosing settings on validation data: every candidate is a value of one column.

Scores of all candidates stand in one table (candidate, user_id, item_id, score).  What candidates
share is computed once: similarities, the Gram matrix, each model's percentiles.  NDCG of all candidates is one
aggregate, and Spark picks the best; of equal ones the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluate, models

#: The settings tried.
EASE_GRID = (10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0)
KNN_GRID = ((20, 0.0), (50, 0.0), (100, 0.0), (200, 0.0), (50, 10.0), (100, 10.0), (100, 50.0))
#: Pairs of models that are tried together.
PAIRS = (("item_knn", "biased_mf"), ("item_knn", "content_tfidf"), ("two_tower", "item_knn"))


@dataclass
class Asked:
    """The validation users drawn, their targets, and all that may be ranked for them (both persisted)."""

    train: DataFrame
    good: DataFrame
    pairs: DataFrame
    k: int
    seed: int

    @classmethod
    def of(cls, train: DataFrame, validation: DataFrame, k: int = 10, max_users: int = 200, seed: int = 42, positive_threshold: float = 4.0) -> Asked:
        wanted = evaluate.sample_users(evaluate.targets(validation, positive_threshold), max_users, seed)
        good = evaluate.eligible_targets(evaluate.cohorts(train, wanted)).persist()
        return cls(train, good, evaluate.candidates(train, good.select("user_id").distinct()).persist(), k, seed)

    def ndcg(self, scored: DataFrame) -> DataFrame:
        """candidate, ndcg: the mean over all users asked."""
        own = ["candidate", "user_id"]
        top = evaluate.ranked(scored, self.k, self.seed, by=own)
        gain = top.join(self.good, ["user_id", "item_id"]).groupBy(*own).agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
        ideal = self.good.groupBy("user_id").agg(evaluate.ideal_gain(F.count(F.lit(1)), self.k).alias("ideal"))
        users = self.good.select("user_id").distinct().count()
        found = gain.join(ideal, "user_id").groupBy("candidate").agg((F.sum(F.col("gain") / F.col("ideal")) / max(1, users)).alias("ndcg"))
        return scored.select("candidate").distinct().join(found, "candidate", "left").select("candidate", F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"))

    def best(self, scored: DataFrame) -> tuple[int, dict[int, float]]:
        """The number of the best candidate, and the NDCG of each."""
        told = self.ndcg(scored).agg(F.max_by("candidate", F.struct("ndcg", -F.col("candidate"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("candidate", "ndcg"))).alias("all")).first()  # a row per candidate
        return (0, {}) if told["best"] is None else (told["best"], dict(told["all"]))

    def all_scored(self, candidates: int, found: DataFrame) -> DataFrame:
        """0 for the pairs of a candidate that ``found`` (candidate, user_id, item_id, score) doesn't have."""
        every = self.pairs.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
        return every.join(found, ["candidate", "user_id", "item_id"], "left").select("candidate", "user_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def release(self) -> None:
        self.good.unpersist()
        self.pairs.unpersist()


def _from_weights(asked: Asked, events: DataFrame, weights: DataFrame, candidates: int) -> tuple[int, dict[int, float]]:
    """Of item-item weights (candidate, item_i, item_j, sim)."""
    own = events.join(asked.good.select("user_id").distinct(), "user_id", "left_semi").select("user_id", F.col("item_id").alias("item_i"))
    found = own.join(weights, "item_i").groupBy("candidate", "user_id", F.col("item_j").alias("item_id")).agg(F.sum("sim").alias("score"))
    return asked.best(asked.all_scored(candidates, found))


def select_item_knn(train: DataFrame, validation: DataFrame, *, candidates=KNN_GRID, **how):
    """The similarities are computed once, for the most neighbours that are asked for."""
    asked = Asked.of(train, validation, **how)
    events = models.positive(train)
    near = models.neighbours(events, max(n for n, _ in candidates)).persist()
    settings = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(n).alias("most"), F.lit(float(s)).alias("shrinkage")) for c, (n, s) in enumerate(candidates)])).alias("s")
    weights = near.select("item_i", "item_j", "rank", "n", "sim", settings).filter("rank <= s.most").select("s.candidate", "item_i", "item_j", (F.col("sim") * F.col("n") / (F.col("n") + F.col("s.shrinkage"))).alias("sim"))
    best, metrics = _from_weights(asked, events, weights, len(candidates))
    asked.release()
    near.unpersist()
    n, shrinkage = candidates[best]
    return models.ItemKNN(n, shrinkage).fit(train), {"n_neighbors": float(n), "shrinkage": float(shrinkage)}, {str(candidates[c]): x for c, x in metrics.items()}


def select_ease(train: DataFrame, validation: DataFrame, *, candidates=EASE_GRID, **how):
    """The Gram matrix is computed once, and inverted for all candidates side by side."""
    asked = Asked.of(train, validation, **how)
    shared = models.EASE(candidates[0]).gram(train)
    best, metrics = _from_weights(asked, shared.events, shared.weights_of(candidates), len(candidates))
    asked.release()
    return shared.solve(candidates[best]), candidates[best], {str(candidates[c]): x for c, x in metrics.items()}


def select_weights(fitted: dict, candidates: list[dict[str, float]], train: DataFrame, validation: DataFrame, **how):
    """Each model is scored and ranked once; a candidate is a set of weights for the percentiles."""
    asked = Asked.of(train, validation, **how)
    table = [(c, name, w) for c, weights in enumerate(candidates) for name, w in models.shares(weights, fitted).items() if w]
    told = F.broadcast(train.sparkSession.createDataFrame(table, "candidate int, model string, weight double"))  # as many rows as there are weights
    found = models.percentiles(fitted, asked.pairs).join(told, "model").groupBy("candidate", "user_id", "item_id").agg(F.sum(F.col("percentile") * F.col("weight")).alias("score"))
    best, metrics = asked.best(found)
    asked.release()
    return best, metrics


def select_blend(svd, nmf, train: DataFrame, validation: DataFrame, **how):
    tenths = [w / 10 for w in range(11)]
    both = {"biased_mf": svd, "implicit_nmf": nmf}
    best, metrics = select_weights(both, [{"biased_mf": w, "implicit_nmf": 1 - w} for w in tenths], train, validation, **how)
    return models.FactorBlend(svd, nmf, tenths[best]), tenths[best], {str(tenths[c]): x for c, x in metrics.items()}


def weight_sets(names) -> list[dict[str, float]]:
    """Which models share the weight: all, one alone, or a known pair."""
    groups = [tuple(names), *((n,) for n in names), *(p for p in PAIRS if {*p} <= {*names})]
    return [{n: 1.0 * (n in group) for n in names} for group in groups]


def select_hybrid(fitted: dict, train: DataFrame, validation: DataFrame, **how):
    sets = weight_sets(list(fitted))
    best, metrics = select_weights(fitted, sets, train, validation, **how)
    model = models.WeightedHybrid(fitted, sets[best])
    return model, model.weights, {"+".join(n for n, w in sets[c].items() if w): x for c, x in metrics.items()}
