"""Quality scores from supervised subword embeddings.

A document's tokens are its words and, for each word that repeats the one before it,
the mark of a doubled word.  A token's vector is the mean of the learned vectors of its
hashed features: the whole word and its character n-grams (3 to 5 characters of ``<word>``).
The document's vector is the mean over its tokens, and a softmax layer gives the class
probabilities.  Vectors and layer are trained together by stochastic gradient descent
in NumPy, on a bounded sample of labelled rows (``sample`` rows, those whose ids have
the smallest hashes), whole texts each.  The workers hash the texts; what reaches the driver is a row
of at most ``BUCKETS`` features for each.

Because mean and layer are linear, scoring needs one number per feature (its vector times
the difference of the class weights); the workers remember one per word.

Defined results: a null or empty text has no tokens and gets the score of the bias alone;
a labelled row without text trains nothing; repeated label rows count once, with the
higher label; without any usable label every score is 0.5; repeated documents get equal
scores; a null id stays null, and is not held out; texts of any length are taken whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows to train on at most.
SAMPLE = 2500
#: Hash buckets of features; size of a vector; passes over the sample; first step size.
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 6, 0.6
GRAMS = (3, 5)
THRESHOLD = 0.3
#: Words whose number a worker remembers.
MEMO = 200_000
DOUBLED = b"\n="  # no word holds a line end


def features(word: bytes) -> list[int]:
    """Buckets of a token: itself, then its character n-grams."""
    out = [crc32(word, 1) % BUCKETS]
    if word != DOUBLED:
        w = b"<" + word + b">"
        if not w.isascii():
            chars = w.decode()
            for n in range(GRAMS[0], GRAMS[1] + 1):
                out += [crc32(chars[i : i + n].encode()) % BUCKETS for i in range(len(chars) - n + 1)]
            return out
        for n in range(GRAMS[0], GRAMS[1] + 1):
            out += [crc32(w[i : i + n]) % BUCKETS for i in range(len(w) - n + 1)]
    return out


def tokens(text: str) -> tuple[list[bytes], int]:
    """The words, and how many of them double the one before."""
    words = text.encode().split()
    return words, sum(map(eq, words, words[1:]))


class Model:
    """What scoring needs: one number per feature, and the bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias


def shares(text: str, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and the share that each has in its vector."""
    words, doubled = tokens(text)
    n = len(words) + doubled
    counts: dict[int, float] = {}
    seen = Counter(words)
    if doubled:
        seen[DOUBLED] = doubled
    for w, c in seen.items():
        own = memo.get(w)
        if own is None:
            if len(memo) > MEMO:
                memo.clear()
            own = memo[w] = features(w)
        share = c / (n * len(own))
        for f in own:
            counts[f] = counts.get(f, 0.0) + share
    return np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """rows: the shares of each text."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = rows[k]
            if not len(at):
                continue
            mean = share @ vectors[at]
            out = layer @ mean + bias
            out = np.exp(out - out.max())
            miss = out / out.sum()
            miss[labels[k]] -= 1
            back = miss @ layer
            layer -= rate * np.outer(miss, mean)
            bias -= rate * 0.1 * miss
            # A feature's step isn't shrunk by its share alone, or long texts would teach nothing.
            vectors[at] -= np.outer(rate * np.sqrt(share), back)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled rows outside the held-out fold; the features of at most ``sample`` of them reach the driver."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wanted = common.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "text", "quality")

    def hashed(batches):
        memo: dict = {}
        for pdf in batches:
            made = [shares(t, memo) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mark": pdf["mark"], "quality": pdf["quality"], "at": [x[0].tobytes() for x in made], "share": [x[1].tobytes() for x in made]})

    told = common.frames(wanted, hashed, "doc_id long, mark long, quality int, at binary, share binary")
    rows = told.toPandas().sort_values(["doc_id", "mark"]).drop_duplicates("doc_id")
    if not len(rows):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    made = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for a, s in zip(rows["at"], rows["share"], strict=True)]
    return train(made, (rows["quality"] > 0).astype(int).tolist())


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score_texts(texts, model: Model, weight: list[float], memo: dict) -> list[float]:
    out = []
    own_doubled = weight[features(DOUBLED)[0]]
    for text in texts:
        words, doubled = tokens(text)
        known = list(map(memo.get, words))
        if None in known:
            for k, w in enumerate(words):
                if known[k] is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    found = features(w)
                    known[k] = memo[w] = sum([weight[f] for f in found]) / len(found)
        n = len(words) + doubled
        z = model.bias + ((math.fsum(known) + doubled * own_doubled) / n if n else 0.0)
        out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
    return out


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score."""
    shared = spark.sparkContext.broadcast((model.weight, model.bias))  # of fixed size

    def run(batches):
        own, memo = Model(*shared.value), {}
        weight = own.weight.tolist()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score_texts(pdf["text"], own, weight, memo)})

    return common.frames(common.texts(docs), run, "doc_id long, score double")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (as they are) that score ``threshold`` or more."""
    shared = spark.sparkContext.broadcast((model.weight, model.bias))  # of fixed size

    def run(batches):
        own, memo = Model(*shared.value), {}
        weight = own.weight.tolist()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([x >= threshold for x in score_texts(texts, own, weight, memo)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return score(spark, docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
