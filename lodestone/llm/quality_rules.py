"""Quality rules: simple counts, then a log-likelihood ratio of hashed n-grams.

Words and pairs of adjacent words are hashed into ``BUCKETS`` buckets.  Two multinomials
with add-``ALPHA`` smoothing are counted: the raw one over every document, the target one
over trusted documents.  A document's score is the mean over its n-grams of
``log(target / raw)``; it passes if the score is ``THRESHOLD`` or more, so every document
gets a fixed verdict, without sampling.

The trusted rows are all those with a trusted id, the raw counts cover all documents.  Both
are sums of vectors of fixed size, one per task, added up by Spark.  Ids are told by a
merge join at every size: their number grows with the labels, so they are never sent whole.

Defined results: a null text has no words; a text without words has all counts 0 and fails
the base rules; without trusted rows the score is 0 for all; repeated documents get equal
results; a null id stays null; texts of any length are taken whole; an empty table gives an empty result;
other columns are ignored.  Words, windows and lines are compared themselves, not by hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
ALPHA = 1.0
#: Passing scores; see the README for how the two classes of ``labels`` spread around it.
THRESHOLD = -0.15
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray) -> np.ndarray:
    """Buckets of a document's words and word pairs."""
    pair = h[:-1] * _ODD[0] + h[1:] * _ODD[1]
    return np.concatenate([h, pair ^ (pair >> np.uint64(29))]) >> np.uint64(64 - 16)


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    # Numbers for the words, then for ever longer strings of them: equal numbers are equal words.
    number = dict(zip(words, range(len(words)), strict=True))
    own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    size = len(words)
    if size**WINDOW < 1 << 63:
        win = own[:n]
        for k in range(1, WINDOW):
            win = win * size + own[k : k + n]
    else:
        pair = np.unique(own[:-1] * size + own[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2] * size + pair[2:], return_inverse=True)[1]
        win = four[:n] * size + own[WINDOW - 1 :]
    order = np.argsort(win)
    same = win[order[1:]] == win[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(n + WINDOW, np.int32)
    at = np.flatnonzero(again)
    step[at] += 1
    step[at + WINDOW] -= 1
    return int((np.cumsum(step) > 0).sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.encode().split(b"\n") if x.strip(common.WHITE)]
    return len(lines) - len(set(lines))


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for pdf in batches:
        for text, trusted in zip(pdf["text"], pdf["trusted"], strict=True):
            h = word_hashes(text.encode().split())
            if len(h):
                own = grams(h).astype(np.int64)
                np.add.at(raw, own, 1)
                if trusted:
                    np.add.at(target, own, 1)
    at = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})


def ratios(spark: SparkSession, docs: DataFrame, trusted_ids: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket."""
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    told = common.texts(docs).join(ids.hint("merge"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counted = common.frames(told, _count, "bucket int, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def _judge(batches, ratio):
    table = ratio.value
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            words = text.encode().split()
            h = word_hashes(words)
            n = len(h)
            chars = len(text) - sum(map(text.count, common.WHITE.decode()))
            repeats = repeat_words(words)
            failed = n < 10 or 100 * repeats > 20 * n
            mean = float(table[grams(h).astype(np.int64)].mean()) if n else 0.0
            out.append((n, chars, sum(map(text.count, SYMBOLS)), dup_lines(text), repeats, failed, not failed and mean >= THRESHOLD, mean))
        got = pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])
        got.insert(0, "doc_id", pdf["doc_id"])
        yield got


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def quality_rules(spark: SparkSession, docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Per row of ``docs`` the counts, base_failed, kept, and the ratio."""
    ratio = spark.sparkContext.broadcast(ratios(spark, docs, trusted_ids))
    return common.frames(common.texts(docs), lambda it: _judge(it, ratio), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules(spark, common.table(spark, sf_dir, "documents"), trusted).drop("llr")
