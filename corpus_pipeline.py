"""The corpus pipeline: quality filter, exact and near deduplication, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of ``documents``.  Rows without an id pass the deduplicating stages; rows
that repeat an id are told apart by their texts there, and go with them alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bin_packing, common, exact_dedup, jaccard_join, quality_classifier, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts, scored and returned in one pass over the texts."""
    model = quality_classifier.fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(spark, docs.select(*COLUMNS), model)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text (its mark) are not in ``gone``."""
    told = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return told.join(gone, ["doc_id", "mark"], "left_anti").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    gone = exact_dedup.exact_dedup(spark, docs).filter("NOT kept").select("doc_id", "mark").distinct()
    return _without(docs, gone)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the smallest id."""
    return _without(docs, jaccard_join.redundant(spark, docs))


def strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out repeated 100-byte strings; a character of which only some bytes would go stays."""
    return suffix_dedup.cleaned(spark, docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into training sequences; documents without text take no room."""
    return bin_packing.best_fit(spark, bin_packing.token_lengths(docs.filter(F.length("text") > 0)))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", strings), ("best-fit packing", packing)]

#: No stage but the second has SQL; tests/llm/test_corpus_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.keep(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.forget(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
