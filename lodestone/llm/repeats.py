"""What the two operators on repeated passages share: documents, copies, facts that travel packed.

A document is a pair of its id and a mark, 64 bits of its text: rows that repeat an id with
another text are documents of their own, in the order of their marks.  Rows that repeat
both are one document.

Of documents with the same digest only the first takes part: everything in the others occurs in it
too (see :func:`copies`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents of a bounded sample, from which an operator tells how to deal rows.
SAMPLE = 2000
DOC = np.dtype([("id", "<i8"), ("mark", "<i8")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text of the rows of ``docs``."""
    return common.texts(docs).withColumn("mark", F.xxhash64("text"))


def mark(raw: bytes) -> int:
    """The mark of a text, as Spark's xxhash64 has it."""
    m = xxhash.xxh64_intdigest(raw, 42)
    return m - (1 << 64) if m >> 63 else m


def docs_of(pairs) -> np.ndarray:
    return np.array(pairs, DOC) if len(pairs) else np.zeros(0, DOC)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, a new value begins."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def sampled(rows: DataFrame) -> DataFrame:
    """The rows of at most SAMPLE documents, those whose ids have the smallest hashes."""
    some = rows.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return rows.join(F.broadcast(some), "doc_id", "left_semi")


PACKED = "dest int, doc binary, value binary"


def pack(doc: np.ndarray, values: np.ndarray, dests: int) -> pd.DataFrame:
    """Facts about documents (a row of ``values`` each) by destination: a row per destination, not per document."""
    key = doc["id"] ^ doc["mark"] if doc.dtype == DOC else doc
    dest = (mix(key.view(np.uint64)) % np.uint64(dests)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    doc, values, dest = doc[order], values[order], dest[order]
    start = np.flatnonzero(runs(dest))
    rows = [(int(dest[a]), doc[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(start, np.append(start[1:], len(dest)), strict=True)]
    return pd.DataFrame(rows, columns=["dest", "doc", "value"])


def _unpack(batches):
    doc, value = [], []
    for pdf in batches:
        for d, v in zip(pdf["doc"], pdf["value"], strict=True):
            own = np.frombuffer(d, DOC)
            doc.append(own)
            value.append(np.frombuffer(v, np.uint8).reshape(len(own), -1))
    if doc:
        doc, value = np.concatenate(doc), np.concatenate(value)
        order = np.lexsort((doc["mark"], doc["id"]))
        doc, value = doc[order], value[order]
        start = np.flatnonzero(runs(doc["id"], doc["mark"]))
        stop = np.append(start, len(doc))[1:]
        yield pd.DataFrame({"doc_id": doc["id"][start], "mark": doc["mark"][start], "found": [value[a:b].tobytes() for a, b in zip(start, stop, strict=True)]})


def gathered(packed: DataFrame, dests: int) -> DataFrame:
    """doc_id, mark and found: all facts about a document in one row."""
    return common.frames(common.dealt(packed, dests, "dest"), _unpack, "doc_id long, mark long, found binary")


def copies(spark: SparkSession, told: DataFrame) -> DataFrame:
    """doc_id, mark of those of ``told`` (doc_id, mark, digest) whose digest an earlier document has (kept).

    ``told`` and the digests' first documents are tables, so that the join may split a hot digest.
    """
    own = F.struct("doc_id", "mark")
    first = told.groupBy("digest").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first < last").select("digest", "first")
    first = common.keep(spark, first, "first")
    out = common.keep(spark, told.join(first, "digest").filter(own > F.col("first")).select("doc_id", "mark").distinct(), "copies")
    common.forget(spark, first)
    return out
