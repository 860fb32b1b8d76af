"""Exact deduplication against a minimal perfect hash of historical digests.

The history is a table of distinct text digests, each with its winner.  It is cut
into shards by leading digest bits.  For each shard :class:`PerfectHash` assigns
every digest its own slot; the slot holds the full 32-byte digest and the winner's locator
(code points and id) with the size of its group.  :func:`build` writes these shards as a table.

:func:`resolve` looks incoming digests up, shard by shard: one slot read and one comparison of the
full digest.  Members fold into their slot's winner and are gone; a digest that only
shares the slot is refused, and nonmembers form groups of their own.  Nothing is grouped again afterwards:
the slots and the nonmembers are the groups.

Incoming rows are first aggregated per digest (with map-side combine, so a digest
that a third of all rows share is one row per task).  The last step joins each row with the group of its
digest; the groups are a table with one row per digest, so adaptive execution may split a hot digest's rows.

Defined results: see :func:`exact_dedup`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Digests per shard, about.
SHARD_SIZE = 50_000
#: Mean number of digests that share a displacement.
PER_BUCKET = 2
#: Locator of a group: code points, whether there is an id, the id, and the group's size.
GROUP = np.dtype([("p", "<i8"), ("has", "?"), ("id", "<i8"), ("n", "<i8")])


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests (hash and displace).

    Digests are uniform already, so three of their words serve as hash functions:
    one picks the bucket, two give the slot ``(a + d * b) mod n`` for the bucket's
    displacement ``d``.  Buckets of two digests or more are placed first, larger ones before smaller
    ones: all that are still open try their next displacement at once, and of those that meet the first
    stays.  A bucket of one digest takes a slot that is left over, as ``-1 - slot``.
    """

    def __init__(self, n: int, shift: np.ndarray):
        self.n, self.shift = n, shift

    @classmethod
    def build(cls, digests: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """digests: shape (n, 4), uint64 words of distinct digests. Second result: the slot of each."""
        n = len(digests)
        shift = np.zeros(max(1, -(-n // PER_BUCKET)), np.int64)
        out, slots = cls(n, shift), np.full(n, -1, np.int64)
        if not n:
            return out, slots
        bucket, a, b = out._parts(digests)
        by = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[by], np.arange(len(shift) + 1))
        sizes = np.diff(start)
        free = np.ones(n, bool)
        for size in np.unique(sizes[sizes > 1])[::-1]:
            todo = np.flatnonzero(sizes == size)
            while len(todo):
                own = by[start[todo][:, None] + np.arange(size)]  # a row per bucket
                at = out._slot(a[own], b[own], shift[todo][:, None])
                ok = free[at].all(axis=1)
                inside = np.sort(at, axis=1)
                ok &= (inside[:, 1:] != inside[:, :-1]).all(axis=1)
                tried = np.flatnonzero(ok)
                holder = np.full(n, len(todo), np.int64)  # of each slot the first bucket that asks for it
                np.minimum.at(holder, at[tried], np.broadcast_to(tried[:, None], (len(tried), size)))
                won = tried[(holder[at[tried]] == tried[:, None]).all(axis=1)]
                slots[own[won]] = at[won]
                free[at[won]] = False
                rest = np.ones(len(todo), bool)
                rest[won] = False
                todo = todo[rest]
                shift[todo] += 1
                if len(todo) and shift[todo].max() > 1 << 32:
                    raise ValueError("no displacement found: the digests are not distinct")
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        slots[by[start[single]]] = left
        shift[single] = -1 - left
        return out, slots

    def _parts(self, digests: np.ndarray):
        return (digests[:, 1] % np.uint64(len(self.shift))).astype(np.int64), digests[:, 2], digests[:, 3]

    def _slot(self, a, b, d):
        x = a + d.astype(np.uint64) * (b | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(33)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; whether it is a member, the caller tells by the slot's digest."""
        bucket, a, b = self._parts(digests)
        d = self.shift[bucket]
        return np.where(d < 0, -1 - d, self._slot(a, b, np.maximum(d, 0)))


def words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 4)


def _signatures(batches):
    for pdf in batches:
        # An unpaired surrogate can't come out of Spark's UTF-8.
        raw = [x.encode() for x in pdf["text"]]
        out = [hashlib.sha256(x.translate(None, common.WHITE)).digest() for x in raw]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "mark": pdf["mark"], "digest": out, "n_points": pdf["text"].map(len).astype("int32")})


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, mark (64 bits of the text as it is), digest, n_points."""
    return common.frames(common.texts(docs).withColumn("mark", F.xxhash64("text")), _signatures, "doc_id long, mark long, digest binary, n_points int")


def _distinct(sig: DataFrame, shards: int) -> DataFrame:
    """A row per digest: its winner (most code points, an id before none, the smallest id) and number of rows."""
    best = F.struct(F.col("n_points").cast("long").alias("p"), F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("down"))
    shard = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    found = sig.groupBy("digest").agg(F.max(best).alias("b"), F.count(F.lit(1)).alias("n"))
    # New column ids: cogroup() mixes up sides that stem from one table.
    return found.select(shard.alias("shard"), F.concat("digest").alias("digest"), F.col("b.p").alias("p"), F.col("b.has").alias("has"), F.coalesce(F.bitwise_not("b.down"), F.lit(0).cast("long")).alias("id"), "n")


def _groups(table: pa.Table) -> np.ndarray:
    out = np.empty(len(table), GROUP)
    for c in GROUP.names:
        out[c] = table.column(c).to_numpy()
    return out


INDEX = "shard int, shift binary, digests binary, groups binary"


def build(spark: SparkSession, history: DataFrame, shards: int) -> DataFrame:
    """The index of a table of signatures, as a table (kept): a row per shard, digests and locators in the order of slots."""
    schema = to_arrow_schema(T.StructType.fromDDL(INDEX))

    def run(table: pa.Table) -> pa.Table:
        raw = table.column("digest").to_pylist()
        index, slots = PerfectHash.build(words(raw))
        order = np.argsort(slots)
        row = (table.column("shard")[0].as_py(), index.shift.tobytes(), b"".join(raw[k] for k in order), _groups(table)[order].tobytes())
        return pa.table([[x] for x in row], schema=schema)

    return common.keep(spark, _distinct(history, shards).groupBy("shard").applyInArrow(run, INDEX), "index")


FOUND = "digest binary, p long, has boolean, id long, n long, known boolean"


def probe(index: pa.Table, incoming: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """One shard: the digests, groups, and which are known: the slots with what folded into them, then nonmembers."""
    digests, groups = b"", np.zeros(0, GROUP)
    asked = incoming.column("digest").to_pylist() if len(incoming) else []
    new = _groups(incoming) if asked else groups
    hit = np.zeros(len(asked), bool)
    if len(index):
        digests = index.column("digests")[0].as_py()
        groups = np.frombuffer(index.column("groups")[0].as_py(), GROUP).copy()
        if asked:
            table = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 4)
            wanted = words(asked)
            slot = PerfectHash(len(table), np.frombuffer(index.column("shift")[0].as_py(), np.int64)).lookup(wanted)
            hit = (table[slot] == wanted).all(axis=1)  # the full digest
            # Members: each digest comes in once, so a slot is met once at most.
            at, who = slot[hit], new[hit]
            old = groups[at]
            better = (who["p"] > old["p"]) | (who["p"] == old["p"]) & (who["has"] & ~old["has"] | (who["has"] == old["has"]) & (who["id"] < old["id"]))
            total = old["n"] + who["n"]
            old[better] = who[better]
            old["n"] = total
            groups[at] = old
    names = [digests[k : k + 32] for k in range(0, len(digests), 32)] + [d for d, h in zip(asked, hit, strict=True) if not h]
    return names, np.concatenate([groups, new[~hit]]), np.arange(len(names)) < len(groups)


def resolve(spark: SparkSession, index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """Groups of equal digests over the index and a table of signatures (kept): digest, keep_id, keep_points, group_size, known.

    ``known``: the digest was in the history.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(FOUND))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, groups, known = probe(left, right)
        return pa.table([pa.array(names, pa.binary()), *(pa.array(np.ascontiguousarray(groups[c])) for c in GROUP.names), pa.array(known)], schema=schema)

    found = index.groupBy("shard").cogroup(_distinct(incoming, shards).groupBy("shard")).applyInArrow(run, FOUND)
    keep_id = F.when(F.col("has"), F.col("id"))
    return common.keep(spark, found.select("digest", keep_id.alias("keep_id"), F.col("p").alias("keep_points"), F.col("n").alias("group_size"), "known"), "groups")


def exact_dedup(spark: SparkSession, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, known, mark.

    ``history``: signatures (see :func:`signatures`) of what was admitted before.  Without
    one, the rows whose id hashes to an even number stand for the earlier delivery and the
    others for the new one; every row is decided, and the result does not depend on the cut.

    A null text counts as empty; empty texts are equal to each other and to texts of white space
    only; rows that repeat an id are rows of the group like any other (``kept`` holds for each row with the
    winner's id and length); any 64-bit id is exact; a null id is never preferred to a present one;
    texts of any length are taken whole; an empty table yields an empty result; other columns are ignored.
    """
    sig = common.keep(spark, signatures(docs), "exact-signatures")
    if history is None:
        even = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
        old, new = sig.filter(even), sig.filter(~even)
    else:
        old, new = history, sig
    shards = max(common.partitions(spark), -(-(sig.count() if history is None else old.count() + new.count()) // SHARD_SIZE))
    index = build(spark, old, shards)
    found = resolve(spark, index, new, shards)
    common.forget(spark, index)
    return sig.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "known",
        "mark",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, common.table(spark, sf_dir, "documents")).drop("known", "mark")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
