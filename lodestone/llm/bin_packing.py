"""Best-fit packing of documents into training sequences of several permitted lengths.

A document is as long as its ids of the BPE codec, the end id included (:func:`token_lengths`).  Longer
ones than the largest permitted length are cut into pieces of that length.  Pieces are dealt by a hash into shards
of bounded size, each packed on its own: longest first, a piece goes into the open bin that it
leaves with the least room.  If none has room, a bin is opened in the size that costs least
per token it can be expected to hold: its own piece and as much as fits of the shorter ones
still to come.  The cost of a sequence has a linear and a quadratic part.  At the end
each bin shrinks to the least permitted length that holds its contents.

Defined results: a null or empty text is one piece of length 1; texts of any length are taken whole;
repeated rows are packed once each; a null id is packed like any other, any 64-bit id is exact; other columns
are ignored; an empty table yields an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .sentencepiece_codec import default_model, encoder

SIZES = (1024, 2048, 4096, 8192)
#: Pieces in a shard, about.
SHARD = 20_000
#: Length at which the quadratic part of a sequence's cost equals the linear one.
BALANCE = 32_768


def cost(size: int) -> float:
    return size * (1 + size / BALANCE)


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in descending length: bin, offset in it, and the bins' final sizes."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    after = np.append(np.cumsum(lengths[::-1])[::-1], 0)  # total length from a piece on
    down = -lengths
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    used: list[int] = []
    cap: list[int] = []
    for k, length in enumerate(lengths.tolist()):
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            best = None
            for size in sizes:
                if size >= length:
                    # Pieces still to come that fit beside this one are those not longer than the room.
                    fits = max(k + 1, int(np.searchsorted(down, -(size - length), "left")))
                    per_token = cost(size) / (length + min(size - length, int(after[fits])))
                    if best is None or per_token < best[0]:
                        best = (per_token, size)
            room, b = best[1], len(used)
            used.append(0)
            cap.append(best[1])
        bins[k], offsets[k] = b, used[b]
        used[b] += length
        if room > length:
            insort(rooms, (room - length, b))
    final = np.array([min(s for s in sizes if s >= u) for u in used], np.int64)
    return bins, offsets, final


def _count(batches, model: bytes):
    own = encoder(model)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "total": list(map(own.count, pdf["text"]))})


def token_lengths(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, total (the number of its ids)."""
    model = model or default_model()
    return common.frames(common.texts(docs), lambda it: _count(it, model), "doc_id long, total long")


def pieces(lengths: DataFrame, largest: int) -> DataFrame:
    rows = lengths.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {largest}"))).alias("piece"))
    return rows.select("doc_id", "piece", (F.col("piece") * largest).alias("begin"), F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).alias("length"))


PACKED = "doc_id long, piece long, begin long, length long, bin_id long, bin_offset long, bin_size long, bin_used long"


def best_fit(spark: SparkSession, lengths: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """lengths: doc_id, total (1 or more). Per piece: doc_id, piece, begin (in the document), length, bin_id, bin_offset, bin_size, bin_used."""
    sizes = tuple(sorted(sizes))
    cut = common.keep(spark, pieces(lengths, sizes[-1]), "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    schema = to_arrow_schema(T.StructType.fromDDL(PACKED))

    def run(table: pa.Table) -> pa.Table:
        pdf = common.to_frame(table).sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        length = pdf["length"].to_numpy(np.int64)
        b, offset, final = pack(length, sizes)
        used = np.zeros(len(final), np.int64)
        np.add.at(used, b, length)
        out = pdf[["doc_id", "piece", "begin", "length"]].assign(bin_id=(int(pdf["shard"].iloc[0]) << 32) + b, bin_offset=offset, bin_size=final[b], bin_used=used[b])
        return pa.Table.from_pandas(out, schema=schema, preserve_index=False)

    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard")
    return cut.withColumn("shard", shard).groupBy("shard").applyInArrow(run, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(spark, token_lengths(common.table(spark, sf_dir, "documents")))
