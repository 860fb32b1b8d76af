"""Repeated 100-byte strings, found from a sampled suffix array.

Of every 100-byte window the 32-byte string with the smallest hash (the leftmost of equals)
is the window's anchor: equal windows have their anchor at the same place, so it is enough
to sort the suffixes that begin at anchors, about one in thirty-five bytes.

1. These suffixes, by their leading 32 bytes, are partitioned by range at sampled splitters.
   A splitter that was drawn several times lies inside a run of equal suffixes: the run is dealt over
   all buckets that it spans.  Buckets are sorted by multikey quicksort, so equal suffixes are
   neighbours; each bucket's first and last suffix are compared with those of the buckets
   beside it.  Only suffixes with an equal one go on.
2. Their contexts (the 100 bytes from the anchor on and the bytes before it that their windows need) are
   sorted the same way, once by the suffixes and once by the reversed bytes before them, equal contexts
   of a task being folded.  The common prefixes of neighbours then say, for each distance between a
   window's start and its anchor, which windows are equal; the first in order of document and position stays.

Bytes are compared, not hashes.  Splitters come from a bounded sample of documents and only decide
how even the buckets are.

Defined results: see :func:`suffix_dedup`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats
from .repeats import DOC, runs

SIZE, LEAD = 100, 32
#: Places of a leading string in a window, less one: the farthest an anchor is from a window's start.
BACK = SIZE - LEAD
#: Suffixes of a sampled document that are drawn for splitters, at most.
DRAWN = 32
#: Bytes of a document looked at together.
PIECE = 1 << 19
#: Suffixes and contexts a task holds before it sends them off.
FLUSH, HELD = 400_000, 150_000
#: Groups up to this size are put in order at once.
SMALL = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A leading string with a last byte that isn't zero, as NumPy ignores zeros at the end.
_KEY = f"S{LEAD + 1}"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _tables():
    cache = common.worker_cache("suffix")
    if not cache:
        cache["up"], cache["down"] = _powers(_BASE, PIECE + SIZE), _powers(_INVERSE, PIECE + SIZE)
    return cache["up"], cache["down"]


def _leading_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the LEAD bytes at each place."""
    up, down = _tables()
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return repeats.mix((total[LEAD:] - total[:-LEAD]) * down[: len(b) - LEAD + 1])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's windows: the distinct anchors' places, and of each the first and last window start."""
    at, first, last = [], [], []
    whole = np.frombuffer(raw, np.uint8)
    for begin in range(0, max(0, len(raw) - SIZE + 1), PIECE - SIZE + 1):
        b = whole[begin : begin + PIECE]
        h = _leading_hashes(b)
        # The place in the low bits: the least value is the leftmost least hash.
        m = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < BACK + 1:
            step = min(width, BACK + 1 - width)
            m = np.minimum(m[:-step], m[step:])
            width += step
        place = (m & np.uint64((1 << 22) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at.append(place[new] + begin)
        first.append(new + begin)
        last.append(np.append(new[1:], len(place)) - 1 + begin)
    if not at:
        return (np.zeros(0, np.int64),) * 3
    at, first, last = map(np.concatenate, (at, first, last))
    # An anchor whose windows lie on both sides of a piece border was found twice: one range of windows.
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return at[new], first[new], last[np.append(new[1:], True)]


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte rows by multikey quicksort on digits of eight bytes.

    Each round splits every open group in three around the median of three of its items, by the
    digit at the group's depth; the middle part goes on with the next digit.  Small groups are put in order together.
    """
    digits = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    n, most = digits.shape
    order = np.arange(n)
    start, size, depth = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64)
    small = []
    while True:
        live = (size > 1) & (depth < most)
        start, size, depth = start[live], size[live], depth[live]
        few = size <= SMALL
        small.append((start[few], size[few]))
        start, size, depth = start[~few], size[~few], depth[~few]
        if not len(start):
            break
        own, base = np.repeat(np.arange(len(start)), size), np.cumsum(size) - size
        inside = np.arange(len(own)) - base[own]
        item = order[start[own] + inside]
        key = digits[item, depth[own]]
        three = order[start[:, None] + np.stack([np.zeros_like(size), size // 2, size - 1], axis=1)]
        pivot = np.sort(digits[three, depth[:, None]], axis=1)[:, 1][own]
        below, above = key < pivot, key > pivot
        ranks, counts = [], []
        for part in (below, above):
            total = np.cumsum(part)
            ranks.append(total - part - (total[base] - part[base])[own])
            counts.append(np.add.reduceat(part.astype(np.int64), base))
        low, high = counts
        same = size - low - high
        at = np.where(below, ranks[0], np.where(above, (low + same)[own] + ranks[1], low[own] + inside - ranks[0] - ranks[1]))
        order[start[own] + at] = item
        start, size, depth = np.concatenate([start, start + low, start + low + same]), np.concatenate([low, same, high]), np.concatenate([depth, depth + 1, depth])
    start, size = (np.concatenate(x) for x in zip(*small, strict=True))
    if len(start):
        by = np.argsort(start)
        start, size = start[by], size[by]
        own, base = np.repeat(np.arange(len(start)), size), np.cumsum(size) - size
        place = start[own] + np.arange(len(own)) - base[own]
        item = order[place]
        order[place] = item[np.lexsort([*digits[item].T[::-1], own])]
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix with the one before in order."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 1 << 16):
        part = order[k - 1 : k + (1 << 16)]
        same = rows[part[1:]] == rows[part[:-1]]
        out[k : k + len(part) - 1] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return out


def later_windows(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which windows also begin earlier, for items in order of document and place.

    right: the bytes from the anchor on; left: those before it, nearest first; low, high: the
    distances of the anchor from its windows' starts.  Result: a row per item, a column per distance.
    """
    n = len(right)
    out = np.zeros((n, BACK + 1), bool)
    sides = []
    for rows in (right, left):
        order = multikey_order(rows)
        sides.append((order, _common(rows, order)))
    cls = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for o in range(BACK + 1):
        who = np.flatnonzero((low <= o) & (o <= high))
        if len(who) < 2:
            continue
        for c, (order, lcp), size in zip(cls, sides, (SIZE - o, o), strict=True):
            c[order] = np.cumsum(lcp < size)
        key = cls[0][who] * (n + 1) + cls[1][who]
        # `who` ascends, so of equal keys a stable sort leaves the earliest first.
        at = np.argsort(key, kind="stable")
        same = key[at[1:]] == key[at[:-1]]
        out[who[at[1:][same]], o] = True
    return out


def spans(later: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and end byte of each run of repeated windows."""
    edge = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    item, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)  # of the same runs, in the same order; a run is of distances near .. far - 1
    return item, place[item] - far + 1, place[item] - near + SIZE


SUFFIX = "bucket int, lead binary, place binary, at binary, docs binary"


def _deal(lead: np.ndarray, marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bucket of each leading string; equal ones at a splitter are dealt over the buckets that it borders, by document."""
    low, high = np.searchsorted(cuts, lead, "left"), np.searchsorted(cuts, lead, "right")
    return low + (repeats.mix(marks.view(np.uint64)) % (high - low + 1).astype(np.uint64)).astype(np.int64)


def _leads(raw: bytes, place: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)[place[:, None] + np.arange(LEAD)]


def _as_keys(lead: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(lead, ((0, 0), (0, 1)), constant_values=1)).view(_KEY).ravel()


def _suffixes(batches, cuts: np.ndarray):
    """The suffixes at anchors by range; of equal texts the first document of a task."""
    docs: list[tuple[int, int]] = []
    leads: list[np.ndarray] = []
    places: list[np.ndarray] = []
    seen: dict[int, int] = {}
    size = 0

    def flush():
        own, who = repeats.docs_of(docs), np.repeat(np.arange(len(docs)), [len(x) for x in places])
        lead, place = np.concatenate(leads), np.concatenate(places).astype(np.uint32)
        bucket = _deal(_as_keys(lead), own["mark"][who], cuts)
        order = np.argsort(bucket, kind="stable")
        lead, place, who, bucket = lead[order], place[order], who[order], bucket[order]
        start = np.flatnonzero(runs(bucket))
        rows = []
        for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
            some, at = np.unique(who[a:b], return_inverse=True)
            kind = np.uint16 if len(some) < 1 << 16 else np.uint32
            rows.append((int(bucket[a]), lead[a:b].tobytes(), place[a:b].tobytes(), at.astype(kind).tobytes(), own[some].tobytes()))
        for x in (docs, leads, places, seen):
            x.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SUFFIX.split(", ")])

    for pdf in batches:
        for i, m, text in zip(pdf["doc_id"], pdf["mark"], pdf["text"], strict=True):
            if pd.isna(i) or len(text) * 4 < SIZE:
                continue
            if (at := seen.get(m)) is not None:
                docs[at] = min(docs[at], (i, m))
                continue
            raw = text.encode()
            place = anchors(raw)[0]
            if len(place):
                seen[m] = len(docs)
                docs.append((i, m))
                leads.append(_leads(raw, place))
                places.append(place)
                size += len(place)
            if size > FLUSH:
                yield flush()
                size = 0
    if docs:
        yield flush()


RUNS = "dest int, doc binary, value binary, edge binary"


def _repeated(batches, dests: int):
    """Places of suffixes that have an equal neighbour, by document; and, with its leading string as edge, the
    bucket's first and last run: the place of a single suffix, nothing of a longer one."""
    lead, place, doc = [], [], []
    for pdf in batches:
        for r in pdf.itertuples():
            n = len(r.place) // 4
            lead.append(np.frombuffer(r.lead, np.uint8).reshape(n, LEAD))
            place.append(np.frombuffer(r.place, np.uint32))
            doc.append(np.frombuffer(r.docs, DOC)[np.frombuffer(r.at, np.uint16 if len(r.at) == 2 * n else np.uint32)])
    if not lead:
        return
    lead, place, doc = map(np.concatenate, (lead, place, doc))
    order = multikey_order(lead)
    new = np.concatenate([[True], (lead[order[1:]] != lead[order[:-1]]).any(axis=1)])
    run = np.cumsum(new)
    n = np.diff(np.append(np.flatnonzero(new), len(new)))
    # Of equal texts in a run the first document; a run of one document's single place then has no equal.
    some = np.flatnonzero((n > 1)[run - 1])
    place, doc = place[order], doc[order]
    inner = some[np.lexsort((place[some], doc["id"][some], doc["mark"][some], run[some]))]
    first = np.flatnonzero(runs(run[inner], doc["mark"][inner]))
    stay = doc["id"][inner] == np.repeat(doc["id"][inner[first]], np.diff(np.append(first, len(inner))))
    inner = inner[stay]
    left = np.bincount(run[inner], minlength=len(n) + 1)[1:]
    found = inner[left[run[inner] - 1] > 1]
    if len(found):
        yield repeats.pack(doc[found], place[found], dests).assign(edge=None)
    for k in sorted({0, len(n) - 1}):
        own = inner[run[inner] == k + 1] if n[k] > 1 else np.flatnonzero(run == k + 1)
        edge = lead[order[np.flatnonzero(new)[k]]].tobytes()
        if len(own) == 1:
            yield repeats.pack(doc[own], place[own], dests).assign(edge=edge)
        else:
            yield pd.DataFrame([(-1, b"", b"", edge)], columns=["dest", "doc", "value", "edge"])


def _across(found: DataFrame) -> DataFrame:
    """The places found in buckets, and those of single edges that an other bucket has too (two rows a bucket at most)."""
    edges = found.filter("edge IS NOT NULL")
    both = edges.groupBy("edge").count().filter("count > 1").select("edge")
    return found.filter("edge IS NULL").drop("edge").unionByName(edges.filter("dest >= 0").join(both, "edge", "left_semi").drop("edge"))


def _in_order(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """By document and place, each once (a document may come in several rows)."""
    order = np.lexsort((place, doc["mark"], doc["id"]))
    return order[runs(doc["id"][order], doc["mark"][order], place[order])]


CONTEXT = "bucket int, n int, right binary, left binary, low binary, high binary, doc binary, place binary"
_COLUMNS = [c.split()[0] for c in CONTEXT.split(", ")]


def _contexts(batches, cuts: np.ndarray):
    """Contexts of repeated anchors by range of their suffix; equal ones of a task only once, their repeats as spans (bucket -1)."""
    held: list[tuple] = []
    size = 0

    def flush():
        right, left, low, high, doc, place = map(np.concatenate, zip(*held, strict=True))
        order = _in_order(doc, place)
        right, left, low, high, doc, place = (x[order] for x in (right, left, low, high, doc, place))
        # The same context with the same windows: the earliest stands for all.
        whole = np.ascontiguousarray(np.concatenate([right, left, low[:, None].astype(np.uint8), high[:, None].astype(np.uint8)], axis=1))
        _, one = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True)
        rest = np.ones(len(doc), bool)
        rest[one] = False
        if rest.any():
            repeated = np.stack([place[rest] - high[rest], place[rest] - low[rest] + SIZE], axis=1)
            yield -1, int(rest.sum()), repeated.tobytes(), b"", b"", b"", doc[rest].tobytes(), b""
        one.sort()
        bucket = np.searchsorted(cuts, _as_keys(right[one, :LEAD]), "right")
        order = np.argsort(bucket, kind="stable")
        one, bucket = one[order], bucket[order]
        start = np.flatnonzero(runs(bucket))
        for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
            at = one[a:b]
            yield (int(bucket[a]), len(at), right[at].tobytes(), left[at].tobytes(), low[at].astype(np.uint8).tobytes(), high[at].astype(np.uint8).tobytes(), doc[at].tobytes(), place[at].tobytes())
        held.clear()

    def rows():
        for row in flush():
            yield pd.DataFrame([row], columns=_COLUMNS)

    for pdf in batches:
        for i, m, text, found in zip(pdf["doc_id"], pdf["mark"], pdf["text"], pdf["found"], strict=True):
            raw = text.encode()
            place, first, last = anchors(raw)
            hit = np.isin(place, np.frombuffer(found, np.uint32))
            place, first, last = place[hit], first[hit], last[hit]
            if not len(place):
                continue
            low, high = place - last, place - first
            b = np.concatenate([np.zeros(BACK, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(SIZE, np.uint8)])
            right = b[place[:, None] + BACK + np.arange(SIZE)]
            left = b[place[:, None] + BACK - 1 - np.arange(BACK)]
            # Bytes outside the anchor's windows would tell equal ones apart.
            right[np.arange(SIZE) >= (SIZE - low)[:, None]] = 0
            left[np.arange(BACK) >= high[:, None]] = 0
            held.append((right, left, low, high, repeats.docs_of([(i, m)] * len(place)), place))
            size += len(place)
            if size > HELD:
                yield from rows()
                size = 0
    if held:
        yield from rows()


def _compare(batches, dests: int):
    """The repeated spans of a bucket's documents."""
    cols: list[list] = [[] for _ in range(6)]
    for pdf in batches:
        for r in pdf.itertuples():
            if r.bucket < 0:
                yield repeats.pack(np.frombuffer(r.doc, DOC), np.frombuffer(r.right, np.int64).reshape(-1, 2), dests)
                continue
            for col, value in zip(cols, (np.frombuffer(r.right, np.uint8).reshape(-1, SIZE), np.frombuffer(r.left, np.uint8).reshape(-1, BACK), np.frombuffer(r.low, np.uint8), np.frombuffer(r.high, np.uint8), np.frombuffer(r.doc, DOC), np.frombuffer(r.place, np.int64)), strict=True):
                col.append(value)
    if not cols[0]:
        return
    right, left, low, high, doc, place = map(np.concatenate, cols)
    order = _in_order(doc, place)
    right, left, low, high, doc, place = (x[order] for x in (right, left, low, high, doc, place))
    item, a, b = spans(later_windows(right, left, low.astype(np.int64), high.astype(np.int64)), place)
    if len(item):
        yield repeats.pack(doc[item], np.stack([a, b], axis=1), dests)


def _splitters(rows: DataFrame, buckets: int) -> np.ndarray:
    """Leading strings of suffixes of a bounded sample, evenly spaced; one that is drawn often is in it several times."""

    def lead(batches):
        for pdf in batches:
            found = []
            for text in pdf["text"]:
                raw = text.encode()
                at = anchors(raw)[0]
                found += [raw[i : i + LEAD] for i in at[:: -(-len(at) // DRAWN) or 1]]
            yield pd.DataFrame({"s": found})

    drawn = sorted(r[0] for r in common.frames(repeats.sampled(rows), lead, "s binary").collect())
    cuts = [bytes(drawn[len(drawn) * k // buckets]) + b"\x01" for k in range(1, buckets)] if drawn else []
    return np.array(cuts, _KEY)


def merged(found, n: int) -> np.ndarray:
    """Maximal removed runs (first, end) of a text of n bytes."""
    if found is None or not len(found):
        return np.zeros((0, 2), np.int64)
    s = np.clip(np.frombuffer(found, np.int64).reshape(-1, 2), 0, n)
    s = s[s[:, 0] < s[:, 1]]
    s = s[np.argsort(s[:, 0], kind="stable")]
    if not len(s):
        return s
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    return np.stack([s[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(s)) - 1]], axis=1)


def cut_out(raw: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, runs: np.ndarray) -> np.ndarray:
    """The runs without the characters that they hold only some bytes of."""
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, b in runs.tolist():
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _clean(batches):
    for batch in batches:
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            if text is None or not found:
                out.append(text)
            else:
                raw = text.encode()
                out.append(cut_out(raw, whole_characters(raw, merged(found, len(raw)))).decode())
        i, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
        batch = batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))
        batch = batch.set_column(n, batch.schema.field(n), pa.array([None if x is None else len(x) for x in out], batch.schema.field(n).type))
        yield batch.drop_columns(["found"])


def cleaned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (which has doc_id, text, n_chars) with the repeated bytes cut out of the texts, up to
    whole characters, and n_chars set anew; a text that is wholly repeated becomes empty."""
    found = spans_of(spark, repeats.marked(docs), common.buckets(spark, docs)).withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    told = docs.join(found, (F.col("doc_id") == F.col("found_id")) & (own == F.col("found_mark")), "left").select(*docs.columns, "found")
    return told.mapInArrow(_clean, docs.schema)


def _remove(batches, digest: bool):
    for pdf in batches:
        out = []
        for text, found in zip(pdf["text"], pdf["found"], strict=True):
            raw = text.encode()
            cut = merged(found, len(raw))
            kept = cut_out(raw, cut)
            out.append((len(raw), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(kept).hexdigest() if digest else kept))
        got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])
        got.insert(0, "doc_id", pdf["doc_id"])
        yield got


def spans_of(spark: SparkSession, rows: DataFrame, buckets: int) -> DataFrame:
    """doc_id, mark and found, pairs of int64 (first, end) of repeated bytes; one row per document or none (kept)."""
    cuts = _splitters(rows, buckets)
    told = common.keep(spark, rows.filter("doc_id IS NOT NULL").filter(F.octet_length("text") >= SIZE).select("doc_id", "mark", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    copies = repeats.copies(spark, told)
    common.forget(spark, told)
    sent = common.dealt(common.frames(rows, lambda it: _suffixes(it, cuts), SUFFIX), buckets, "bucket")
    met = common.keep(spark, common.frames(sent, lambda it: _repeated(it, buckets), RUNS), "runs")
    known = repeats.gathered(_across(met), buckets).join(copies, ["doc_id", "mark"], "left_anti")
    known = common.keep(spark, known, "anchors")
    common.forget(spark, met)
    # Equal suffixes in one bucket: here their documents are compared.
    contexts = common.frames(rows.join(known, ["doc_id", "mark"]), lambda it: _contexts(it, np.unique(cuts)), CONTEXT)
    apart = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    inside = repeats.gathered(common.frames(common.dealt(contexts, buckets, apart), lambda it: _compare(it, buckets), repeats.PACKED), buckets)
    whole = copies.withColumn("found", F.lit(np.array([0, 1 << 62], np.int64).tobytes()))
    found = common.keep(spark, inside.unionByName(whole), "spans")
    common.forget(spark, known, copies)
    return found


def marked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, mark, text, found (all spans of a document, null where there are none)."""
    rows = repeats.marked(docs)
    return rows.join(spans_of(spark, rows, common.buckets(spark, docs)), ["doc_id", "mark"], "left")


def suffix_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a 100-byte string over it also starts earlier, in a document with a smaller id or
    before it in the same document, judged on the input.  Shorter texts, null and empty ones lose nothing;
    rows that repeat id and text count as one document, those that repeat only the id are documents
    in the order of their texts' hashes; rows with a null id neither lose bytes nor make others lose them;
    texts of any length are taken whole; an empty table yields an empty result; other columns are ignored.
    """
    return common.frames(marked(spark, docs), lambda it: _remove(it, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is taken in the workers."""
    return common.frames(marked(spark, common.table(spark, sf_dir, "documents")), lambda it: _remove(it, True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM t),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM p),
r AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
e AS (SELECT doc_id, i, coalesce(i > 100 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS fresh FROM r),
n AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, run),
m AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
q AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM m JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN q USING (doc_id)
"""
