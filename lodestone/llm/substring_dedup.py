"""Repeated 13-word windows, found from difference-cover anchors.

Seven-word strings are hashed only where the word's number modulo 7 is 1, 2 or 4.  For any two
positions some shift below 7 brings both onto such places (every difference modulo 7 is one
of two members of the cover), so two equal 13-word windows have an equal anchor at the same
shift.  Anchors that occur in two documents or more select the windows around them; those
are extended to 13 words, told apart by 128 bits of all their words, and given the first
document that has them.

Anchors and windows that a bounded sample shows to be in one of a hundred documents never meet in one
task: such an anchor counts as repeated unasked, and of such a window each task sends only its
first document; the firsts over all, one row for each of these windows, are broadcast.  The sample
only says how rows are dealt.

Keys, windows and results travel packed by bucket; the text itself is shuffled twice, by
document, for extension and removal.

Defined results: see :func:`substring_dedup`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats
from .repeats import DOC, runs

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Share of the sample that makes an anchor or a window a frequent one.
FREQUENT = 0.01
#: Keys a task holds before it sends them off.
FLUSH = 800_000
#: A window's key: two sums of word hashes.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
_LOW = np.uint64((1 << 40) - 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two hashes of 64 bits for each word, in two rows."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T


def strings(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word strings at all places."""
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _ODD[k]
    return repeats.mix(total)


def windows(h: np.ndarray) -> np.ndarray:
    """Keys of the windows at all places: 64 bits each of two independent hashes of the words."""
    out = np.empty(max(0, h.shape[1] - WINDOW + 1), KEY)
    out["a"], out["b"] = strings(h[0], WINDOW), strings(h[1], WINDOW)
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = keys[np.lexsort((keys["b"], keys["a"]))]
    return keys[runs(keys["a"], keys["b"])]


def members(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some; told by half of the key first."""
    out = np.isin(keys["a"], some["a"])
    at = np.flatnonzero(out)
    if len(at):
        both = np.concatenate([keys[at], some])
        order = np.lexsort((both["b"], both["a"]))
        run = np.cumsum(runs(both["a"][order], both["b"][order])) - 1
        has = np.zeros(run[-1] + 1, bool)
        has[run[order >= len(at)]] = True
        of = np.empty(len(both), np.int64)
        of[order] = run
        out[at] = has[of[: len(at)]]
    return out


def places(n: int) -> np.ndarray:
    """Where anchors of a document of n words begin."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What is sent of an anchor: its bucket and 40 bits. More may seem repeated than are; their windows are compared."""
    return ((keys >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (keys & _LOW)


def _describe(batches):
    """A digest of the words of each document that has a window."""
    for pdf in batches:
        out = []
        for i, m, text in zip(pdf["doc_id"], pdf["mark"], pdf["text"], strict=True):
            words = text.encode().split()
            if not pd.isna(i) and len(words) >= WINDOW:
                out.append((i, m, hashlib.blake2b(b" ".join(words), digest_size=32).digest()))
        yield pd.DataFrame(out, columns=["doc_id", "mark", "digest"])


SENT = "bucket int, low binary, high binary, at binary, docs binary, digests binary"


def _send(batches, buckets: int, frequent: np.ndarray):
    """The anchors of documents by bucket, but frequent ones; of the same words the first document of a task."""
    docs: list[tuple[int, int]] = []
    keys: list[np.ndarray] = []
    seen: dict[int, int] = {}
    size = 0

    def flush():
        who = np.repeat(np.arange(len(docs)), [len(k) for k in keys])
        own, digests = repeats.docs_of(docs), np.fromiter(seen, np.uint64, len(seen))
        key = short(np.concatenate(keys), buckets)
        bucket = (key >> np.uint64(40)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, who, bucket = key[order], who[order], bucket[order]
        start = np.flatnonzero(runs(bucket))
        rows = []
        for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
            k = key[a:b]
            some, at = np.unique(who[a:b], return_inverse=True)
            kind = np.uint16 if len(some) < 1 << 16 else np.uint32
            rows.append((int(bucket[a]), k.astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint8).tobytes(), at.astype(kind).tobytes(), own[some].tobytes(), digests[some].tobytes()))
        docs.clear()
        keys.clear()
        seen.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])

    for pdf in batches:
        for i, m, text in zip(pdf["doc_id"], pdf["mark"], pdf["text"], strict=True):
            words = text.encode().split()
            if pd.isna(i) or len(words) < WINDOW:
                continue
            digest = xxhash.xxh3_64_intdigest(b" ".join(words))
            if (at := seen.get(digest)) is not None:
                docs[at] = min(docs[at], (i, m))
                continue
            own = np.unique(strings(word_hashes(words)[0], ANCHOR)[places(len(words))])
            own = own[~np.isin(own, frequent)]
            seen[digest] = len(docs)
            docs.append((i, m))
            keys.append(own)
            size += len(own)
            if size > FLUSH:
                yield flush()
                size = 0
    if docs:
        yield flush()


def _repeated(batches, dests: int):
    """Of a bucket's anchors those that occur in two documents or more, documents of the same words counting once."""
    key, doc, digest = [], [], []
    for pdf in batches:
        for r in pdf.itertuples():
            n = len(r.low) // 4
            at = np.frombuffer(r.at, np.uint16 if len(r.at) == 2 * n else np.uint32)
            key.append(np.frombuffer(r.low, np.uint32).astype(np.uint64) | np.frombuffer(r.high, np.uint8).astype(np.uint64) << np.uint64(32) | np.uint64(r.bucket) << np.uint64(40))
            doc.append(np.frombuffer(r.docs, DOC)[at])
            digest.append(np.frombuffer(r.digests, np.uint64)[at])
    if not key:
        return
    key, doc, digest = np.concatenate(key), np.concatenate(doc), np.concatenate(digest)
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = np.concatenate([[False], key[1:] == key[:-1]])
    again[:-1] |= again[1:]
    key, order = key[again], order[again]
    doc, digest = doc[order], digest[order]
    order = np.lexsort((doc["mark"], doc["id"], digest, key))
    key, doc, digest = key[order], doc[order], digest[order]
    first = runs(key, digest)
    key, doc = key[first], doc[first]
    again = np.concatenate([[False], key[1:] == key[:-1]])
    again[:-1] |= again[1:]
    if again.any():
        yield repeats.pack(doc[again], key[again], dests)


def frequent_keys(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors and windows in at least the share FREQUENT of a bounded sample of documents; their number is bounded by it."""

    def drawn(batches):
        for pdf in batches:
            for text in pdf["text"]:
                words = text.encode().split()
                if len(words) >= WINDOW:
                    h = word_hashes(words)
                    a, w = np.unique(strings(h[0], ANCHOR)[places(len(words))]), distinct(windows(h))
                    yield pd.DataFrame({"window": np.repeat([False, True], [len(a), len(w)]), "a": np.concatenate([a, w["a"]]).view(np.int64), "b": np.concatenate([np.zeros(len(a), np.uint64), w["b"]]).view(np.int64)})

    told = common.frames(repeats.sampled(rows), drawn, "window boolean, a long, b long")
    found = told.groupBy("window", "a", "b").count().filter(F.col("count") >= max(2, int(repeats.SAMPLE * FREQUENT))).toPandas()
    of = lambda c, w: found.loc[found["window"] == w, c].to_numpy(np.int64).view(np.uint64)
    keys = np.empty(int(found["window"].sum()), KEY)
    keys["a"], keys["b"] = of("a", True), of("b", True)
    return np.sort(of("a", False)), distinct(keys)


def window_keys(text: str, found, buckets: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of the windows that hold a repeated anchor."""
    words = text.encode().split()
    h = word_hashes(words)
    at = places(len(words))
    anchors = strings(h[0], ANCHOR)[at]
    hit = np.isin(anchors, frequent)
    if found is not None:
        hit |= np.isin(short(anchors, buckets), np.frombuffer(found, np.uint64))
    if not hit.any():
        return np.zeros(0, KEY)
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(at[hit] - PERIOD + 1, 0), 1)
    np.add.at(near, at[hit] + 1, -1)
    own = windows(h)
    return distinct(own[np.cumsum(near)[: len(own)] > 0])


WINDOWS = "bucket int, frequent boolean, key binary, at binary, docs binary"


def _extend(batches, buckets: int, anchors: np.ndarray, frequent: np.ndarray):
    docs: list[tuple[int, int]] = []
    keys: list[np.ndarray] = []
    firsts: dict[bytes, tuple[int, int]] = {}
    size = 0

    def flush():
        k, who, own = np.concatenate(keys), np.repeat(np.arange(len(docs)), [len(x) for x in keys]), repeats.docs_of(docs)
        bucket = (repeats.mix(k["a"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k, who, bucket = k[order], who[order], bucket[order]
        start = np.flatnonzero(runs(bucket))
        rows = []
        for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
            some, at = np.unique(who[a:b], return_inverse=True)
            rows.append((int(bucket[a]), False, k[a:b].tobytes(), at.astype(np.uint32).tobytes(), own[some].tobytes()))
        docs.clear()
        keys.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    for pdf in batches:
        for i, m, text, found in zip(pdf["doc_id"], pdf["mark"], pdf["text"], pdf["found"], strict=True):
            own = window_keys(text, found, buckets, anchors)
            often = members(own, frequent)
            for k in own[often]:
                firsts[k.tobytes()] = min(firsts.get(k.tobytes(), (i, m)), (i, m))
            own = own[~often]
            if len(own):
                docs.append((i, m))
                keys.append(own)
                size += len(own)
            if size > FLUSH:
                yield flush()
                size = 0
    if size:
        yield flush()
    if firsts:
        yield pd.DataFrame([(xxhash.xxh3_64_intdigest(k) % buckets, True, k, b"", repeats.docs_of([d]).tobytes()) for k, d in firsts.items()], columns=[c.split()[0] for c in WINDOWS.split(", ")])


def _later(batches, dests: int):
    """Windows of documents that an earlier document has; of frequent windows the first document (dest -1)."""
    key, doc = [], []
    firsts: dict[bytes, tuple] = {}
    for pdf in batches:
        for r in pdf.itertuples():
            own = np.frombuffer(r.docs, DOC)
            if r.frequent:
                firsts[r.key] = min(firsts.get(r.key, own[0].item()), own[0].item())
            else:
                key.append(np.frombuffer(r.key, KEY))
                doc.append(own[np.frombuffer(r.at, np.uint32)])
    if firsts:
        yield pd.DataFrame([(-1, repeats.docs_of([d]).tobytes(), k) for k, d in firsts.items()], columns=["dest", "doc", "value"])
    if key:
        key, doc = np.concatenate(key), np.concatenate(doc)
        order = np.lexsort((doc["mark"], doc["id"], key["b"], key["a"]))
        key, doc = key[order], doc[order]
        later = ~runs(key["a"], key["b"])
        if later.any():
            yield repeats.pack(doc[later], key[later], dests)


def removed_words(words: list[bytes], found, whole: bool, frequent: np.ndarray) -> np.ndarray:
    """Whether each word is in a repeated window; found: window keys of an earlier document; frequent: more of these."""
    gone = np.zeros(len(words), bool)
    if len(words) < WINDOW or not whole and found is None and not len(frequent):
        return gone
    if whole:
        return ~gone
    own = windows(word_hashes(words))
    at = np.flatnonzero(members(own, np.concatenate([np.frombuffer(found or b"", KEY), frequent])))
    step = np.zeros(len(words) + 1, np.int64)
    step[at] += 1
    np.add.at(step, at + WINDOW, -1)
    return np.cumsum(step)[:-1] > 0


def _remove(batches, keys: np.ndarray, firsts: np.ndarray):
    for pdf in batches:
        out = []
        for i, m, text, found, whole in zip(pdf["doc_id"], pdf["mark"], pdf["text"], pdf["found"], pdf["whole"], strict=True):
            words = text.encode().split()
            earlier = keys[:0] if pd.isna(i) else keys[(firsts["id"] < i) | (firsts["id"] == i) & (firsts["mark"] < m)]
            gone = removed_words(words, found, whole, earlier)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            out.append((len(words), int(gone.sum()), kept.decode()))
        got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])
        got.insert(0, "doc_id", pdf["doc_id"])
        yield got


def _digest(batches, keys: np.ndarray, firsts: np.ndarray):
    for pdf in _remove(batches, keys, firsts):
        pdf["kept_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in pdf.pop("kept_text")]
        yield pdf


def _marked(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows with what was found for each (found, whole), and the frequent windows with their first documents."""
    rows = repeats.marked(docs)
    buckets = common.buckets(spark, docs)
    told = common.keep(spark, common.frames(rows, _describe, "doc_id long, mark long, digest binary"), "digests")
    copies = repeats.copies(spark, told)
    common.forget(spark, told)
    often, frequent = frequent_keys(rows)
    sent = common.frames(rows, lambda it: _send(it, buckets, often), SENT).repartition(buckets, "bucket")
    anchors = repeats.gathered(common.frames(sent, lambda it: _repeated(it, buckets), repeats.PACKED), buckets)
    anchors = common.keep(spark, anchors.join(copies, ["doc_id", "mark"], "left_anti"), "anchors")
    # A document with frequent anchors only has no row in `anchors`.
    asked = rows.join(anchors, ["doc_id", "mark"], "inner" if not len(often) else "left")
    if len(often):
        asked = asked.filter("doc_id IS NOT NULL").join(copies, ["doc_id", "mark"], "left_anti")
    met = common.frames(asked, lambda it: _extend(it, buckets, often, frequent), WINDOWS).repartition(buckets, "bucket")
    later = common.keep(spark, common.frames(met, lambda it: _later(it, buckets), repeats.PACKED), "later")
    firsts = later.filter("dest = -1").select("doc", "value").toPandas()  # a row for each of the frequent windows, at most
    keys = np.frombuffer(b"".join(firsts["value"]), KEY)
    firsts = np.frombuffer(b"".join(firsts["doc"]), DOC)
    found = repeats.gathered(later.filter("dest >= 0"), buckets).withColumn("whole", F.lit(False))
    found = common.keep(spark, found.unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True), "windows")
    common.forget(spark, anchors, later, copies)
    return rows.join(found, ["doc_id", "mark"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))), keys, firsts


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (remaining words, one blank between).

    A word goes if it lies in a 13-word window that also starts in a document with a smaller id,
    judged on the input.  Documents of fewer than 13 words, null and empty texts lose nothing;
    repeats inside a document stay; rows that repeat id and text count as one document, those that
    repeat only the id are documents in the order of their texts' hashes; rows with a null id
    neither lose words nor make others lose them; texts of any length are taken whole; an empty table
    yields an empty result; other columns are ignored.
    """
    rows, keys, firsts = _marked(spark, docs)
    return common.frames(rows, lambda it: _remove(it, keys, firsts), "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is taken in the workers."""
    rows, keys, firsts = _marked(spark, common.table(spark, sf_dir, "documents"))
    return common.frames(rows, lambda it: _digest(it, keys, firsts), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS k FROM p),
r AS (SELECT doc_id, i FROM k QUALIFY doc_id > min(doc_id) OVER (PARTITION BY k)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
s AS (SELECT doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)
"""
