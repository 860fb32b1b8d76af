"""Near-duplicate groups: a Jaccard self-join of word-shingle sets by PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles.  Set sizes fall into
bands ``[l, l / 0.75]``, so sets that can link lie in the same or in adjacent bands; a
set of band ``i`` takes part in the instances ``i`` and ``i + 1``, and every possible link
lies in one instance.  Two sets of sizes x and y link only if they differ in at most
``(x + y) / 7`` elements.

An instance partitions the feature domain into N parts by a hash.  Linked sets differ in at
most k parts.  For small k the signatures are those of all pairs of ``N = k + 2`` parts, of
which linked sets share one; otherwise those of all single parts, with N so large
that a set has more than k parts with elements, one of which must agree.  Signatures of empty
parts are not sent: a set with too few full parts also signs under another
partition (a family), until it has enough of them.

Documents with the same set are a class; a link is between classes.  Steps:

1. Signatures travel packed, one row per task and bucket, and meet.  Only those of two classes
   or more go on, each with the number of classes that have it.
2. Linked sets share more signatures than one of them has full parts beyond k.  In one order of
   all signatures, rarest first, each set may therefore leave out as many of its last
   ones: a passage that many texts share is left out, copies stay.
3. In every group one central class, which is in most groups, is paired with the others.
   Candidates are compared by size, by parity bitmaps (folding a set into bits can only lower the
   number of differing elements, so no link is lost), then exactly.  Components follow.
4. Of groups that still hold more than one component, all classes whose groups have the same centre are
   compared across components, in blocks of bounded size, by size and bitmap before a pair is written: a pair
   that shares many groups is mostly looked at once.

Signatures that a bounded sample shows to be in one of a hundred documents are dealt by class
too, so that none of them meets in one task; they count as the most frequent. The sample only
says how rows are dealt and in which order signatures are left out, either of which gives the same links.

Hashes of 64 bits stand for shingles where two sets are compared; the results of two documents
are wrong only if a hash of one meets an other shingle's of the second.  Classes are told by 128 bits.

Defined results: see :func:`near_duplicates`.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph
from .repeats import mix, pack

WORDS = 5
#: Shingles a task holds before it sends their signatures off.
FLUSH = 600_000
#: Documents whose signatures tell which are frequent, and the share of them that counts as such.
SAMPLE, FREQUENT = 2000, 0.01
#: Classes of one centre in a block, about; two blocks are compared at a time.
BLOCK = 1024
#: Pairs a task holds before it sends them off.
PAIRS = 500_000
_MOST = (1 << 31) - 1
_LOW = np.uint64((1 << 40) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _bands(most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands: each ends at 4/3 of its first size."""
    out = [1]
    while out[-1] < most:
        out.append(4 * out[-1] // 3 + 1)
    return np.array(out, np.int64)


BANDS = _bands()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space parts
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    return np.unique(mix(sum((h[k : k + n] * _ODD[k] for k in range(1, WORDS)), h[:n] * _ODD[0])))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def tag(key: bytes) -> int:
    """What travels of a class: 64 bits. Classes that share them only become candidates of each other's partners."""
    return int.from_bytes(key[:8], "little", signed=True)


def links(x: int, y: int, both: int) -> bool:
    return 100 * both >= 75 * (x + y - both)


def _width(n: int) -> int:
    """Bits of a parity bitmap: a power of two, at least 64 and twice the size."""
    return max(64, 2 << max(0, int(n - 1).bit_length()))


def bitmap(s: np.ndarray) -> bytes:
    w = _width(len(s))
    return np.packbits((np.bincount((s % np.uint64(w)).astype(np.int64), minlength=w) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def may_link(x: int, y: int, bits_x: bytes, bits_y: bytes) -> bool:
    if 100 * min(x, y) < 75 * max(x, y):
        return False
    size = min(len(bits_x), len(bits_y))
    return 7 * int(np.bitwise_count(_fold(bits_x, size) ^ _fold(bits_y, size)).sum()) <= x + y


def _instance(i: np.ndarray):
    """Of instances: number of parts, and whether pairs of parts sign."""
    first = BANDS[i]
    k = 2 * (4 * first // 3) // 7
    return np.where(k <= 3, k + 2, (44 * first) // 100 + 4), k <= 3


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the set of each, and of each set how many full parts it can spare in its two instances.

    The lowest bit of a signature is the parity of its instance.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    spare = np.zeros((len(sets), 2), np.int64)
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    band = np.searchsorted(BANDS, sizes, "right") - 1
    for extra in (0, 1):
        todo = np.flatnonzero(sizes > 0)
        family = 0
        # Ends for all: in a family a set has too few full parts with a chance well below one (1/9 at most).
        while len(todo):
            inst = band[todo] + extra
            x = sizes[todo]
            most = np.minimum(4 * BANDS[inst] // 3, 4 * x // 3)  # of a partner's size
            k = (x + most) // 7
            parts, paired = _instance(inst)
            start = np.concatenate([[0], np.cumsum(parts)])
            h = np.concatenate([sets[d] for d in todo])
            of = np.repeat(np.arange(len(todo)), x)
            salt = mix((inst * (1 << 32) + family).astype(np.uint64) * _ODD[0])
            place = mix(h + salt[of])
            at = start[of] + ((place >> np.uint64(32)) % parts[of].astype(np.uint64)).astype(np.int64)
            total = np.zeros(start[-1], np.uint64)
            np.add.at(total, at, mix(place ^ _ODD[1]))
            count = np.bincount(at, minlength=start[-1])
            own = np.repeat(np.arange(len(todo)), parts)
            full = np.bincount(own, weights=count > 0, minlength=len(todo)).astype(np.int64)
            number = np.arange(start[-1]) - start[own]
            # The instance and the part's number are in the salt; single parts:
            one = (count > 0) & ~paired[own]
            value = mix(total + salt[own] + number.astype(np.uint64) * _ODD[2])
            found = [(value[one], own[one])]
            for n in np.unique(parts[paired]):  # pairs of parts
                rows = np.flatnonzero(paired & (parts == n))
                cell = start[rows][:, None] + np.arange(n)
                for i, j in combinations(range(n), 2):
                    a, b = cell[:, i], cell[:, j]
                    some = (count[a] + count[b]) > 0
                    found.append((mix(total[a[some]] * _ODD[3] + mix(total[b[some]] + salt[rows[some]]) + np.uint64(i * 64 + j)), rows[some]))
            for value, who in found:
                sigs.append((value & ~np.uint64(1)) | (inst[who] & 1).astype(np.uint64))
                owners.append(todo[who])
            # With one spare part or none, `full > k` is what the guarantee needs.
            good = full > k
            # A set that signs under several families, or by pairs of parts, shares one signature for sure and no more.
            spare[todo[good], (inst & 1)[good]] = np.where(paired | (family > 0), 0, full - k - 1)[good]
            family += 1
            todo = todo[~good]
    return np.concatenate(sigs), np.concatenate(owners), spare


def short(sig: np.ndarray, buckets: int) -> np.ndarray:
    """What is sent of a signature: its bucket and 40 bits."""
    return ((sig >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (sig & _LOW)


def _sets(batches):
    """(id, set, key) of the documents that have an id and a set."""
    for pdf in batches:
        for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            if not pd.isna(i) and len(s := shingles(text)):
                yield int(i), s, set_key(s)


SENT = "bucket int, frequent boolean, low binary, high binary, at binary, tags binary, spare binary"


def _send(batches, buckets: int, frequent: np.ndarray):
    """Pack the signatures of a task's distinct sets by bucket; frequent ones as their numbers, dealt by class too."""
    tags: list[int] = []
    sets: list[np.ndarray] = []
    seen: set[bytes] = set()
    size = 0

    def packed():
        sig, who, spare = signatures(sets)
        own = np.array(tags, np.int64)
        often = np.isin(sig, frequent)
        bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        bucket[often] = (mix(sig[often] ^ own[who[often]].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        dest = 2 * bucket + often
        order = np.argsort(dest, kind="stable")
        sig, who, dest = sig[order], who[order], dest[order]
        start = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1]]))
        for a, b in zip(start, np.append(start[1:], len(dest)), strict=True):
            s, w = sig[a:b], who[a:b]
            hot = bool(dest[a] & 1)
            if hot:
                s = np.searchsorted(frequent, s).astype(np.uint64)
            some, at = np.unique(w, return_inverse=True)
            kind = np.uint16 if len(some) < 1 << 16 else np.uint32
            yield int(dest[a] >> 1), hot, s.astype(np.uint32).tobytes(), (s >> np.uint64(32)).astype(np.uint8).tobytes(), at.astype(kind).tobytes(), own[some].tobytes(), np.minimum(spare[some], 65535).astype(np.uint16).tobytes()

    def flush():
        rows = list(packed())
        tags.clear()
        sets.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])

    for _, s, key in _sets(batches):
        if key in seen:
            continue
        seen.add(key)
        tags.append(tag(key))
        sets.append(s)
        size += len(s)
        if size > FLUSH:
            yield flush()
            size = 0
    if sets:
        yield flush()


def _groups(batches, buckets: int, frequent: np.ndarray):
    """Of a bucket's signatures those of two classes or more: packed by class, with the classes' number."""
    cols: dict[bool, list] = {False: [], True: []}
    for pdf in batches:
        for r in pdf.itertuples():
            n, tags = len(r.low) // 4, np.frombuffer(r.tags, np.int64)
            at = np.frombuffer(r.at, np.uint16 if len(r.at) == 2 * n else np.uint32)
            sig = np.frombuffer(r.low, np.uint32).astype(np.uint64)
            if not r.frequent:
                sig |= np.frombuffer(r.high, np.uint8).astype(np.uint64) << np.uint64(32) | np.uint64(r.bucket) << np.uint64(40)
            parity = (frequent[sig.astype(np.int64)] if r.frequent else sig) & np.uint64(1)
            cols[r.frequent].append((sig, tags[at], np.frombuffer(r.spare, np.uint16).reshape(-1, 2)[at, parity.astype(np.int64)]))
    for often, held in cols.items():
        if not held:
            continue
        sig, tags, spare = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        order = np.lexsort((tags, sig))
        sig, tags, spare = sig[order], tags[order], spare[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (tags[1:] != tags[:-1])])
        sig, tags, spare = sig[fresh], tags[fresh], spare[fresh]
        if often:
            sig, size = short(frequent, buckets)[sig.astype(np.int64)], np.full(len(sig), _MOST)
        else:
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            n = np.diff(np.append(start, len(sig)))
            size = np.repeat(n, n)
        some = size > 1
        if not some.any():
            continue
        fact = np.empty(int(some.sum()), MEMBER)
        fact["g"], fact["size"], fact["spare"] = sig[some], size[some], spare[some]
        yield pack(tags[some], fact.view(np.uint8).reshape(len(fact), -1), buckets)


MEMBER = np.dtype([("g", "<u8"), ("size", "<u4"), ("spare", "<u2")])


def _retain(batches):
    """Of each class the signatures that it may not leave out; often: how many these are."""
    tags, fact = [], []
    for pdf in batches:
        for d, v in zip(pdf["doc"], pdf["value"], strict=True):
            tags.append(np.frombuffer(d, np.int64))
            fact.append(np.frombuffer(v, MEMBER))
    if not tags:
        return
    tags, fact = np.concatenate(tags), np.concatenate(fact)
    g, size = fact["g"], fact["size"]
    own = (g & np.uint64(1)).astype(np.int8)
    order = np.lexsort((g, size, own, tags))
    tags, own, g, spare = tags[order], own[order], g[order], fact["spare"][order]
    start = np.flatnonzero(np.concatenate([[True], (tags[1:] != tags[:-1]) | (own[1:] != own[:-1])]))
    n = np.diff(np.append(start, len(tags)))
    stay = np.arange(len(tags)) - np.repeat(start, n) < np.repeat(n, n) - spare
    tags, g = tags[stay], g[stay]
    if len(tags):
        _, back, often = np.unique(tags, return_inverse=True, return_counts=True)
        yield pd.DataFrame({"g": g.astype(np.int64), "tag": tags, "often": often[back].astype(np.int32)})


def frequent_signatures(spark: SparkSession, rows: DataFrame) -> np.ndarray:
    """Sorted signatures that are in at least the share FREQUENT of a bounded sample of documents: their number is bounded by it."""
    some = rows.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def drawn(batches):
        sets = [s for _, s, _ in _sets(batches)]
        if sets:
            sig, who, _ = signatures(sets)
            sig, count = np.unique(np.unique(np.stack([sig, who.astype(np.uint64)], axis=1), axis=0)[:, 0], return_counts=True)
            yield pd.DataFrame({"sig": sig.astype(np.int64), "n": count})

    told = common.frames(rows.join(F.broadcast(some), "doc_id", "left_semi"), drawn, "sig long, n long")
    found = told.groupBy("sig").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, int(SAMPLE * FREQUENT))).select("sig").toPandas()
    return np.sort(found["sig"].to_numpy(np.int64).view(np.uint64))


def _describe(batches):
    for pdf in batches:
        out = []
        for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            s = shingles(text)
            key = set_key(s) if len(s) and not pd.isna(i) else None
            out.append((len(s), key, tag(key) if key else 0))
        got = pd.DataFrame(out, columns=["n_shingles", "set_key", "tag"])
        yield got.assign(doc_id=pdf["doc_id"], mark=pdf["mark"])


def _sieve(batches):
    for pdf in batches:
        ok = [may_link(*x) for x in zip(pdf["na"], pdf["nb"], pdf["bits_a"], pdf["bits_b"], strict=True)]
        yield pdf.loc[ok, ["a", "b"]]


def _read(batches):
    """The sets and bitmaps of the classes asked for."""
    for pdf in batches:
        out = []
        for node, own, text, key in zip(pdf["node"], pdf["tag"], pdf["text"], pdf["set_key"], strict=True):
            s = shingles(text)
            if set_key(s) == key:  # else another text of the same id
                out.append((node, own, len(s), bitmap(s), s.tobytes()))
        yield pd.DataFrame(out, columns=["node", "tag", "n", "bits", "set"])


def _verify(batches):
    for pdf in batches:
        ok = []
        for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        yield pdf.loc[ok, ["a", "b"]]


def _cross(batches):
    """Pairs across components in a block pair that may link by size and bitmap."""
    held: list[np.ndarray] = []
    size = 0

    def pairs():
        both = np.unique(np.concatenate(held), axis=0)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    for pdf in batches:
        for i, j, members in zip(pdf["i"], pdf["j"], pdf["x"], strict=True):
            node = np.array([r["node"] for r in members], np.int64)
            c = np.array([r["c"] for r in members], np.int64)
            n = np.array([r["n"] for r in members], np.int64)
            block = np.array([r["block"] for r in members], np.int64)
            width = np.array([len(r["bits"]) for r in members])
            for w in np.unique(width):  # of sizes that can link, the widths differ by a factor of two at most
                rows = np.concatenate([np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)])
                bits = np.stack([_fold(members[k]["bits"], w) for k in rows]).view(np.uint64)
                for k, row in enumerate(rows[: int((width == w).sum())]):
                    other = rows[k + 1 :]
                    ok = (c[other] != c[row]) & (100 * np.minimum(n[other], n[row]) >= 75 * np.maximum(n[other], n[row]))
                    if i != j:
                        ok &= block[other] != block[row]
                    some = np.flatnonzero(ok) + k + 1
                    if len(some):
                        some = some[7 * np.bitwise_count(bits[some] ^ bits[k]).sum(axis=1, dtype=np.int64) <= n[rows[some]] + n[row]]
                    if len(some):
                        other = node[rows[some]]
                        held.append(np.column_stack([np.minimum(node[row], other), np.maximum(node[row], other)]))
                        size += len(some)
            if size > PAIRS:
                yield pairs()
                held, size = [], 0
    if held:
        yield pairs()


class _Join:
    """The tables of one join: rows described, classes, members of signature groups, sets of the classes in them."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark = spark
        rows = common.texts(docs)
        described = common.keep(spark, common.frames(rows.withColumn("mark", F.xxhash64("text")), _describe, "doc_id long, mark long, n_shingles long, set_key binary, tag long"), "described")
        self.rows = described.select("doc_id", "mark", "n_shingles", "set_key")
        classes = described.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("tag").alias("tag"))
        self.classes = common.keep(spark, classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        n = common.buckets(spark, docs)
        frequent = frequent_signatures(spark, rows)
        sent = common.dealt(common.frames(rows, lambda it: _send(it, n, frequent), SENT), n, "bucket")
        met = common.dealt(common.frames(sent, lambda it: _groups(it, n, frequent), "dest int, doc binary, value binary"), n, "dest")
        self.members = common.keep(spark, common.frames(met, _retain, "g long, tag long, often int"), "members")
        wanted = self.classes.join(self.members.select("tag").distinct(), "tag", "left_semi").select(F.col("rep").alias("doc_id"), "node", "tag", "set_key")
        read = common.frames(rows.join(wanted, "doc_id"), _read, "node long, tag long, n int, bits binary, set binary")
        self.sets = common.keep(spark, read.dropDuplicates(["node"]), "sets")
        self.centres = common.keep(spark, self.members.groupBy("g").agg(F.max(F.struct("often", "tag"))["tag"].alias("centre")), "centres")
        self.kept = [described, self.classes, self.members, self.sets, self.centres]

    def verified(self, near: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) of classes: the links."""
        side = lambda c: self.sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
        out = common.keep(self.spark, common.frames(near.join(side("b"), "b").join(side("a"), "a"), _verify, "a long, b long"), "links")
        self.kept.append(out)
        return out

    def central(self) -> DataFrame:
        """Links of each group's central class: the one in most groups. A text of which others are
        variants shares more with them than they do with each other."""
        pairs = self.members.join(self.centres, "g").filter("tag <> centre").select(F.least("tag", "centre").alias("ta"), F.greatest("tag", "centre").alias("tb")).distinct()
        side = lambda c: self.sets.select(F.col("tag").alias(f"t{c}"), F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
        told = pairs.join(side("a"), "ta").join(side("b"), "tb").filter("100 * least(na, nb) >= 75 * greatest(na, nb)")
        near = common.keep(self.spark, common.frames(told.select("a", "b", "na", "nb", "bits_a", "bits_b"), _sieve, "a long, b long"), "candidates")
        out = self.verified(near)
        common.forget(self.spark, near)
        return out

    def across(self, component: DataFrame | None) -> DataFrame:
        """Links between classes of different components (node, component) that share a group; None: each class is one."""
        label = self.sets.select("tag", "node")
        if component is None:
            label = label.withColumn("c", F.col("node"))
        else:
            label = label.join(component, "node", "left").select("tag", "node", F.coalesce("component", "node").alias("c"))
        told = common.keep(self.spark, self.members.join(label, "tag").select("g", "node", "c"), "told")
        mixed = told.groupBy("g").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("g")
        mixed = common.keep(self.spark, mixed.join(self.centres, "g"), "mixed")
        near_to = common.keep(self.spark, told.join(mixed, "g").select("centre", "node", "c").distinct(), "near-to")
        blocks = common.keep(self.spark, near_to.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "blocks")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
        apart = near_to.join(blocks, "centre").select("centre", "node", "c", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        apart = apart.select("centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "c", "block")
        apart = apart.join(self.sets.select("node", "n", "bits"), "node")
        met = apart.groupBy("centre", "i", "j").agg(F.collect_list(F.struct("node", "c", "n", "block", "bits")).alias("x")).select("i", "j", "x")  # two blocks
        near = common.keep(self.spark, common.frames(met, _cross, "a long, b long").distinct(), "candidates")
        out = self.verified(near)
        common.forget(self.spark, near, told, mixed, near_to, blocks)
        return out

    def done(self, *but: DataFrame) -> None:
        common.forget(self.spark, *[x for x in self.kept if x._lodestone_path not in {b._lodestone_path for b in but}])


def linked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, mark (64 bits of the text), n_shingles, component_id, component.

    ``component`` tells components apart whose least ids are the same; null for a row that links with nothing
    for want of shingles or an id.
    """
    join = _Join(spark, docs)
    first = join.central()
    comp = common.keep(spark, graph.components(spark, first), "components")
    second = join.across(comp)
    if not second.isEmpty():
        common.forget(spark, comp)
        comp = common.keep(spark, graph.components(spark, first.unionByName(second)), "components")
    # Only classes with a link are in `comp`; the others are their own component.
    told = join.classes.select("node", "set_key", "rep").join(comp, "node")
    least = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = told.join(least, "component").select("set_key", "component", "component_id")
    all_of = join.classes.select("set_key", "rep", "node").join(told, "set_key", "left").select("set_key", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    all_of = common.keep(spark, all_of, "class-components")  # a table: the next join may then split a large class
    common.forget(spark, comp)
    join.done(join.kept[0])
    some = join.rows.filter("set_key IS NOT NULL").join(all_of, "set_key").select("doc_id", "mark", "n_shingles", "component_id", "component")
    alone = join.rows.filter("set_key IS NULL").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return some.unionByName(alone)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links).

    A null or empty text has no shingles and is alone; a text of fewer than five words has one
    shingle, its whole word sequence; equal texts link; rows that repeat an id are documents of their
    own, which share nothing but the id unless their texts link; a null id is linked with nothing
    and its component is null; any 64-bit id is exact; texts of any length are taken whole; an empty table
    yields an empty result; other columns are ignored.
    """
    return linked(spark, docs).select("doc_id", "n_shingles", "component_id")


def redundant(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and mark of the rows of ``docs`` that go if of each component only the first document (by id, then mark) stays."""
    rows = common.keep(spark, linked(spark, docs).filter("component IS NOT NULL").select("doc_id", "mark", "component"), "linked")
    own = F.struct("doc_id", "mark")
    first = rows.groupBy("component").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first < last").select("component", "first")
    first = common.keep(spark, first, "first")
    return rows.join(first, "component").filter(own > F.col("first")).select("doc_id", "mark").distinct()


def class_links(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, each compared whatever the components are: membership and links.

    Membership, per row of ``docs``: doc_id, n_shingles, class_id (the least id with the same set of
    shingles; its members are linked), n_links (other classes that this one is linked with).
    Links: a, b, class ids, each pair of classes once.  Their number grows with the square of a near-copy group.
    A null id has a null class and no links; otherwise as in :func:`near_duplicates`.
    """
    join = _Join(spark, docs)
    found = join.across(None)
    counts = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = common.keep(spark, join.classes.select("node", "set_key", F.col("rep").alias("class_id")).join(counts, "node", "left").select("node", "set_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    side = lambda c: classes.select(F.col("node").alias(c), F.col("class_id").alias(f"class_{c}"))
    links = found.join(side("a"), "a").join(side("b"), "b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
    some = join.rows.filter("set_key IS NOT NULL").join(classes, "set_key").select("doc_id", "n_shingles", "class_id", "n_links")
    alone = join.rows.filter("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    join.done(join.kept[0], found)
    return some.unionByName(alone), links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM d UNION SELECT r.doc_id, d.b FROM r JOIN d ON d.a = r.reached),
c AS (SELECT doc_id, min(reached) AS m FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
