import hashlib
import random

import numpy as np
from lodestone.llm import exact_dedup as ed

WHITE = " \t\n\v\f\r"


def brute(rows):
    by = {}
    for i, t in rows:
        t = t or ""
        by.setdefault("".join(c for c in t if c not in WHITE), []).append((-len(t), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in by.items() for _, i in g}


def corpus():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(12))) for _ in range(60)]
    rows = [(i, "".join(c + rng.choice(["", "", " ", "\n"]) for c in rng.choice(base))) for i in range(300)]
    return rows + [(300, None), (301, ""), (302, " \t"), (303, " "), (304, "x" * 200_000), (305, "x " * 200_000)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(3)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in ed.exact_dedup(spark, docs).collect()}
    assert got == brute(rows)


def test_history(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, new = docs.filter("doc_id < 150"), docs.filter("doc_id >= 150")
    want = brute(rows)
    got = {r["doc_id"]: r for r in ed.exact_dedup(spark, new, ed.signatures(old)).collect()}
    before = {want[i][3] for i, _ in rows if i < 150}
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == {i: w for i, w in want.items() if i >= 150}
    assert all(r["known"] == (r["text_sha256"] in before) for r in got.values())


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 1000, 50_000):
        d = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
        h, slots = ed.PerfectHash.build(d)
        assert sorted(slots.tolist()) == list(range(n))
        if n:
            assert (h.lookup(d) == slots).all()
            strange = h.lookup(rng.integers(0, 1 << 63, (50, 4)).astype(np.uint64))  # strangers get some slot
            assert ((0 <= strange) & (strange < n)).all()


def test_lookups_decide(spark, monkeypatch):
    """Without the index's answers members would come out as groups of their own."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sig = ed.common.keep(spark, ed.signatures(docs), "sig")
    old, new = sig.filter("doc_id < 150"), sig.filter("doc_id >= 150")
    index = ed.build(spark, old, 4)
    found = ed.resolve(spark, index, new, 4)
    assert found.count() == found.select("digest").distinct().count() == len({w[3] for w in brute(rows).values()})
    blind = index.selectExpr("shard", "shift", "cast(repeat('x', length(digests)) as binary) as digests", "groups")  # slots that hold other digests
    broken = ed.resolve(spark, blind, new, 4)
    assert broken.filter("known").agg({"group_size": "sum"}).first()[0] == 150 < found.filter("known").agg({"group_size": "sum"}).first()[0]


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"] or False) for r in ed.exact_dedup(spark, docs).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert ed.exact_dedup(spark, docs.limit(0)).count() == 0


def test_extreme_ids(spark):
    big = 1 << 60
    rows = [(big + 1, "a"), (big + 3, "a"), (None, "b"), (-(1 << 63), "c"), ((1 << 63) - 1, "c"), (-(1 << 63) + 1, "c"), (5, "a b"), (6, "ab")]
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in ed.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    low = -(1 << 63)
    assert got == {(big + 1, big + 1, True), (big + 3, big + 1, False), (None, None, True), (low, low, True), ((1 << 63) - 1, low, False), (low + 1, low, False), (5, 5, True), (6, 5, False)}
