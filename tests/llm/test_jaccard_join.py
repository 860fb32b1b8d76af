import pathlib
import random
import re

import numpy as np
from lodestone.llm import jaccard_join as jj


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        size = rng.choice([1, 3, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120, 300])
        if kind < 0.45 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w) + 1)
                if rng.random() < 0.5:
                    w[at : at + 1] = [rng.choice(vocab)]
                else:
                    w[at:at] = [rng.choice(vocab)]
            texts.append(" ".join(w))
        elif kind < 0.75:
            texts.append(" ".join([rng.choice(vocab) for _ in range(size)] + passage + [rng.choice(vocab) for _ in range(size // 3)]))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(size)))
    texts += ["", None, " \n ", "A b", "a  B", "a b c d E", "A B c\td e", "É x y z w", "é x y z w"]
    return list(enumerate(texts))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(1, 200))
        a = rng.integers(0, 1 << 63, x).astype(np.uint64)
        drop, add = int(rng.integers(0, x // 4 + 1)), int(rng.integers(0, x // 4 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        sig, who, spare = jj.signatures([a, b])
        if jj.links(len(a), len(b), both):
            # In one instance they share more than either can spare.
            common = [[x for x in set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()) if x % 2 == p] for p in (0, 1)]
            assert any(len(common[p]) > max(spare[:, p]) for p in (0, 1))
            assert jj.may_link(len(a), len(b), jj.bitmap(a), jj.bitmap(b))


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_shingles int, rep string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.near_duplicates(spark, docs.repartition(3)).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    rows = corpus(2, 120)
    rng = random.Random(9)
    base = [f"q{k}" for k in range(80)]
    for k in range(40):  # a chain of near copies: neighbours link, the ends don't
        w = list(base)
        for j in range(k):
            w[j * 2] = f"z{j}"
        rows.append((1000 + k, " ".join(w)))
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jj.near_duplicates(spark, docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"]) for r in jj.near_duplicates(spark, docs).collect())
    assert got == [(0, 2), (1, 2), (1, 2), (2, 0)]


def test_all_links(spark):
    """Links in groups that are one component after the first round are compared too."""
    rng = random.Random(4)
    rows = corpus(4, 60)
    base = [f"q{k}" for k in range(300)]
    for k in range(50):  # near copies of one text: all sign with its parts, some link, some don't
        w = list(base)
        for j in rng.sample(range(300), rng.randrange(8)):
            w[j] = f"z{k}_{j}"
        rows.append((1000 + k, " ".join(w)))
    sets = {}
    for i, t in rows:
        sets.setdefault(tuple(jj.shingles(t or "").tolist()) or i, []).append(i)
    known = {min(ids): set(s) if isinstance(s, tuple) else set() for s, ids in sets.items()}
    want = {(a, b) for a in known for b in known if a < b and known[a] & known[b] and jj.links(len(known[a]), len(known[b]), len(known[a] & known[b]))}
    membership, links = jj.class_links(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    told = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in membership.collect()}
    assert told == {i: (min(ids), sum(min(ids) in p for p in want)) for ids in sets.values() for i in ids}


def test_a_bucket_to_a_task(spark):
    """No task gets two buckets; hashed bucket numbers met, four or five in some task."""
    rows = corpus(6, 120)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        join = jj._Join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert len(join.members.inputFiles()) == 16
        join.done()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kept_tables_launch_no_process(spark):
    """A checksum file beside a local file means that chmod was launched for either."""
    kept = jj.common.keep(spark, spark.range(5).toDF("n"), "numbers")
    files = [x.name for x in pathlib.Path(kept._lodestone_path.removeprefix("file:")).iterdir()]
    assert any(x.startswith("part-") for x in files) and not any(x.endswith(".crc") for x in files)
    assert sorted(r["n"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    jj.common.forget(spark, kept)
