import random

import numpy as np
import pandas as pd
import pytest
from lodestone.llm import suffix_dedup as sd


def brute(rows):
    raws = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(raws):
        for k in range(len(raws[i]) - 99):
            first.setdefault(raws[i][k : k + 100], (i, k))
    out = {}
    for i, raw in raws.items():
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 99):
            if first[raw[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, bytes(b for b, g in zip(raw, gone, strict=False) if not g))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeé \n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.choice([90, 99, 100, 101, 130, 160, 400, 900])) for _ in range(14)]
    rows = [(-1, None), (-2, ""), (-3, "x" * 1000), (-4, "x" * 99), (-5, "x" * 100), (900, "ab" * 300), (901, "\0" * 250), (902, "Ment " * 200)]
    for i in range(110):
        parts = [rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.5 else make(rng.randrange(200)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "".join(parts)))
    rows += [(300 + i, rows[12 + i][1]) for i in range(6)] + [(400, rows[12][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(sd, "FLUSH", 50)
        monkeypatch.setattr(sd, "HELD", 50)
        monkeypatch.setattr(sd.common, "buckets", lambda *_: 40)  # splitters inside runs, and runs over several buckets
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, found string, bucket int").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.suffix_dedup(spark, docs).collect()}
    want = brute(rows)
    assert got == want, [(i, got[i][:3], want[i][:3]) for i in want if got[i] != want[i]][:5]


@pytest.mark.parametrize("n", [0, 1, 2, 500, 5000])
def test_multikey_order(n):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (n, 21)).astype(np.uint8)
    rows[:, 3:15] = 7
    rows[n // 2 :: 3] = 200
    order = sd.multikey_order(rows)
    assert sorted(order) == list(range(n))
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)


def test_runs_over_several_buckets():
    """Equal suffixes dealt to different buckets are found by comparing the buckets' edges."""
    lead = b"q" * sd.LEAD
    cuts = np.array([lead + b"\1"] * 3, sd._KEY)
    marks = np.arange(50)
    bucket = sd._deal(np.array([lead + b"\1"] * 50, sd._KEY), marks, cuts)
    assert set(bucket) == {0, 1, 2, 3}
    one = [sd._repeated([pd.DataFrame([(int(b), lead, np.array([7], np.uint32).tobytes(), np.zeros(1, np.uint16).tobytes(), sd.repeats.docs_of([(m, m)]).tobytes())], columns=[c.split()[0] for c in sd.SUFFIX.split(", ")])], 4) for b, m in ((1, 5), (2, 6))]
    got = [pd.concat(list(x)) for x in one]
    assert all(list(g["edge"]) == [lead] and np.frombuffer(g["value"].iloc[0], np.uint32).tolist() == [7] for g in got)


def test_pieces(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.randrange(97, 101) for _ in range(3000))
    whole = sd.anchors(raw)
    monkeypatch.setattr(sd, "PIECE", 400)
    windows = lambda x: {(p, w) for p, f, e in zip(*x, strict=True) for w in range(f, e + 1)}
    assert windows(sd.anchors(raw)) == windows(whole)


def test_edge_tables(spark):
    assert sd.suffix_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(map(str, range(60)))
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in sd.suffix_dedup(spark, spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 110)]


def test_piece_borders(spark, monkeypatch):
    """Windows that begin just behind a piece border are judged, in tasks as they are and in small pieces against brute force."""
    rng = random.Random(5)
    border = sd.PIECE - sd.SIZE + 1
    text = "".join(rng.choices("abcdefghijklmnop", k=sd.PIECE + 500))
    rows = [(1, text), *((2 + k, text[border + k : border + k + sd.SIZE]) for k in range(3))]
    got = {r["doc_id"]: r["n_removed"] for r in sd.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {1: 0, 2: sd.SIZE, 3: sd.SIZE, 4: sd.SIZE}

    monkeypatch.setattr(sd, "PIECE", 400)
    rows = [(i, t or "") for i, t in corpus(3) if len(t or "") < 3000]
    pdf = pd.DataFrame([(i, 0, t, sd.anchors(t.encode())[0].astype(np.uint32).tobytes()) for i, t in rows], columns=["doc_id", "mark", "text", "found"])
    packed = list(sd._compare(sd._contexts([pdf], np.array([], sd._KEY)), 1))
    found = {i: b"" for i, _ in rows}
    for p in packed:
        for doc, value in zip(p["doc"], p["value"], strict=True):
            for i, span in zip(np.frombuffer(doc, sd.DOC)["id"].tolist(), np.frombuffer(value, np.int64).reshape(-1, 2), strict=True):
                found[i] += span.tobytes()
    want = brute(rows)
    for i, t in rows:
        runs = sd.merged(found[i], len(t.encode()))
        assert (int((runs[:, 1] - runs[:, 0]).sum()), len(runs), sd.cut_out(t.encode(), runs)) == want[i][1:], i
        place = sd.anchors(t.encode())[0]
        assert len(np.unique(place)) == len(place)


def test_a_bucket_to_a_task(spark):
    """No task gets two buckets; hashed bucket numbers met, four or five in some task."""
    from pyspark.sql import functions as F

    facts = spark.range(16).select(F.col("id").cast("int").alias("dest"), F.lit(np.array([(1, 1)], sd.repeats.DOC).tobytes()).alias("doc"), F.lit(b"x").alias("value"))
    got = sd.repeats.gathered(facts, 16).select(F.spark_partition_id().alias("task")).collect()
    assert sorted(r["task"] for r in got) == list(range(16))
