import random
import re

from lodestone.llm import substring_dedup as sd


def brute(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_cover():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in sd.COVER and (j + d) % 7 in sd.COVER for d in range(7))


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([10, 12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = [(-1, None), (-2, ""), (-3, "a " * 500), (-4, "a " * 20), (500, "a\n" * 15 + "é")]
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(40))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(200 + i, rows[10 + i][1]) for i in range(8)] + [(300, rows[10][1]), (301, (rows[11][1] or "").replace(" ", "\t") + " ")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, found string, bucket int").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in sd.substring_dedup(spark, docs).collect()}
    assert got == brute(rows)


def test_edge_tables(spark):
    assert sd.substring_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(map(str, range(20)))
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in sd.substring_dedup(spark, spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20)]
