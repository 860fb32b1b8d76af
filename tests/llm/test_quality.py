import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from lodestone.llm import quality_classifier as qc
from lodestone.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(win)
    inside = {j for k, w in enumerate(win) if count[w] > 1 for j in range(k, k + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def texts():
    rng = random.Random(6)
    words = ["a", "b", "c", "dé", "##", "<x>", "e|"]
    out = [None, "", " \n\t", "one", "a b c d e a b c d e", "x\nx\n\n \nx \ny", " a b c", "w " * 5000]
    for _ in range(150):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randrange(60))))
    for _ in range(40):
        out.append(" ".join(f"t{rng.randrange(400)}" for _ in range(40)))
    return out


def test_rules_against_brute_force(spark):
    own = texts()
    rows = list(enumerate(own)) + [(None, "no id here at all but ten words or more in it"), (3, own[3])]
    docs = spark.createDataFrame([(i, t, 1, False) for i, t in rows], "doc_id long, text string, n_words int, kept boolean").repartition(3)
    good = spark.createDataFrame([(len(own) - k,) for k in range(1, 41)] + [(None,)], "doc_id long")
    got = qr.quality_rules(spark, docs, good).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(own[r["doc_id"]]), own[r["doc_id"]]
    # The ratio, word by word.
    raw, target = Counter(), Counter()
    buckets = lambda t: qr.grams(qr.word_hashes((t or "").encode().split())).tolist() if (t or "").split() else []
    for i, t in rows:
        raw.update(buckets(t))
        if i is not None and i >= len(own) - 40:
            target.update(buckets(t))
    nr, nt = sum(raw.values()) + qr.BUCKETS, sum(target.values()) + qr.BUCKETS
    for r in got:
        if r["doc_id"] is not None and (b := buckets(own[r["doc_id"]])):
            want = np.mean([np.log((target[x] + 1) / nt) - np.log((raw[x] + 1) / nr) for x in b])
            assert abs(r["llr"] - want) < 1e-9
            assert r["kept"] == (not r["base_failed"] and r["llr"] >= qr.THRESHOLD)
    assert all(r["llr"] > qr.THRESHOLD for r in got if r["doc_id"] is not None and r["doc_id"] >= len(own) - 40)


def test_rules_without_trust(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["llr"]) for r in qr.quality_rules(spark, docs, docs.select("doc_id").limit(0)).collect()}
    assert got == {1: (True, 0.0), 2: (False, 0.0)}
    assert qr.quality_rules(spark, docs.limit(0), docs.select("doc_id")).count() == 0


def brute_classifier(texts, labels):
    """The classifier token by token and feature by feature, in double precision; only the feature hash, the start and the order of steps are the operator's."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / qc.DIM, 1 / qc.DIM, (qc.BUCKETS, qc.DIM)).astype(np.float32).astype(float)
    layer, bias = np.zeros((2, qc.DIM)), np.zeros(2)

    def tokens(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = []
        for k, w in enumerate(words):
            grams = [f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
            out.append([crc32(w.encode(), 1) % qc.BUCKETS] + [crc32(g.encode()) % qc.BUCKETS for g in grams])
            if k and w == words[k - 1]:
                out.append([crc32(b"\n=", 1) % qc.BUCKETS])
        return out

    def weights(text):
        own = tokens(text)
        share = Counter()
        for t in own:
            for f in t:
                share[f] += 1 / (len(t) * len(own))
        return share

    def chances(text):
        mean = sum((w * vectors[f] for f, w in weights(text).items()), np.zeros(qc.DIM))
        z = layer @ mean + bias
        return mean, np.exp(z) / np.exp(z).sum()

    done, steps = 0, qc.EPOCHS * len(texts)
    for _ in range(qc.EPOCHS):
        for k in rng.permutation(len(texts)):
            rate = qc.RATE * (1 - done / steps)
            done += 1
            if share := weights(texts[k]):
                mean, p = chances(texts[k])
                p[labels[k]] -= 1
                back = p @ layer
                layer -= rate * np.outer(p, mean)
                bias -= rate * 0.1 * p
                for f, w in share.items():
                    vectors[f] -= rate * np.sqrt(w) * back
    return lambda text: chances(text)[1][1]


def test_classifier_against_brute_force(spark):
    rows = corpus(60) + [(1000, "éa éa naïve 中文字 x", 1), (1001, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in qc.score(spark, docs, qc.fit(spark, docs, labels)).collect()}
    own = {i: (t, q) for i, t, q in rows if crc32(str(i).encode()) % 5}
    score = brute_classifier([own[i][0] for i in sorted(own)], [own[i][1] for i in sorted(own)])
    assert all(abs(got[i] - score(t)) < 1e-3 for i, t, _ in rows)


def test_ids_are_exact(spark):
    big, low = (1 << 60) + 1, -(1 << 63)
    docs = spark.createDataFrame([(i, "a b c") for i in (big, big + 2, None, low)], "doc_id long, text string").coalesce(1)
    model = qc.fit(spark, docs, spark.createDataFrame([], "doc_id long, quality int"))
    for df in (qc.score(spark, docs, model), qr.quality_rules(spark, docs, docs.select("doc_id").limit(0))):
        assert {r["doc_id"] for r in df.collect()} == {big, big + 2, None, low}


def corpus(n):
    rng = random.Random(2)
    good, bad = [f"wal{k}d" for k in range(300)], [f"zz{k}%%" for k in range(300)]
    rows = []
    for i in range(n):
        q = int(rng.random() < 0.6)
        rows.append((i, " ".join(rng.choice(good if q or rng.random() < 0.5 else bad) for _ in range(rng.randrange(5, 60))), q))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(400)
    extra = [(1000, None), (1001, ""), (1002, "x" * 300_000), (None, "wal1d")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(*r, 0.1) for r in extra], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = qc.fit(spark, docs, labels)
    got = {r["doc_id"]: r["score"] for r in qc.score(spark, docs, model).collect()}
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for s in got.values())
    held = [(q, got[i]) for i, _, q in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= qc.THRESHOLD) == q for q, s in held]) > 0.95
    assert got[1000] == got[1001] == 1 / (1 + np.exp(-model.bias))
    own = {i: t for i, t, _ in rows}
    direct = qc.score_texts([own[3]], model, model.weight.tolist(), {})[0]
    assert abs(direct - got[3]) < 1e-12


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    fold = lambda i: crc32(str(i).encode()) % 5 == 0
    labels = lambda flip: spark.createDataFrame([(i, 1 - q if flip and fold(i) else q) for i, _, q in rows], "doc_id long, quality int")
    a, b = qc.fit(spark, docs, labels(False)), qc.fit(spark, docs, labels(True))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = qc.fit(spark, docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert qc.score(spark, docs, model).first()["score"] == 0.5
    assert qc.score(spark, docs.limit(0), model).count() == 0


def test_all_trusted_rows_count(spark):
    """If all documents are trusted, both multinomials are the same, however many there are."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id % 11) AS text")
    assert not qr.ratios(spark, docs, docs.select("doc_id").unionByName(docs.select("doc_id"))).any()
