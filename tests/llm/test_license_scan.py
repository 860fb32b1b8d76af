import random
import re

from lodestone.llm import license_scan as ls


def brute(rows):
    out = {}
    for i, t in rows:
        w = re.sub("[^A-Za-z0-9]+", " ", t or "").strip(" ").lower().split(" ")
        s = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        for name, text in ls.TEMPLATES.items():
            want = set(ls.template_shingles(text))
            m = len(want)
            for b in range(0, len(s), m):
                n = len(set(s[b : b + 2 * m]) & want)
                if n >= 0.75 * m and n > out.get((i, name), (0, 0))[0]:
                    out[i, name] = (n, b)
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = "the of and under licensed this work is to use permission foo bar".split()
    texts = [None, "", " ", "Released under the MIT License.", "released UNDER the, mit -- license", "Released under the MIT"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(list(ls.TEMPLATES.values())).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            parts += w if rng.random() < 0.6 else w[: len(w) // 2]
            parts += [rng.choice(vocab) for _ in range(rng.randrange(60))]
        texts.append(" ".join(parts))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, w string, m int")
    got = {(r["doc_id"], r["license"]): (r["n_shared"], r["first_word"]) for r in ls.license_scan(spark, docs).collect()}
    assert got == brute(rows)
    assert ls.license_scan(spark, docs.limit(0)).count() == 0


def test_odd_rows(spark):
    """Null and repeated ids, a long text, clashing columns, and templates of one's own."""
    mit = ls.TEMPLATES["mit-notice"]
    big = (1 << 60) + 1
    rows = [(big, mit), (big, mit), (None, "x " + mit), (big + 2, ("w " * 300_000) + mit), (7, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, bands int")
    got = sorted((r["doc_id"] or 0, r["license"], r["n_shared"], r["first_word"]) for r in ls.license_scan(spark, docs).collect())
    assert got == [(0, "mit-notice", 1, 0), (big, "mit-notice", 1, 0), (big + 2, "mit-notice", 1, 299_999)]
    own = ls.template_table(spark, {"own": "one two three four five six seven", "short": "one two"})
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight"), (2, "one two three four")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["n_shared"]) for r in ls.license_scan(spark, docs, own).collect()] == [(1, "own", 3)]
    assert ls.license_scan(spark, docs, own.limit(0)).count() == 0


def test_bands_retrieve(spark):
    """The index holds just the shingles that are least under a function, and other bands find other windows."""
    for r in ls._index(ls.template_table(spark)).collect():
        assert 1 <= len(r["keys"]) <= min(ls.BANDS, r["m"])
        assert len(set(r["bands"])) == ls.BANDS
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ls.TEMPLATES.values())], "doc_id long, text string")
    assert ls.license_scan(spark, docs).select("doc_id").distinct().count() == len(ls.TEMPLATES)


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = ls.license_scan(spark, docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow[A-Z]", plan)
