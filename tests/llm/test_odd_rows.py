"""Each operator on one table of odd rows: extreme ids beside a null one, an id with two texts, a very long text, clashing columns."""

import random

import pytest
from lodestone.llm import exact_dedup, jaccard_join, sentencepiece_codec, substring_dedup, suffix_dedup

BIG, LOW = (1 << 60) + 1, -(1 << 63)
rng = random.Random(12)
text = lambda n=40: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
ONE, OWN, LONG = text(), text(), text(150_000)
ROWS = [(1, ONE), (2, ONE), (2, OWN), (BIG, text()), (BIG + 2, text()), (None, ONE), (LOW, text()), (4, None), (5, ""), (6, LONG), (7, LONG + " end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2.5) for i, t in ROWS], "doc_id long, text string, bucket int, found string, mark double").repartition(2).persist()


def rows_of(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=repr)


def expected(fact):
    return sorted(((i, *fact(i, t)) for i, t in ROWS), key=repr)


def test_sentencepiece(docs):
    assert rows_of(sentencepiece_codec.codec_table(docs, sentencepiece_codec.default_model()), "decoded") == expected(lambda i, t: (t or "",))


def test_jaccard_join(spark, docs):
    size = lambda t: len(t.split()) - 4 if t else 0
    first = lambda i, t: 1 if t == ONE and i else 6 if t and len(t) > 10_000 else i
    assert rows_of(jaccard_join.near_duplicates(spark, docs), "n_shingles", "component_id") == expected(lambda i, t: (size(t), first(i, t)))
    gone = {(r["doc_id"]) for r in jaccard_join.redundant(spark, docs).collect()}
    assert gone == {2, 7}


def test_suffix_dedup(spark, docs):
    # Of document 7 that is left which no 100-byte string of document 6 covers.
    kept = lambda i, t: "" if (i, t) == (2, ONE) else " end" if i == 7 else t or ""
    got = [(i, bytes(k).decode()) for i, k in rows_of(suffix_dedup.suffix_dedup(spark, docs), "kept")]
    assert sorted(got, key=repr) == expected(lambda i, t: (kept(i, t),))


def test_substring_dedup(spark, docs, monkeypatch):
    want = expected(lambda i, t: ("" if (i, t) == (2, ONE) else "end" if i == 7 else t or "",))
    assert rows_of(substring_dedup.substring_dedup(spark, docs), "kept_text") == want
    monkeypatch.setattr(substring_dedup, "FREQUENT", 0.0)  # every anchor and window of two documents counts as frequent
    assert rows_of(substring_dedup.substring_dedup(spark, docs), "kept_text") == want


def test_frequent_signatures(spark, docs, monkeypatch):
    """Every signature of two documents counts as frequent: the links are the same."""
    want = rows_of(jaccard_join.near_duplicates(spark, docs), "component_id")
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0.0)
    assert len(jaccard_join.frequent_signatures(spark, jaccard_join.common.texts(docs))) > 10
    assert rows_of(jaccard_join.near_duplicates(spark, docs), "component_id") == want


def test_exact_dedup(spark, docs):
    keep = lambda i, t: 1 if t == ONE else 4 if not t else i
    assert rows_of(exact_dedup.exact_dedup(spark, docs), "keep_id") == expected(lambda i, t: (keep(i, t),))
