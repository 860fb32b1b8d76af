import pytest
from lodestone.config import Settings
from lodestone.functions.text import normalise
from lodestone.operators import prepare, split
from lodestone.sources import reviews
from pyspark.sql import functions as F

RAW = "UserId string, ProductId string, Score double, Time double, Summary string, Text string"


@pytest.fixture
def raw(spark):
    names = {"a": "apple tea", "b": "berry tea", "c": "cocoa tea"}
    rows = [(u, p, 2.0 if (u, p) == ("u1", "c") else {"a": 5.0, "b": 4.0, "c": 5.0}[p], float(t), names[p], names[p]) for u in ("u1", "u2", "u3") for t, p in enumerate("abc", 1)]
    return spark.createDataFrame([*rows, ("u1", "alias-a", 5.0, 1.0, "apple tea", "apple tea")], RAW)


def test_prepare_counts(raw):
    out, report = prepare.prepare(raw, Settings(min_user_interactions=2, min_item_interactions=2))
    assert report.to_dict() == {"raw_rows": 10, "after_required_values": 10, "after_copy_removal": 9, "after_pair_aggregation": 9, "after_k_core": 9, "users": 3, "items": 3, "positive_fraction": pytest.approx(8 / 9), "k_core_rounds": 1}
    assert out.filter("item_id = 'alias-a'").count() == 0
    s = split.per_user_split(out)
    assert [{r["item_id"] for r in x.collect()} for x in (s.train, s.validation, s.test)] == [{"a"}, {"b"}, {"c"}]


def test_default_core_is_empty(raw):
    report = prepare.prepare(raw)[1]
    assert (report.after_k_core, report.k_core_rounds, report.positive_fraction) == (0, 2, 0.0)


def test_bad_and_missing_times(spark):
    df = spark.createDataFrame([("u", "a", 5.0, "abc"), ("u", "b", 5.0, None), ("u", "c", 5.0, "7")], "UserId string, ProductId string, Score double, Time string")
    report = prepare.prepare(df, Settings(1, 1))[1]
    assert (report.raw_rows, report.after_required_values, report.after_copy_removal) == (3, 2, 1)


def test_last_row_wins_at_one_time(spark):
    df = spark.createDataFrame([("u", "a", 1.0, 5, 1, "x"), ("u", "a", 4.0, 5, 2, "y"), ("u", "b", 4.0, 1, 3, "y")], "UserId string, ProductId string, Score double, Time long, row_order long, Summary string")
    assert [r["Score"] for r in prepare.last_per_pair(df).orderBy("ProductId").collect()] == [4.0, 4.0]
    kept = prepare.drop_copies(prepare.required_values(df))
    assert {(r["ProductId"], r["Score"]) for r in kept.collect()} == {("a", 1.0), ("b", 4.0)}


def test_blank_texts_are_one_review(spark):
    df = spark.createDataFrame([("u", "a", 5.0, 1), ("u", "b", 5.0, 2)], "UserId string, ProductId string, Score double, Time long")
    assert [r["ProductId"] for r in prepare.drop_copies(prepare.required_values(df)).collect()] == ["a"]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Score"):
        prepare.prepare(spark.createDataFrame([("u",)], "UserId string"))


def test_normalise(spark):
    df = spark.createDataFrame([("<b>Great</b> TEA! see http://x.y/z www.a.b  ok",), (None,), ("a  b É",)], "t string")
    assert [r[0] for r in df.select(normalise(F.col("t"))).collect()] == ["great tea see ok", "", "a b"]


def test_global_split(spark):
    df = spark.createDataFrame([("u", t) for t in range(1, 11)], "user_id string, timestamp long")
    s = split.global_split(df)
    assert [x.count() for x in (s.train, s.validation, s.test)] == [8, 1, 1]
    with pytest.raises(ValueError):
        split.global_split(df, 0.9, 0.8)
    with pytest.raises(ValueError):
        split.global_split(df.limit(1))


def test_too_few_moments(spark):
    with pytest.raises(ValueError):
        split.per_user_split(spark.createDataFrame([("u", 1), ("u", 2)], "user_id string, timestamp long"))


def test_read_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Id,UserId,ProductId,Score,Time,Summary,Text\n1,u1,p1,5,10,"a ""q"" b","two\nlines"\n2,NA,p1,4,11,x,y\n3,u2,p2,3,12,null,\n')
    rows = reviews.read_csv(spark, str(tmp_path / "r.csv")).orderBy("row_order").collect()
    assert [(r["UserId"], r["Score"], r["Summary"], r["Text"]) for r in rows] == [("u1", 5.0, 'a "q" b', "two\nlines"), (None, 4.0, "x", "y"), ("u2", 3.0, None, None)]
    (tmp_path / "bad.csv").write_text("UserId,Score\nu,1\n")
    with pytest.raises(ValueError, match="ProductId"):
        reviews.read_csv(spark, str(tmp_path / "bad.csv"))


def test_settings_from_json():
    assert Settings.from_json('{"k_values": [1, 2], "seed": 7}') == Settings(k_values=(1, 2), seed=7)
    with pytest.raises(ValueError):
        Settings.from_json('{"other": 1}')
