import __spark_entry__ as entry
from lodestone.plans import queries
from lodestone.streaming import events as streaming


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("u", "a", 5.0, "2024-01-01 00:00:00", "same"), ("u", "b", 5.0, "2024-01-01 01:00:00", "Same!"), ("v", "a", 4.0, "2024-01-01 02:00:00", "x"), ("v", "c", 1.0, "2024-01-01 03:00:00", "y")]
    df = spark.createDataFrame(rows, "UserId string, ProductId string, Score double, t string, Summary string").selectExpr("UserId", "ProductId", "Score", "CAST(t AS timestamp) AS ts", "Summary", "'' AS Text")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    kept = run(spark, streaming.drop_copies(stream()), "kept", "append")
    assert sorted((r["UserId"], r["ProductId"]) for r in kept) == [("u", "a"), ("v", "a"), ("v", "c")]
    pop = run(spark, streaming.popularity(stream()), "pop", "complete")
    assert {r["ProductId"]: r["n"] for r in pop} == {"a": 2, "b": 1}


def test_entry_lists_its_queries():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.QUERIES) <= set(known) and set(sql) <= set(known)
