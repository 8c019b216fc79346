import duckdb
from pyspark.sql import functions as F

from keyloom.operators import structures
from keyloom.plans import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_set_add_of_members_that_are_all_there(spark, tmp_path):
    events = spark.range(2500).select(F.col("id").alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.SQL["set_add"]).fetchall()
    assert rows(registry.QUERIES["set_add"](spark, str(tmp_path)).select("key", "added")) == want == [("view", 0)]


def test_every_asked_key_has_its_number(spark):
    pairs = lambda of, *p: spark.createDataFrame(list(p), f"key string, {of} string")
    old, asked = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], [("a", "x"), ("a", "z"), ("a", "z"), ("b", "x"), ("n", "x")]
    added, removed = [("a", 1), ("b", 0), ("n", 1)], [("a", 1), ("b", 1), ("n", 0)]
    there, new = pairs("member", *old), pairs("member", *asked)
    left, n = structures.set_add(there, new)
    assert rows(n) == added and rows(left) == sorted([*old, ("a", "z"), ("n", "x")])
    left, n = structures.set_remove(there, new)
    assert rows(n) == removed and rows(left) == [("a", "y"), ("c", "x")]
    there, new = (df.distinct().withColumn("value", F.lit("v")) for df in (pairs("field", *old), pairs("field", *asked)))
    assert rows(structures.hash_set(there, new)[1]) == added
    assert rows(structures.hash_delete(there, new.select("key", "field"))[1]) == removed
    scored = lambda p: spark.createDataFrame([(k, i, m, 1.0) for i, (k, m) in enumerate(p)], "key string, pos int, member string, score double")
    assert rows(structures.zset_add(scored(old).drop("pos"), scored(asked))[1]) == added
    assert rows(structures.zset_add(scored(old).drop("pos"), scored(asked), only_old=True)[1]) == [("a", 0), ("b", 0), ("n", 0)]
