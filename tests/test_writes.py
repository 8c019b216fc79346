import pytest
from pyspark.sql import functions as F

from keyloom.operators import compare, logs, objects, tables


@pytest.fixture(scope="module")
def t(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "b", {"x": 1, "l": [1, 2]}, 5)], "id int, name string, meta struct<x:int,l:array<int>,deep:struct<y:string>>, n int")
    return tables.Table("t", rows, "id")


def test_set_makes_containers(spark, t):
    ids = t.rows.select("id")
    rows = lambda text, **v: {r.id: r.meta for r in tables.update_items(t, ids, text, values=v)[0].collect()}
    done = rows("SET meta.x = :v", **{":v": 7})
    assert done[1].x == 7 and done[1].l is None and done[2].x == 7 and done[2].l == [1, 2]
    done = rows("SET meta.l[9] = :v", **{":v": 7})
    assert done[1].l == [7] and done[2].l == [1, 2, 7]
    done = rows("SET meta.deep.y = :v", **{":v": "in"})
    assert done[1].deep.y == "in" and done[2].deep.y == "in" and done[2].x == 1


def test_a_transaction_is_all_or_nothing(spark, t):
    one = lambda k: spark.createDataFrame([(k,)], "id int")
    with pytest.raises(tables.ConditionFailed):
        tables.transact_write(t, deletes=one(1), updates=[(one(2), "SET n = :v", "n = :w")], values={":v": 1, ":w": 6})
    with pytest.raises(tables.ConditionFailed):
        tables.transact_write(t, checks=[({"id": 2}, "attribute_not_exists(name)")], updates=[(one(1), "SET n = :v", None)], values={":v": 1})
    with pytest.raises(tables.ExpressionError):
        tables.transact_write(t, deletes=one(2), updates=[(one(2), "SET n = :v", None)], values={":v": 1})
    done = tables.transact_write(t, one(3).withColumn("name", F.lit("c")), one(1), [({"id": 3}, "attribute_not_exists(name)")], values={":v": 1, ":w": 5}, updates=[(one(2), "SET n = n + :v", "n = :w")])
    assert {(r.id, r.name, r.n) for r in done.collect()} == {(2, "b", 6), (3, "c", None)}


def test_contended_requests_come_back(spark, t):
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id int")
    rows, left = tables.batch_write_partial(t, None, ids(1, 2), ids(2, 2, 9))
    assert [r.id for r in rows.collect()] == [2] and [tuple(r) for r in left.collect()] == [("delete", 2)]


def test_given_ids_must_follow(spark):
    rows = spark.createDataFrame([("a", 5, 1, "x")], "key string, ms long, seq long, fields string")
    new = spark.createDataFrame([("a", 0, 5, 1), ("a", 1, 6, 0), ("a", 2, 5, 9), ("a", 3, 6, 1), ("b", 0, 0, 0), ("b", 1, 0, 1)], "key string, pos int, ms long, seq long").withColumn("fields", F.lit("y"))
    taken, rejected = logs.log_add_given(rows, new)
    assert {(r.key, r.ms, r.seq) for r in taken.collect()} == {("a", 5, 1), ("a", 6, 0), ("a", 6, 1), ("b", 0, 1)}
    assert {(r.key, r.pos) for r in rejected.collect()} == {("a", 0), ("a", 2), ("b", 0)}
    kept = logs.log_add_given(rows, new, 1)[0].collect()
    assert {(r.key, r.ms, r.seq) for r in kept} == {("a", 6, 1), ("b", 0, 1)}


def test_paths_of_any_depth_and_circles(spark):
    chain = [(i, "d", i + 1) for i in range(40)]
    e = spark.createDataFrame([*chain, (40, "back", 3), (3, "leaf", 99)], "parent long, name string, inode long")
    got = {r.path: r.inode for r in objects.resolve_paths(e).collect()}
    assert got["/d" * 40] == 40 and got["/d" * 40 + "/back"] == 3 and got["/d/d/d/leaf"] == 99 and len(got) == 42
    assert objects.resolve_paths(e.limit(0)).count() == 0


def test_routing_table_has_every_command_once():
    words = [w for text in compare.ROUTING.values() for w in text.split()]
    assert len(words) == len(set(words)) == 196
