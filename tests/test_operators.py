import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyloom.functions import codecs
from keyloom.operators import batches, compare, heatmap, logs, objects, queues, routes, structures, tables, versions
from keyloom.plans.expressions import ExpressionError, canonical_number, condition, key_condition, projection, update
from keyloom.sources import dumps
from keyloom.streaming import flows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- expressions


@pytest.fixture(scope="module")
def items(spark):
    return spark.sql("""SELECT * FROM VALUES
      (1, 'open', 5, array('a', 'b'), named_struct('x', 1, 'l', array(1, 2, 3)), X'0102'),
      (2, 'closed', CAST(NULL AS INT), array('b'), named_struct('x', 2, 'l', array(4)), X'0203'),
      (3, NULL, 7, NULL, NULL, NULL) AS t(id, status, num, tags, meta, blob)""")


@pytest.mark.parametrize(
    "text,values,want",
    [
        ("status = :a", {":a": "open"}, [1]),
        ("NOT status = :a", {":a": "open"}, [2, 3]),
        ("num > :n OR status = :a", {":n": 6, ":a": "closed"}, [2, 3]),
        ("num >= :n AND (status = :a OR attribute_not_exists(status))", {":n": 5, ":a": "open"}, [1, 3]),
        ("num BETWEEN :a AND :b", {":a": 5, ":b": 6}, [1]),
        ("status IN (:a, :b)", {":a": "open", ":b": "x"}, [1]),
        ("contains(tags, :a)", {":a": "a"}, [1]),
        ("contains(status, :a)", {":a": "ose"}, [2]),
        ("begins_with(blob, :a)", {":a": b"\x01"}, [1]),
        ("size(tags) = :n", {":n": 2}, [1]),
        ("size(status) > :n", {":n": 4}, [2]),
        ("meta.x = :n", {":n": 2}, [2]),
        ("meta.l[1] = :n", {":n": 2}, [1]),
        ("attribute_exists(meta.l[2])", {}, [1]),
        ("attribute_type(num, :t)", {":t": "N"}, [1, 3]),
        ("tags = :s", {":s": {"b", "a"}}, [1]),
        ("#s = :a", {":a": "open"}, [1]),
    ],
)
def test_conditions(items, text, values, want):
    met = condition(text, {"#s": "status"}, values, types=dict(items.dtypes))
    assert [r.id for r in items.where(met).orderBy("id").collect()] == want


def test_missing_operands(items):
    lenient = lambda text: [r.id for r in items.where(condition(text, values={":n": 5}, missing="lenient")).orderBy("id").collect()]
    assert lenient("num = :n") == [1, 2] and lenient("num <= :n") == [1, 2] and lenient("num < :n") == [] and lenient("num <> :n") == [3]


@pytest.mark.parametrize("text", ["a =", "a = :none", "(a = :n", "a ? :n", "a = :n AND", "a = :n b", "#no = :n"])
def test_bad_conditions(text):
    with pytest.raises(ExpressionError):
        condition(text, values={":n": 1})


def test_key_conditions():
    k = key_condition("h = :h AND begins_with(r, :p)", "h", "r", values={":h": 1, ":p": "x"})
    assert (k.hash_value, k.op, k.low) == (1, "begins_with", "x")
    assert key_condition("r BETWEEN :a AND :b AND h = :h", "h", "r", values={":h": 1, ":a": 2, ":b": 3}).high == 3
    for text in ("r = :h", "h > :h", "h = :h AND r <> :h", "h = :h AND r > :h AND r < :h", "h = :h AND other = :h"):
        with pytest.raises(ExpressionError):
            key_condition(text, "h", "r", values={":h": 1})


def test_updates(items):
    def after(text, values=None):
        new = update(text, values=values, types=dict(items.dtypes))
        return items.withColumns({c: v for c, v in new.items() if v is not None}).drop(*[c for c, v in new.items() if v is None]).orderBy("id").collect()

    assert [r.num for r in after("SET num = if_not_exists(num, :z) + :n", {":z": 0, ":n": 2})] == [7, 2, 9]
    assert after("SET meta.x = :n", {":n": 9})[0].meta.x == 9
    assert after("SET meta.l[1] = :n", {":n": 9})[0].meta.l == [1, 9, 3] and after("SET meta.l[3] = :n", {":n": 9})[0].meta.l == [1, 2, 3, 9]
    assert after("REMOVE meta.l[0]")[0].meta.l == [2, 3] and "num" not in after("REMOVE num")[0].asDict() and "x" not in after("REMOVE meta.x")[0].meta.asDict()
    assert [r.tags for r in after("ADD tags :s", {":s": {"c"}})] == [["a", "b", "c"], ["b", "c"], ["c"]]
    assert [r.tags for r in after("DELETE tags :s", {":s": {"b"}})] == [["a"], None, None]
    assert [r.num for r in after("ADD num :n", {":n": 1})] == [6, 1, 8]
    assert after("SET num = num - :a - :b", {":a": 4, ":b": 3})[0].num == 4
    both = after("SET status = :s REMOVE num", {":s": "x"})
    assert both[0].status == "x" and "num" not in both[0].asDict()
    with pytest.raises(ExpressionError):
        update("SET a = :n SET b = :n", values={":n": 1})


def test_projection_is_top_level():
    assert projection("a, #b, a.c", {"#b": "x.y"}) == ["a", "x.y", "a.c"] and projection(" ") is None
    assert canonical_number("1.2300E2") == "123" and canonical_number("-0.0") == "0"


# ---- tables


def test_pages_walk_the_table(spark):
    df = spark.createDataFrame([("u1", f"{i:03}", "open" if i % 2 else "closed") for i in range(1, 12)] + [("u2", "001", "open")], "pk string, sk string, status string")
    t = tables.Table("t", df, "pk", ("sk",))
    for forward in (True, False):
        seen, start = [], None
        while True:
            page = tables.query(t, "pk = :p", values={":p": "u1"}, limit=4, start=start, forward=forward)
            seen += [r.sk for r in page.items.collect()]
            start = page.next_key()
            if start is None:
                break
        assert seen == sorted(seen, reverse=not forward) and len(seen) == 11
    page = tables.query(t, "pk = :p", filter="status = :s", values={":p": "u1", ":s": "open"}, limit=2)
    assert page.counts().first() == (1, 2) and page.next_key() == {"pk": "u1", "sk": "002"}
    assert tables.query(t, "pk = :p", values={":p": "u2"}, limit=1).next_key() is None
    with pytest.raises(ExpressionError):
        tables.query(t, "pk = :p", values={":p": "u1"}, limit=0)
    with pytest.raises(ExpressionError):
        tables.scan(t, select="SOME")


def test_writes(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    t = tables.Table("t", df, "id")
    new, results = tables.put_items(t, spark.createDataFrame([(1, "z", 0), (3, "c", 7)], "id int, name string, n int"), "attribute_not_exists(name)")
    assert rows(new) == [(1, "a", 5), (2, "b", 6), (3, "c", 7)] and {(r.id, r.ok) for r in results.collect()} == {(1, False), (3, True)}
    new, results = tables.update_items(t, spark.createDataFrame([(1,), (9,)], "id int"), "SET n = if_not_exists(n, :z) + :o", values={":z": 100, ":o": 1}, returns="ALL_NEW")
    assert rows(new) == [(1, "a", 6), (2, "b", 6), (9, None, 101)]
    with pytest.raises(ExpressionError):
        tables.update_items(t, df.select("id"), "SET id = :z", values={":z": 1})
    with pytest.raises(ExpressionError):
        tables.batch_write(t, spark.createDataFrame([(1, "x", 1), (1, "y", 1)], "id int, name string, n int"))
    with pytest.raises(tables.ConditionFailed):
        tables.transact_write(t, deletes=df.select("id"), checks=[({"id": 1}, "attribute_not_exists(name)")])
    c = tables.Catalog()
    c.create(t)
    c.drop("t")
    assert c.create(tables.Table("t", df, "id")).generation == 2 and c.names() == ["t"] and c.describe(spark, "t").first().hash_key == "id"


def test_key_condition_reaches_the_scan(spark, sf):
    t = tables.Table("orders", spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", ("o_orderdate", "o_orderkey"))
    plan = tables.query(t, "o_custkey = :c", values={":c": 19}, limit=3, project="o_orderkey").items._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,19)" in plan and "TakeOrderedAndProject" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


# ---- versions


def test_expired_newest_version_hides_older_ones(spark):
    log = spark.createDataFrame([("k", 1, "old", False, 0), ("k", 5, "new", False, 8), ("g", 2, "x", False, 0), ("g", 6, None, True, 0)], dumps.LOG)
    seen = lambda ts: {r.key: r.value for r in versions.snapshot(log, ts).collect()}
    assert seen(1) == {"k": "old"} and seen(5) == {"k": "new", "g": "x"} and seen(8) == {}
    with pytest.raises(versions.ReadCompacted):
        versions.snapshot(log, 3, min_retained=4)
    assert rows(versions.compact(log, 5).select("key", "commit_ts")) == [("g", 2), ("g", 6), ("k", 5)]
    put = versions.put(spark.createDataFrame([("k", "mine")], "key string, value string"), 9)
    reads = spark.createDataFrame([("g",)], "key string")
    assert versions.apply_batch(log, put, reads, 5).count() == 4 and versions.apply_batch(log, put, reads, 6).count() == 5
    assert rows(versions.expire(log, spark.createDataFrame([("k",), ("no",)], "key string"), 6, 99).select("key", "expire_at")) == [("k", 99)]


# ---- structures, logs


def test_zset_flags_and_bounds(spark):
    z = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0)], "key string, member string, score double")
    new = spark.createDataFrame([("k", 1, "a", 5.0), ("k", 2, "a", 0.5), ("k", 3, "c", 3.0), ("k", 4, "c", 4.0)], "key string, pos int, member string, score double")
    add = lambda **k: {r.member: r.score for r in structures.zset_add(z, new, **k)[0].collect()}
    assert add() == {"a": 0.5, "b": 2.0, "c": 4.0} and add(only_new=True) == {"a": 1.0, "b": 2.0, "c": 3.0} and add(only_old=True) == {"a": 0.5, "b": 2.0}
    assert add(greater=True) == {"a": 5.0, "b": 2.0, "c": 4.0} and add(less=True) == {"a": 0.5, "b": 2.0, "c": 3.0}
    assert structures.zset_add(z, new)[1].first().added == 1
    with pytest.raises(structures.WrongNumber):
        structures.zset_add(z, new, greater=True, less=True)
    assert structures.score_bound("(3.5") == (3.5, False) and structures.score_bound("-inf")[0] == float("-inf")
    assert structures.zset_range_by_score(z, "-inf", "+inf", -1).count() == 0
    ties = spark.createDataFrame([("k", m, 1.0) for m in "cab"], "key string, member string, score double")
    order = lambda r: [x.member for x in structures.zset_range(ties, 0, -1, r).orderBy("rank").collect()]
    assert order(False) == ["a", "b", "c"] and order(True) == ["c", "b", "a"]


def test_list_ends(spark):
    lists = spark.createDataFrame([("k", i, v) for i, v in enumerate("xyxzx")], "key string, seq long, value string")
    values = lambda df: "".join(r.value for r in df.orderBy("seq").collect())
    assert values(structures.remove_values(lists, "x", 2)) == "yzx" and values(structures.remove_values(lists, "x", -2)) == "xyz" and values(structures.remove_values(lists, "x", 0)) == "yz"
    more = spark.createDataFrame([("k", 0, "1"), ("k", 1, "2"), ("n", 0, "3")], "key string, pos int, value string")
    assert values(structures.push(lists, more, left=True).where("key = 'k'")) == "21xyxzx" and values(structures.push(lists, more).where("key = 'k'")) == "xyxzx12"
    assert values(structures.list_range(lists, -100, 100)) == "xyxzx" and structures.list_range(lists, 3, 1).count() == 0


def test_strings(spark):
    s = spark.createDataFrame([("a", "1", 0), ("b", "x", 0), ("c", "5", 10)], "key string, value string, expire_at_ms long")
    steps = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("n", 1)], "key string, n int")
    assert rows(structures.increment(s, steps, 10).select("key", "value")) == [("a", "3"), ("b", None), ("c", "1"), ("n", "1")]
    with pytest.raises(structures.WrongNumber):
        structures.set_strings(s, s.select("key", "value"), 0, only_new=True, only_old=True)
    new, done = structures.set_strings(s, spark.createDataFrame([("a", "n"), ("c", "n")], "key string, value string"), 10, ttl_ms=5, only_old=True)
    assert {(r.key, r.done) for r in done.collect()} == {("a", True), ("c", False)} and ("a", "n", 15) in rows(new)


def test_glob(spark):
    df = spark.createDataFrame([("ab",), ("a.b",), ("axxb",), ("b",)], "key string")
    assert [r.key for r in structures.keys_like(df, "a*b").collect()] == ["a.b", "ab", "axxb"] and structures.keys_like(df, "a?b").count() == 0


def test_log_ids(spark):
    assert logs.parse_id("5") == (5, 0, True) and logs.parse_id("5", upper=True) == (5, logs.MOST, True) and logs.parse_id("(5-1") == (5, 1, False)
    for bad in ("x", "1-", "-5", str(1 << 65)):
        with pytest.raises(logs.BadId):
            logs.parse_id(bad)
    with pytest.raises(logs.BadId):
        logs.check_next((5, 1), (5, 1))
    df = spark.createDataFrame([("2-1",), ("10-0",), ("bad",), ("2",)], "id string")
    assert [r.id for r in df.orderBy(logs.id_order(F.col("id"))).collect()] == ["bad", "2", "2-1", "10-0"]
    big = spark.createDataFrame([("k", Decimal(logs.MOST), Decimal(1))], "key string, ms decimal(20,0), seq decimal(20,0)")
    assert logs.log_range(big, str(logs.MOST)).count() == 1 and logs.log_range(big, "-", "9").count() == 0


# ---- queues


def test_dedup_edge_and_throttle(spark):
    sent = [0, 299_999, 300_000, 300_001, 600_001, 600_002]
    df = spark.createDataFrame([("q", 1, i, t) for i, t in enumerate(sent)], "queue string, dedup_id long, id long, sent_ms long")
    assert [r.original for r in queues.deduplicate(df).orderBy("id").collect()] == [0, 0, 0, 3, 3, 5]
    asked = spark.createDataFrame([("q", 1, 0, 8), ("q", 2, 0, 4), ("q", 3, 1000, 4)], "queue string, id long, ts_ms long, n long")
    assert [(r.allowed, r.retry_after_s) for r in queues.throttle(asked, 10.0, 2.0).orderBy("id").collect()] == [(True, 0), (False, 1), (True, 0)]


def test_queue_codecs(spark):
    handle = queues.encode_handle(7, "id-é", b"\x00\x01", 3)
    assert queues.decode_handle(handle) == {"generation": 7, "partition": 3, "id": "id-é", "token": b"\x00\x01"}

    def fnv(b):
        h = 2166136261
        for x in b:
            h = (h ^ x) * 16777619 & 0xFFFFFFFF
        return h

    words = ["", "a", "Straße", "x" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", queues.fnv1a32(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: fnv(w.encode()) for w in words}
    assert queues.parse_form("A=1&B.2=y&B.1=x&C.1.Name=n&C.1.Value=v") == {"A": "1", "B": ["x", "y"], "C": [{"Name": "n", "Value": "v"}]}
    assert spark.range(1).select(queues.attributes_digest(F.expr("array(named_struct('name', 'b', 'type', 'String', 'value', 'v'), named_struct('name', 'a', 'type', 'String', 'value', 'w'))")).alias("m")).first().m
    batch = spark.createDataFrame([(i, "x") for i in range(11)], "id int, body string")
    assert queues.check_send_batch(batch).first().code == "too_many" and queues.check_send_batch(batch.limit(2)).first().ok
    m = spark.sql("SELECT map('a.x', 1, 'a.y', 2, 'b', 3) AS m")
    assert m.select(queues.select_attributes(F.col("m"), ["a.*"])).first()[0] == {"a.x": 1, "a.y": 2}


# ---- objects


def test_ranges_and_moves(spark):
    assert objects.parse_range("bytes=2-", 10) == (2, 9) and objects.parse_range("bytes=-3", 10) == (7, 9) and objects.parse_range("bytes=0-99", 10) == (0, 9)
    for bad in ("bytes=-", "bytes=5-2", "bytes=10-", "bytes=1-2,4-5", "bytes=-0"):
        with pytest.raises(objects.BadRange):
            objects.parse_range(bad, 10)
    e = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 3)], "parent long, name string, inode long")
    assert rows(objects.move_entry(e, 0, "a", 0, "b")) == [(0, "b", 1), (1, "c", 3)]
    assert {r.path for r in objects.resolve_paths(e).collect()} == {"/a", "/b", "/a/c"}


# ---- routes, heat map


def test_split_key_cases(spark):
    cases = {1: [(0, "a", "b", 10), (1, "b", "c", 90)], 2: [(0, "a", "b", 90), (1, "b", "c", 10)], 3: [(0, "a", "b", 10), (3, "d", "e", 90)], 4: [(0, "a", "b", 10), (1, "b", "c", 70), (3, "d", None, 20)], 5: [(0, "a", None, 5)]}
    df = spark.createDataFrame([(r, *b) for r, bs in cases.items() for b in bs], "route_id int, sub_bucket int, start string, end string, load long")
    ends = spark.createDataFrame([(r, "a", "e" if r < 4 else None) for r in cases], "route_id int, start string, end string")
    got = {r.route_id: (r.split_key, r.origin) for r in heatmap.split_key(df, ends).collect()}
    assert got == {1: ("c", "p50_mid"), 2: ("b", "p50_first_bucket_hi"), 3: ("d", "p50_last_bucket_lo"), 4: ("c", "p50_mid")}


def test_route_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    r = spark.createDataFrame([(i, f"{i:02}5", f"{i + 1:02}5" if i < 40 else None) for i in range(41)], "id int, start string, end string")
    keys = spark.createDataFrame([(f"{random.Random(i).randrange(700):03}x",) for i in range(200)], "key string")
    small = rows(routes.lookup(keys, r))
    monkeypatch.setattr(routes, "SMALL", 5)
    assert rows(routes.lookup(keys, r).select(*["key", "id", "start", "end"])) == small
    assert routes.faults(r).count() == 0 and routes.faults(r.withColumn("end", F.lit("999"))).count() == 40


def test_space_saving_guarantee(spark):
    rng = random.Random(1)
    data = ["hot"] * 900 + ["warm"] * 400 + [f"k{rng.randrange(3000)}" for _ in range(3000)]
    rng.shuffle(data)
    got = {r.k: (r.n, r.error) for r in heatmap.space_saving(spark.createDataFrame([(x,) for x in data], "k string"), "k", 40).collect()}
    for key in ("hot", "warm"):
        assert got[key][0] >= data.count(key) >= got[key][0] - got[key][1]


def test_merge_writes_cells(spark):
    df = spark.createDataFrame([(1, 0, 1, 1, 5), (1, 0, 1, 1, 7), (1, 0, 1, 2, 3), (2, 0, 1, 1, 5), (2, 0, 1, 0, 9)], "route_id int, at int, group_id int, term int, writes long")
    assert rows(heatmap.merge_writes(df).select("route_id", "writes", "conflict")) == [(1, 10, True), (2, 9, False)]


def test_divergence_and_batches(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "y")], "k int, v string")
    assert rows(compare.divergence(a, b, "k", "v")) == [(2, "data_mismatch"), (3, "migration_gap"), (4, "extra_data")]
    state = spark.createDataFrame([("a", "5")], "key string, value string")
    cmds = spark.createDataFrame([("a", 1, "INCR", None), ("a", 2, "GET", None), ("n", 1, "SET", "q"), ("n", 2, "INCR", None)], "key string, pos long, name string, argument string")
    assert rows(batches.run_batch(state, cmds)) == [("a", 1, "6", "6"), ("a", 2, "6", "6"), ("n", 1, "OK", "q"), ("n", 2, "ERR not an integer", "q")]
    doubled = batches.run_batch(state, cmds.where("key = 'a'"), lambda s, n, x: ((s or "") * 2, n))
    assert {r.value for r in doubled.collect()} == {"5555"}


# ---- codecs, dumps, streams


def test_codecs(spark):
    numbers = ["-1e30", "-12.5", "-12", "-0.001", "0", "1e-5", "0.5", "3", "3.25", "30", "1e40"]
    assert sorted(random.Random(1).sample(numbers, len(numbers)), key=codecs.number_key) == numbers
    scores = [float("-inf"), -2.5, -1e-9, 0.0, 1e-9, 3.0, float("inf")]
    assert sorted(scores[::-1], key=codecs.score_key) == scores and codecs.score_key(-0.0) == codecs.score_key(0.0)
    assert codecs.text_key(b"a") < codecs.text_key(b"a\x00") < codecs.text_key(b"ab") and codecs.score_text(3.0) == "3" and codecs.score_text(1e-7) == "0.0000001"
    codecs.check_value({"M": {"a": {"L": [{"N": "1"}, {"NULL": True}]}}})
    for bad in ({}, {"S": "a", "N": "1"}, {"X": 1}):
        with pytest.raises(codecs.BadValue):
            codecs.check_value(bad)
    deep = {"S": "x"}
    for _ in range(40):
        deep = {"L": [deep]}
    with pytest.raises(codecs.BadValue):
        codecs.check_value(deep)
    df = spark.createDataFrame([('{"a":{"S":"x"},"n":{"N":"1.50"},"z":{"NULL":true},"s":{"SS":["p","q"]}}',)], "item string")
    j = F.col("item")
    r = df.select(codecs.attribute(j, "a", "S"), codecs.attribute(j, "n", "N"), codecs.attribute_present(j, "z"), codecs.attribute_present(j, "no"), codecs.attribute(j, "s", "SS")).first()
    assert (r[0], float(r[1]), r[2], r[3], r[4]) == ("x", 1.5, True, False, ["p", "q"])
    assert spark.range(1).select(codecs.to_typed_json({"a": (F.lit("x"), "S"), "n": (F.lit(None).cast("int"), "N"), "b": (F.lit(True), "BOOL")})).first()[0] == '{"a":{"S":"x"},"b":{"BOOL":true}}'
    assert [r[0] for r in spark.createDataFrame([("1.50",), ("x",), (None,)], "t string").select(codecs.canonical_number("t")).collect()] == ["1.5", None, None]


def test_dump_round_trip(spark, tmp_path):
    tables_in = {"zsets": spark.createDataFrame([("k", "m", 1.5)], dumps.SCHEMAS["zsets"]), "streams": spark.createDataFrame([("k", Decimal(logs.MOST), Decimal(0), ["a", "b"])], dumps.SCHEMAS["streams"])}
    dumps.write_dump(tables_in, str(tmp_path / "d"))
    back = dumps.read_dump(spark, str(tmp_path / "d"))
    assert set(back) == set(tables_in) and all(dumps.same_rows(back[n], tables_in[n]) for n in back)
    assert dumps.damaged(spark, str(tmp_path / "d")).count() == 0
    spark.createDataFrame([("k", "x", 2.0)], dumps.SCHEMAS["zsets"]).write.mode("append").json(str(tmp_path / "d/zsets"))
    assert [r.name for r in dumps.damaged(spark, str(tmp_path / "d")).collect()] == ["zsets"]
    log = spark.createDataFrame([("k", 1, "v", False, 0), ("a", 2, "w", True, 0)], dumps.LOG)
    dumps.write_log(log, str(tmp_path / "log"), 2)
    assert dumps.same_rows(dumps.read_log(spark, str(tmp_path / "log")), log)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = flows.read_files(spark, str(tmp_path / "in"), events.schema)
    one = F.lit(1)
    windows = flows.activity(source, F.col("event_type"), F.col("ts"), one, F.lit(0), "1 hour", "40 days")
    flows.drain(windows, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    flows.drain(flows.deduplicate(source, "ts", ["user_id"], "60 days"), str(tmp_path / "dedup"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == events.select("user_id").distinct().count()
    scores = spark.createDataFrame([("r", i, s) for i, s in enumerate([9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0])], "route_id string, at long, score double")
    scores.coalesce(1).write.parquet(str(tmp_path / "scores"))
    hot = flows.hot_streaks(flows.read_files(spark, str(tmp_path / "scores"), scores.schema), 5.0, 3)
    flows.drain(hot, str(tmp_path / "hot"), str(tmp_path / "c3")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "hot"))) == [("r", 5, 3), ("r", 6, 4)] == rows(heatmap.consecutive_hot(scores, 5.0, 3).select("route_id", "at", F.col("streak").cast("long")))
    got = []
    flows.dual_write(source, lambda b: got.append(b.count()), lambda b: got.append(-b.count()), str(tmp_path / "c4")).awaitTermination(120)
    assert sum(x for x in got if x > 0) == events.count() and sum(got) == 0


def test_buckets_uploads_and_files(spark, tmp_path):
    buckets = objects.create_bucket(spark.createDataFrame([("b", 1, 0, "private")], "bucket string, generation long, created_ms long, acl string"), "c", 5)
    stored = spark.createDataFrame([("b", "k", 1, "e", 0)], "bucket string, key string, size long, etag string, modified long")
    assert rows(objects.delete_bucket(objects.delete_bucket(buckets, stored, "b"), stored, "c").select("bucket")) == [("b",)]
    assert rows(objects.set_acl(buckets, "c", "public").select("bucket", "acl")) == [("b", "private"), ("c", "public")]
    parts = spark.createDataFrame([("u", 1, "0a" * 16, 5, 1), ("u", 1, "0b" * 16, 6, 2), ("u", 2, "0c" * 16, 7, 1)], "upload string, part int, etag string, size long, sent_ms long")
    wanted = spark.createDataFrame([(1, "0b" * 16), (2, "0c" * 16)], "part int, etag string")
    done = {r.key: r for r in objects.complete_upload(stored, parts, wanted, "b", "new", "u", 9).collect()}
    assert done["new"].size == 13 and done["new"].etag.endswith("-2") and set(done) == {"k", "new"}
    assert objects.complete_upload(stored, parts, wanted.withColumn("etag", F.lit("x")), "b", "new", "u", 9).count() == 1
    e = spark.createDataFrame([(0, "a", 1), (1, "c", 3)], "parent long, name string, inode long")
    e = objects.make_entries(e, spark.createDataFrame([(0, "a", 9), (0, "z", 4)], "parent long, name string, inode long"))
    assert rows(objects.unlink(objects.unlink(e, 0, "a"), 0, "z")) == [(0, "a", 1), (1, "c", 3)]
    chunks = spark.createDataFrame([(1, 0, b"abcd"), (1, 1, b"efgh"), (2, 0, b"x")], "inode long, chunk int, data binary")
    chunks = objects.write_chunks(chunks, spark.createDataFrame([(1, 1, b"EFGH")], "inode long, chunk int, data binary"))
    assert bytes(objects.read_file(objects.truncate(chunks, 1, 6, 4), 1).first().data) == b"abcdEF"
    q = queues.create_queue(spark.createDataFrame([], "name string, attributes map<string,string>, tags map<string,string>, created_ms long"), "q", {"a": "1", "b": "2"}, 0)
    q = queues.tag(queues.set_attributes(q, "q", {"b": "3"}), "q", {"t": "x"})
    assert rows(queues.get_attributes(q, "q", ["All"])) == [("a", "1"), ("b", "3")] and q.first().tags == {"t": "x"} and queues.may_purge(None, 0) and not queues.may_purge(1, 60_000)
    log = spark.createDataFrame([("k", 1, "v", False, 0), ("k", 5, "w", False, 0)], dumps.LOG)
    dumps.write_log(log, str(tmp_path / "log"), 1)
    assert dumps.read_as_of(spark, str(tmp_path / "log")).first().value == "w" and dumps.read_as_of(spark, str(tmp_path / "log"), 2).first().value == "v"


def test_route_load_and_key_numbers(spark):
    facts = spark.createDataFrame([(1, 2, 3), (1, 4, 5), (2, 1, 0)], "route_id int, reads long, writes long")
    assert rows(routes.route_load(facts)) == [(1, 6, 8), (2, 1, 0)]
    got = spark.createDataFrame([("pre\x01",), ("pre",), ("preabcdefghij",)], "k string").select(routes.key_number(F.col("k"), 3).alias("n")).collect()
    assert sorted(int(r.n) for r in got) == [0, 1 << 56, int.from_bytes(b"abcdefgh", "big")]
    assert [r[0] for r in spark.range(1).select(routes.sub_bucket(F.lit(-5), F.lit(0), F.lit(10), 4), routes.sub_bucket(F.lit(99), F.lit(0), F.lit(10), 4)).collect()] == [0]
