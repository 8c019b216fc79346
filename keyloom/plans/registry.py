"""Registered queries by name over the star-schema and event tables, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, compare, heatmap, logs, objects, queues, routes, structures, tables, versions
from .expressions import condition, update

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str = "ts"):
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


# ---- document tables -------------------------------------------------------------------------------


def orders(spark, d) -> tables.Table:
    by_status = tables.Index("status", "o_orderstatus", "o_orderdate", "INCLUDE", ("o_totalprice",))
    return tables.Table("orders", table(spark, d, "orders"), "o_custkey", ("o_orderdate", "o_orderkey"), {"status": by_status})


def events_table(spark, d) -> tables.Table:
    return tables.Table("events", table(spark, d, "events"), "user_id", ("ts",))


def stamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


_PICK = "o_orderkey, o_orderdate, o_totalprice"


@query("query_hash_only", f"SELECT {_PICK} FROM orders WHERE o_custkey = 19")
def _(s, d):
    return tables.query(orders(s, d), "o_custkey = :c", values={":c": 19}, project=_PICK).items


@query("query_limit_then_filter", f"SELECT {_PICK} FROM (SELECT * FROM orders WHERE o_custkey = 19 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31' ORDER BY o_orderdate, o_orderkey LIMIT 10) WHERE o_totalprice > 100000")
def _(s, d):
    return tables.query(orders(s, d), "o_custkey = :c AND o_orderdate BETWEEN :a AND :b", filter="o_totalprice > :p", values={":c": 19, ":a": stamp("1995-01-01"), ":b": stamp("2001-12-31"), ":p": 100000}, limit=10, project=_PICK).items


@query("query_range_between", f"SELECT {_PICK} FROM orders WHERE o_custkey = 19 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def _(s, d):
    return tables.query(orders(s, d), "o_custkey = :c AND o_orderdate BETWEEN :a AND :b", values={":c": 19, ":a": stamp("1996-01-01"), ":b": stamp("1999-12-31")}, project=_PICK).items


for _name, _op in {"ge": ">=", "gt": ">", "le": "<=", "lt": "<"}.items():

    @query(f"query_range_{_name}", f"SELECT event_id, ts, event_type FROM events WHERE user_id = 3 AND ts {_op} TIMESTAMP '2024-01-10'")
    def _(s, d, op=_op):
        return tables.query(events_table(s, d), f"user_id = :u AND ts {op} :t", values={":u": 3, ":t": stamp("2024-01-10")}, project="event_id, ts, event_type").items


@query("query_begins_with", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with(c_name, 'Customer#00000')")
def _(s, d):
    t = tables.Table("customer", table(s, d, "customer"), "c_mktsegment", ("c_name",))
    return tables.query(t, "c_mktsegment = :m AND begins_with(c_name, :p)", values={":m": "BUILDING", ":p": "Customer#00000"}, project="c_custkey, c_name").items


@query("query_reverse_limit", f"SELECT {_PICK} FROM orders WHERE o_custkey = 19 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def _(s, d):
    return tables.query(orders(s, d), "o_custkey = :c", values={":c": 19}, forward=False, limit=5, project=_PICK).items


@query("query_count_only", "SELECT count(*) FILTER (o_totalprice > 100000) AS count, count(*) AS scanned_count FROM (SELECT * FROM orders WHERE o_custkey = 19 ORDER BY o_orderdate, o_orderkey LIMIT 10)")
def _(s, d):
    return tables.query(orders(s, d), "o_custkey = :c", filter="o_totalprice > :p", values={":c": 19, ":p": 100000}, limit=10, select="COUNT").counts()


@query("query_page2", f"SELECT {_PICK} FROM orders WHERE o_custkey = 19 ORDER BY o_orderdate, o_orderkey LIMIT 3 OFFSET 3")
def _(s, d):
    first = tables.query(orders(s, d), "o_custkey = :c", values={":c": 19}, limit=3)
    return tables.query(orders(s, d), "o_custkey = :c", values={":c": 19}, limit=3, start=first.next_key(), project=_PICK).items


@query("query_start_after_absent_key", f"SELECT {_PICK} FROM orders WHERE o_custkey = 19 AND (o_orderdate, o_orderkey) > (TIMESTAMP '1997-06-01', 0) ORDER BY o_orderdate, o_orderkey LIMIT 4")
def _(s, d):
    return tables.query(orders(s, d), "o_custkey = :c", values={":c": 19}, limit=4, start={"o_orderdate": stamp("1997-06-01"), "o_orderkey": 0}, project=_PICK).items


@query("index_query_projected", "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01'")
def _(s, d):
    return tables.query(orders(s, d), "o_orderstatus = :s AND o_orderdate >= :a", index="status", values={":s": "F", ":a": stamp("2000-01-01")}, project="o_custkey, o_orderdate, o_orderkey, o_totalprice").items


@query("index_sparse", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def _(s, d):
    rows = table(s, d, "part").withColumn("big", F.when(F.col("p_size") > 25, F.col("p_size")))
    t = tables.Table("part", rows, "p_partkey", (), {"big": tables.Index("big", "big", None, "INCLUDE", ("p_size",))})
    return t.index_rows("big").select("p_partkey", "p_size")


@query("index_lookup_join", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'")
def _(s, d):
    t = orders(s, d)
    keys = tables.query(t, "o_orderstatus = :s AND o_orderdate < :b", index="status", values={":s": "P", ":b": stamp("1996-01-01")}).items
    return tables.index_lookup(keys, t).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("scan_filter_logic", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '1-URGENT'")
def _(s, d):
    return tables.scan(orders(s, d), filter="(o_orderstatus = :f OR #p > :x) AND NOT o_orderpriority = :u", names={"#p": "o_totalprice"}, values={":f": "F", ":x": 300000, ":u": "1-URGENT"}, project="o_orderkey, o_orderstatus").items


@query("scan_page", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 20")
def _(s, d):
    return tables.scan(orders(s, d), limit=20, project="o_custkey, o_orderkey").items


@query("get_item", "SELECT event_id, event_type FROM events WHERE user_id = 3 AND ts = (SELECT min(ts) FROM events WHERE user_id = 3)")
def _(s, d):
    t = events_table(s, d)
    first = tables.query(t, "user_id = :u", values={":u": 3}, limit=1).items.select("ts").first()
    return tables.get_item(t, {"user_id": 3, "ts": first["ts"]}, "event_id, event_type")


@query("transact_get", "SELECT r.i AS pos, c_custkey, c_name FROM (SELECT range AS i, range * 700 AS k FROM range(5)) r LEFT JOIN customer ON c_custkey = k")
def _(s, d):
    t = tables.Table("customer", table(s, d, "customer"), "c_custkey")
    wanted = s.range(5).select(F.col("id").alias("pos"), (F.col("id") * 700).alias("c_custkey"))
    found = tables.transact_get(t, wanted)
    return found.select("pos", F.when(F.col("c_name").isNotNull(), F.col("c_custkey")).alias("c_custkey"), "c_name")


@query("migration_merge", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return tables.migration_merge(c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), c, ["c_custkey"])


@query("put_items_if_absent", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'copy' FROM customer WHERE c_custkey % 10 = 0")
def _(s, d):
    t = tables.Table("customer", table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    new = t.rows.where("c_custkey % 10 = 0").select(F.explode(F.array("c_custkey", F.col("c_custkey") + 1000000)).alias("c_custkey"), F.lit("copy").alias("c_name"))
    return tables.put_items(t, new, "attribute_not_exists(c_name)")[0]


@query("delete_items_if", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_acctbal < 0)")
def _(s, d):
    t = tables.Table("customer", table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return tables.delete_items(t, t.rows.where("c_custkey % 2 = 0").select("c_custkey"), "c_acctbal < :z", values={":z": 0})[0]


@query("update_items_returning", "SELECT p_partkey, TRUE AS ok, p_size + 5 AS p_size FROM part WHERE p_partkey % 4 = 0")
def _(s, d):
    t = tables.Table("part", table(s, d, "part"), "p_partkey")
    done = tables.update_items(t, t.rows.where("p_partkey % 4 = 0").select("p_partkey"), "SET p_size = p_size + :n", values={":n": 5}, returns="UPDATED_NEW")[1]
    return done.select("p_partkey", "ok", F.col("after.p_size").alias("p_size"))


@query("update_items_state", "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS p_brand FROM part")
def _(s, d):
    t = tables.Table("part", table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return tables.update_items(t, t.rows.select("p_partkey"), "REMOVE p_brand", "p_size > :n", values={":n": 40})[0].select("p_partkey", "p_brand")


@query("batch_write", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3) UNION ALL SELECT 1, 'x' UNION ALL SELECT 99, 'y'")
def _(s, d):
    t = tables.Table("nation", table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return tables.batch_write(t, s.createDataFrame([(1, "x"), (99, "y")], "n_nationkey int, n_name string"), s.createDataFrame([(2,), (3,)], "n_nationkey int"))


@query("transact_write", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 4")
def _(s, d):
    t = tables.Table("nation", table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return tables.transact_write(t, deletes=s.createDataFrame([(4,)], "n_nationkey int"), checks=[({"n_nationkey": 4}, "attribute_exists(n_name)"), ({"n_nationkey": 400}, "attribute_not_exists(n_name)")])


@query("transact_write_update", "SELECT n_nationkey, CASE WHEN n_nationkey IN (5, 6) THEN 'renamed' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 7 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 99, 'new', 1")
def _(s, d):
    t = tables.Table("nation", table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey")), "n_nationkey")
    one = lambda *k: s.createDataFrame([(i,) for i in k], "n_nationkey int")
    updates = [(one(5, 6), "SET n_name = :r", "attribute_exists(n_name)"), (one(7), "SET n_regionkey = n_regionkey + :ten", None)]
    return tables.transact_write(t, s.createDataFrame([(99, "new", 1)], "n_nationkey int, n_name string, n_regionkey int"), one(4), [({"n_nationkey": 400}, "attribute_not_exists(n_name)")], values={":r": "renamed", ":ten": 10}, updates=updates)


_CONTENDED = "n_nationkey % 2 = 1"


@query("batch_write_unprocessed", f"SELECT CASE WHEN n_regionkey = 0 THEN 'put' ELSE 'delete' END AS op, n_nationkey FROM nation WHERE n_regionkey < 2 AND {_CONTENDED}")
def _(s, d):
    t = tables.Table("nation", table(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return tables.batch_write_partial(t, t.rows.where("n_regionkey = 0"), t.rows.where("n_regionkey = 1").select("n_nationkey"), t.rows.where(_CONTENDED))[1]


@query("batch_write_processed", f"SELECT n_nationkey, CASE WHEN n_regionkey = 0 AND NOT ({_CONTENDED}) THEN 50 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 1 OR {_CONTENDED}")
def _(s, d):
    t = tables.Table("nation", table(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    puts = t.rows.where("n_regionkey = 0").withColumn("n_regionkey", F.lit(50).cast(dict(t.rows.dtypes)["n_regionkey"]))
    return tables.batch_write_partial(t, puts, t.rows.where("n_regionkey = 1").select("n_nationkey"), t.rows.where(_CONTENDED))[0]


@query("update_makes_containers", "SELECT c_custkey, c_custkey % 2 AS child, CASE WHEN c_custkey % 3 = 0 THEN 'kept' END AS other, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS items, c_name AS last FROM customer")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.struct(F.lit(None).cast("long").alias("child"), F.lit("kept").alias("other"))).alias("extra"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("first"))).alias("items"))
    t = tables.Table("customer", c.withColumn("half", F.col("c_custkey") % 2), "c_custkey")
    done = tables.update_items(t, c.select("c_custkey"), "SET extra.child = half, items[7] = c_name")[0]
    return done.select("c_custkey", "extra.child", "extra.other", F.size("items").alias("items"), F.element_at("items", -1).alias("last"))


@query("index_delta", "SELECT 'delete' AS op, p_partkey, p_size FROM part WHERE p_size = 7 UNION ALL SELECT 'insert', p_partkey, 8 FROM part WHERE p_size = 7")
def _(s, d):
    old = table(s, d, "part").select("p_partkey", "p_size")
    gone, added = tables.index_changes(old, old.withColumn("p_size", F.when(F.col("p_size") == 7, F.lit(8)).otherwise(F.col("p_size"))))
    return gone.select(F.lit("delete").alias("op"), "*").unionByName(added.select(F.lit("insert").alias("op"), "*"))


def _where(name: str, table_name: str, columns: str, text: str, values: dict, sql_where: str, names: dict | None = None) -> None:
    @query(name, f"SELECT {columns} FROM {table_name} WHERE {sql_where}")
    def _(s, d):
        return table(s, d, table_name).where(condition(text, names, values)).select(*columns.split(", "))


_where("cond_compare", "part", "p_partkey", "p_size <> :a AND p_retailprice >= :b", {":a": 10, ":b": 950}, "p_size <> 10 AND p_retailprice >= 950")
_where("cond_in", "part", "p_partkey, p_size", "p_size IN (:a, :b, :c)", {":a": 1, ":b": 7, ":c": 49}, "p_size IN (1, 7, 49)")
_where("cond_between", "part", "p_partkey", "p_retailprice BETWEEN :a AND :b", {":a": 920, ":b": 930}, "p_retailprice BETWEEN 920 AND 930")
_where("cond_contains", "part", "p_partkey, p_type", "contains(p_type, :x)", {":x": "CON"}, "contains(p_type, 'CON')")
_where("cond_begins", "part", "p_partkey, p_brand", "begins_with(#b, :x)", {":x": "Brand#1"}, "starts_with(p_brand, 'Brand#1')", {"#b": "p_brand"})
_where("cond_size_bytes", "documents", "doc_id", "size(text) > :n", {":n": 2000}, "strlen(text) > 2000")
_where("cond_exists", "labels", "doc_id", "attribute_exists(quality) AND NOT attribute_not_exists(toxic)", {}, "quality IS NOT NULL AND toxic IS NOT NULL")
_where("cond_type", "part", "p_partkey", "attribute_type(p_name, :s) AND attribute_type(p_size, :n)", {":s": "S", ":n": "N"}, "p_name IS NOT NULL AND p_size IS NOT NULL")
_where("cond_precedence", "nation", "n_nationkey", "n_regionkey = :a OR n_regionkey = :b AND NOT n_nationkey < :c", {":a": 0, ":b": 1, ":c": 10}, "n_regionkey = 0 OR n_regionkey = 1 AND NOT n_nationkey < 10")


@query("cond_missing_lenient", "SELECT p_partkey FROM part WHERE p_size > 25 OR p_size = 3")
def _(s, d):
    rows = table(s, d, "part").withColumn("small", F.when(F.col("p_size") <= 25, F.col("p_size")))
    return rows.where(condition("small = :x", values={":x": 3}, missing="lenient")).select("p_partkey")


@query("doc_path_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def _(s, d):
    rows = table(s, d, "events").withColumn("props", F.from_json("props", "k int"))
    return rows.where(condition("props.k >= :n", values={":n": 50})).select("event_id", F.col("props.k").alias("k"))


def _changed(name: str, table_name: str, prepare, text: str, values: dict, columns: list[str], sql: str) -> None:
    @query(name, sql)
    def _(s, d):
        rows = prepare(table(s, d, table_name))
        new = update(text, values=values, types=dict(rows.dtypes))
        return rows.withColumns({c: v for c, v in new.items() if v is not None}).drop(*[c for c, v in new.items() if v is None]).select(*columns)


_sets = "SELECT user_id AS key, list_sort(list_distinct(list(event_type))) AS m FROM events GROUP BY user_id"


def _user_sets(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set("event_type")).alias("m"))


_changed("update_if_not_exists", "part", lambda p: p.withColumn("x", F.when(F.col("p_size") > 25, F.col("p_size"))), "SET x = if_not_exists(x, :z)", {":z": 0}, ["p_partkey", "x"], "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS x FROM part")
_changed("update_arithmetic", "part", lambda p: p, "SET p_size = p_size - :a - :b", {":a": 10, ":b": 3}, ["p_partkey", "p_size"], "SELECT p_partkey, p_size - (10 - 3) AS p_size FROM part")
_changed("update_remove", "nation", lambda n: n, "REMOVE n_regionkey SET n_name = :x", {":x": "n"}, ["n_nationkey", "n_name"], "SELECT n_nationkey, 'n' AS n_name FROM nation")
_changed("update_add_number", "part", lambda p: p.withColumn("x", F.when(F.col("p_size") > 25, F.col("p_size"))), "ADD x :n", {":n": 4}, ["p_partkey", "x"], "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 0 END + 4 AS x FROM part")


@query("update_list_append", f"SELECT key, array_to_string(list_concat(m, ['z']), ',') AS m FROM ({_sets})")
def _(s, d):
    rows = _user_sets(table(s, d, "events"))
    return rows.withColumns(update("SET m = list_append(m, :v)", values={":v": ["z"]})).select("key", F.array_join("m", ",").alias("m"))


@query("update_set_union", f"SELECT key, array_to_string(list_sort(list_distinct(list_concat(m, ['view', 'z']))), ',') AS m FROM ({_sets})")
def _(s, d):
    rows = _user_sets(table(s, d, "events"))
    return rows.withColumns(update("ADD m :v", values={":v": {"view", "z"}}, types=dict(rows.dtypes))).select("key", F.array_join(F.array_sort("m"), ",").alias("m"))


@query("update_set_difference", f"SELECT key, CASE WHEN len(r) > 0 THEN array_to_string(r, ',') END AS m FROM (SELECT key, list_filter(m, lambda x: x NOT IN ('view', 'click')) AS r FROM ({_sets}))")
def _(s, d):
    rows = _user_sets(table(s, d, "events"))
    return rows.withColumns(update("DELETE m :v", values={":v": {"view", "click"}}, types=dict(rows.dtypes))).select("key", F.array_join("m", ",").alias("m"))


# ---- versions --------------------------------------------------------------------------------------

_LOG = "SELECT CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 1000) AS commit_ts, event_type AS value, event_type = 'error' AS tombstone, CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) + 86400000 ELSE 0 END AS expire_at FROM events"
_AT = 1705276800000  # 2024-01-15
_NEWEST = f"SELECT * FROM ({_LOG}) WHERE commit_ts <= {_AT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1"
_SEEN = f"SELECT key, commit_ts, value FROM ({_NEWEST}) WHERE NOT tombstone AND (expire_at = 0 OR expire_at > {_AT})"


def log(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"), millis().alias("commit_ts"), kind.alias("value"), (kind == "error").alias("tombstone"),
        F.when(kind == "view", millis() + 86400000).otherwise(F.lit(0).cast("long")).alias("expire_at"),
    )


@query("version_snapshot", _SEEN)
def _(s, d):
    return versions.snapshot(log(s, d), _AT).select("key", "commit_ts", "value")


@query("version_get", f"SELECT * FROM ({_SEEN}) WHERE key = '7'")
def _(s, d):
    return versions.get_at(log(s, d), "7", _AT).select("key", "commit_ts", "value")


@query("version_exists", f"SELECT CAST(range AS VARCHAR) AS key, CAST(range AS VARCHAR) IN (SELECT key FROM ({_SEEN})) AS found FROM range(40)")
def _(s, d):
    return versions.exists_at(log(s, d), s.range(40).select(F.col("id").cast("string").alias("key")), _AT)


@query("version_scan", f"SELECT * FROM ({_SEEN}) WHERE key >= '1' AND key < '5' ORDER BY key LIMIT 8")
def _(s, d):
    return versions.scan_at(log(s, d), "1", "5", _AT, limit=8).select("key", "commit_ts", "value")


@query("version_scan_reverse", f"SELECT * FROM ({_SEEN}) WHERE key >= '1' AND key < '5' ORDER BY key DESC LIMIT 8")
def _(s, d):
    return versions.scan_at(log(s, d), "1", "5", _AT, limit=8, reverse=True).select("key", "commit_ts", "value")


@query("version_scan_keys", f"SELECT key FROM ({_SEEN})")
def _(s, d):
    return versions.scan_at(log(s, d), None, None, _AT, keys_only=True)


@query("version_scan_physical", f"SELECT key, value, TRUE AS truncated FROM (SELECT * FROM ({_NEWEST}) ORDER BY key LIMIT 10) WHERE NOT tombstone AND (expire_at = 0 OR expire_at > {_AT}) ORDER BY key LIMIT 3")
def _(s, d):
    return versions.scan_physical(log(s, d), None, None, _AT, 3, 10).select("key", "value", "truncated")


@query("version_latest", f"SELECT key, max(commit_ts) AS commit_ts FROM ({_LOG}) GROUP BY key")
def _(s, d):
    return versions.latest_commit(log(s, d))


@query("version_exact_probe", f"SELECT key, commit_ts FROM ({_LOG}) WHERE commit_ts % 7 = 0")
def _(s, d):
    rows = log(s, d).where("commit_ts % 7 = 0").select("key", "commit_ts")
    return versions.committed_at(log(s, d), rows.unionByName(rows.withColumn("key", F.lit("none"))))


@query("version_compact", f"SELECT key, commit_ts, value FROM ({_NEWEST}) UNION ALL SELECT key, commit_ts, value FROM ({_LOG}) WHERE commit_ts > {_AT}")
def _(s, d):
    return versions.compact(log(s, d), _AT).select("key", "commit_ts", "value")


@query("version_conflicts", f"SELECT DISTINCT kind, key FROM (SELECT CASE WHEN range % 2 = 0 THEN 'write' ELSE 'read' END AS kind, CAST(range AS VARCHAR) AS key FROM range(30)) WHERE key IN (SELECT key FROM ({_LOG}) WHERE commit_ts > 1706400000000)")
def _(s, d):
    keys = s.range(30).select("id", F.col("id").cast("string").alias("key"))
    return versions.conflicts(log(s, d), keys.where("id % 2 = 0"), keys.where("id % 2 = 1"), 1706400000000)


@query("version_conflict_counts", f"SELECT kind, CASE WHEN starts_with(key, '1') THEN 'ones' ELSE 'other' END AS family, count(*) AS n FROM (SELECT DISTINCT 'write' AS kind, key FROM ({_LOG}) WHERE commit_ts > 1706000000000) GROUP BY ALL")
def _(s, d):
    keys = log(s, d).select("key").distinct()
    return versions.conflict_counts(versions.conflicts(log(s, d), keys, keys.where("false"), 1706000000000), versions.key_family(F.col("key"), {"1": "ones"}))


@query("version_append", f"SELECT key, max(commit_ts) AS commit_ts, arg_max(value, commit_ts) AS value, count(*) AS n FROM (SELECT key, commit_ts, value FROM ({_LOG}) WHERE NOT (key = '1' AND commit_ts = (SELECT max(commit_ts) FROM ({_LOG}) WHERE key = '1')) UNION ALL SELECT '1', (SELECT max(commit_ts) FROM ({_LOG}) WHERE key = '1'), 'new') GROUP BY key")
def _(s, d):
    one = versions.latest_commit(log(s, d)).where("key = '1'")
    both = versions.append(log(s, d), one.select("key", "commit_ts", F.lit("new").alias("value"), F.lit(False).alias("tombstone"), F.lit(0).cast("long").alias("expire_at")))
    return both.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"), F.max_by("value", "commit_ts").alias("value"), F.count("*").alias("n"))


@query("version_delete_prefix", f"SELECT key FROM ({_SEEN}) WHERE NOT (starts_with(key, '1') AND NOT starts_with(key, '12'))")
def _(s, d):
    rows = log(s, d)
    return versions.snapshot(rows.unionByName(versions.delete_prefix(rows, "1", _AT, "12").withColumn("commit_ts", F.lit(_AT).cast("long"))), _AT).select("key")


@query("version_merge_shards", f"SELECT key, max(commit_ts) AS commit_ts FROM ({_LOG}) GROUP BY key ORDER BY key LIMIT 12")
def _(s, d):
    rows = versions.latest_commit(log(s, d))
    return versions.merge_shards([rows.where("key >= '2'"), rows.where("key < '4'"), rows], 12)


@query("version_apply_batch", f"SELECT count(*) AS n FROM ({_LOG})")
def _(s, d):
    rows = log(s, d)
    put = versions.put(s.createDataFrame([("1", "x"), ("zz", "y")], "key string, value string"), 9999999999999)
    return versions.apply_batch(rows, put, rows.select("key").where("false"), 1700000000000).agg(F.count("*").alias("n"))


@query("hybrid_timestamp", "SELECT event_id, (((epoch_us(ts) // 1000) << 16) | (event_id & 65535)) AS hlc, ((((epoch_us(ts) // 1000) << 16) | (event_id & 65535)) >> 16) AS ms FROM events")
def _(s, d):
    rows = table(s, d, "events").select("event_id", versions.hlc(millis(), F.col("event_id")).alias("hlc"))
    return rows.withColumn("ms", F.shiftright("hlc", 16))


# ---- structures ------------------------------------------------------------------------------------

_Z = "SELECT o_custkey AS key, o_orderkey AS member, o_totalprice AS score FROM orders"
_L = "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rank, count(*) OVER (PARTITION BY user_id) AS size, event_id AS seq, event_type AS value FROM events"


def zset(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("member"), F.col("o_totalprice").alias("score"))


def event_list(spark, d) -> DataFrame:
    """seq is the time, which is unique in events."""
    return table(spark, d, "events").select(F.col("user_id").alias("key"), millis().alias("seq"), F.col("event_type").alias("value"), "event_id")


@query("zset_range", f"SELECT key, member, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM ({_Z})) WHERE rank BETWEEN 1 AND 3")
def _(s, d):
    return structures.zset_range(zset(s, d), 1, 3).select("key", "member", F.col("rank").cast("long").alias("rank"))


@query("zset_range_reverse", f"SELECT key, member, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM ({_Z})) WHERE rank BETWEEN greatest(n - 2, 0) AND n - 1")
def _(s, d):
    return structures.zset_range(zset(s, d), -2, -1, reverse=True).select("key", "member", F.col("rank").cast("long").alias("rank"))


@query("zset_range_by_score", f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS n FROM ({_Z}) WHERE score > 50000 AND score <= 250000) WHERE n BETWEEN 2 AND 4")
def _(s, d):
    return structures.zset_range_by_score(zset(s, d), "(50000", "250000", 1, 3).select("key", "member")


@query("zset_range_by_score_reverse", f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS n FROM ({_Z}) WHERE score >= 100000) WHERE n <= 2")
def _(s, d):
    return structures.zset_range_by_score(zset(s, d), "100000", "+inf", 0, 2, reverse=True).select("key", "member")


@query("zset_count", f"SELECT key, count(*) FILTER (score BETWEEN 100000 AND 200000) AS n FROM ({_Z}) GROUP BY key")
def _(s, d):
    return structures.zset_count(zset(s, d), "100000", "200000")


@query("zset_pop_min", f"SELECT key, member FROM ({_Z}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 2")
def _(s, d):
    return structures.zset_pop(zset(s, d), 2)[1].select("key", "member")


@query("zset_size", f"SELECT key, count(*) AS size FROM ({_Z}) GROUP BY key")
def _(s, d):
    return structures.zset_size(zset(s, d))


@query("zset_remove_ranks", f"SELECT key, member FROM ({_Z}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) > 3")
def _(s, d):
    return structures.zset_remove_ranks(zset(s, d), 0, 2).select("key", "member")


@query("zset_remove_scores", f"SELECT key, member FROM ({_Z}) WHERE NOT (score < 200000)")
def _(s, d):
    return structures.zset_remove_scores(zset(s, d), "-inf", "(200000").select("key", "member")


_ZN = "SELECT o_custkey AS key, o_orderkey AS member, CASE WHEN o_orderkey % 2 = 0 THEN 150000.0 ELSE o_totalprice END AS new FROM orders WHERE o_orderkey % 3 = 0"


@query("zset_add_greater", f"SELECT z.key, z.member, CASE WHEN new > score THEN new ELSE score END AS score FROM ({_Z}) z LEFT JOIN ({_ZN}) n USING (key, member)")
def _(s, d):
    new = zset(s, d).where("member % 3 = 0").select("key", "member", F.lit(1).alias("pos"), F.when(F.col("member") % 2 == 0, F.lit(150000.0)).otherwise(F.col("score")).alias("score"))
    return structures.zset_add(zset(s, d), new, greater=True)[0]


@query("zset_increment", f"SELECT key, member, score + CASE WHEN member % 3 = 0 THEN 10 ELSE 0 END AS score FROM ({_Z})")
def _(s, d):
    return structures.zset_increment(zset(s, d), zset(s, d).where("member % 3 = 0").select("key", "member", F.lit(10.0).alias("n")))


@query("zset_remove", f"SELECT key, member FROM ({_Z}) WHERE member % 5 <> 0")
def _(s, d):
    return structures.zset_remove(zset(s, d), zset(s, d).where("member % 5 = 0").select("key", "member")).select("key", "member")


for _name, _a, _b, _where_sql in (("head", 0, 4, "rank BETWEEN 0 AND 4"), ("tail", -3, -1, "rank BETWEEN greatest(size - 3, 0) AND size - 1"), ("middle", 2, -3, "rank BETWEEN 2 AND size - 3")):

    @query(f"list_range_{_name}", f"SELECT key, seq AS event_id, value FROM ({_L}) WHERE {_where_sql}")
    def _(s, d, a=_a, b=_b):
        return structures.list_range(event_list(s, d), a, b).select("key", "event_id", "value")


@query("list_index", f"SELECT key, seq AS event_id FROM ({_L}) WHERE rank = size - 2")
def _(s, d):
    return structures.list_index(event_list(s, d), -2).select("key", "event_id")


@query("list_length", "SELECT user_id AS key, count(*) AS length FROM events GROUP BY user_id")
def _(s, d):
    return structures.list_length(event_list(s, d))


@query("list_pop_right", f"SELECT key, seq AS event_id FROM ({_L}) WHERE rank >= size - 2")
def _(s, d):
    return structures.pop(event_list(s, d), 2, left=False)[1].select("key", "event_id")


@query("list_pop_left_rest", f"SELECT key, seq AS event_id FROM ({_L}) WHERE rank >= 3")
def _(s, d):
    return structures.pop(event_list(s, d), 3)[0].select("key", "event_id")


@query("list_push_left", f"SELECT key, value, rank FROM (SELECT key, value, rank + 2 AS rank FROM ({_L}) UNION ALL SELECT DISTINCT user_id, 'b', 0 FROM events UNION ALL SELECT DISTINCT user_id, 'a', 1 FROM events) WHERE rank < 4")
def _(s, d):
    rows = event_list(s, d).drop("event_id")
    new = rows.select("key").distinct().select("key", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("a").alias("value")), F.struct(F.lit(2).alias("pos"), F.lit("b").alias("value")))).alias("v")).select("key", "v.*")
    return structures.list_range(structures.push(rows, new, left=True), 0, 3).select("key", "value", F.col("rank").cast("long").alias("rank"))


@query("list_trim", f"SELECT key, seq AS event_id FROM ({_L}) WHERE rank BETWEEN 1 AND size - 2")
def _(s, d):
    return structures.trim(event_list(s, d), 1, -2).select("key", "event_id")


@query("list_remove", "SELECT user_id AS key, event_id FROM events QUALIFY NOT (event_type = 'view' AND row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts) <= 2)")
def _(s, d):
    return structures.remove_values(event_list(s, d), "view", 2).select("key", "event_id")


@query("list_remove_from_tail", "SELECT user_id AS key, event_id FROM events QUALIFY NOT (event_type = 'click' AND row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC) <= 1)")
def _(s, d):
    return structures.remove_values(event_list(s, d), "click", -1).select("key", "event_id")


@query("list_set", f"SELECT key, seq AS event_id, CASE WHEN rank = 1 THEN 'new' ELSE value END AS value FROM ({_L})")
def _(s, d):
    return structures.set_at(event_list(s, d), 1, "new").select("key", "event_id", "value")


@query("list_position", f"SELECT key, min(rank) AS position FROM ({_L}) WHERE value = 'purchase' GROUP BY key")
def _(s, d):
    return structures.position_of(event_list(s, d), "purchase").select("key", F.col("position").cast("long").alias("position"))


@query("list_rotate", f"SELECT count(*) AS n, max(value) FILTER (key = 2 AND rank = 0) AS first FROM (SELECT CASE WHEN key = 1 AND rank = size - 1 THEN 2 ELSE key END AS key, value, CASE WHEN key = 1 AND rank = size - 1 THEN 0 WHEN key = 2 THEN rank + 1 ELSE rank END AS rank FROM ({_L}))")
def _(s, d):
    rows = structures.rotate(event_list(s, d).drop("event_id").withColumn("key", F.col("key").cast("string")), "1", "2")
    first = structures.list_range(rows.where("key = '2'"), 0, 0).select("value")
    return rows.agg(F.count("*").alias("n")).join(F.broadcast(first.withColumnRenamed("value", "first")))


_H = "SELECT user_id AS key, event_type AS field, arg_max(event_id, ts) AS value FROM events GROUP BY ALL"


def hashes(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.max_by(F.col("event_id").cast("string"), "ts").alias("value"))


@query("hash_get_all", "SELECT key, '{' || string_agg('\"' || field || '\":\"' || value || '\"', ',' ORDER BY field) || '}' AS fields FROM (" + _H + ") GROUP BY key")
def _(s, d):
    return structures.hash_all(hashes(s, d))


@query("hash_get_many", f"SELECT k.key, k.field, CAST(h.value AS VARCHAR) AS value FROM (SELECT DISTINCT user_id AS key, unnest(['view', 'none']) AS field FROM events) k LEFT JOIN ({_H}) h ON h.key = k.key AND h.field = k.field")
def _(s, d):
    asked = table(s, d, "events").select(F.col("user_id").alias("key")).distinct().select("key", F.explode(F.array(F.lit("view"), F.lit("none"))).alias("field"))
    return structures.hash_get(hashes(s, d), asked)


@query("hash_length", f"SELECT key, count(*) AS length FROM ({_H}) GROUP BY key")
def _(s, d):
    return structures.hash_length(hashes(s, d))


@query("hash_set_added", f"SELECT key, CAST(1 AS BIGINT) AS added FROM ({_H}) GROUP BY key")
def _(s, d):
    new = hashes(s, d).select("key").distinct().select("key", F.explode(F.array(F.lit("view"), F.lit("brand_new"))).alias("field"), F.lit("v").alias("value"))
    both = hashes(s, d).unionByName(new.where("field = 'view'").join(hashes(s, d), ["key", "field"], "left_anti"))
    return structures.hash_set(both, new)[1]


@query("hash_delete", f"SELECT key, field FROM ({_H}) WHERE field <> 'error'")
def _(s, d):
    h = hashes(s, d)
    return structures.hash_delete(h, h.where("field = 'error'").select("key", "field"))[0].select("key", "field")


@query("hash_increment", f"SELECT key, field, CAST(value + CASE WHEN field = 'view' THEN 7 ELSE 0 END AS VARCHAR) AS value FROM ({_H})")
def _(s, d):
    h = hashes(s, d)
    return structures.hash_increment(h, h.where("field = 'view'").select("key", "field", F.explode(F.array(F.lit(3), F.lit(4))).alias("n")))


def members(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member")).distinct()


@query("set_size", "SELECT event_type AS key, count(DISTINCT user_id) AS size FROM events GROUP BY ALL")
def _(s, d):
    return structures.set_size(members(s, d))


@query("set_members", "SELECT event_type AS key, string_agg(u, ',' ORDER BY u) AS members FROM (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS u FROM events) GROUP BY ALL")
def _(s, d):
    return structures.set_members(members(s, d))


@query("set_has", "SELECT 'view' AS key, range AS member, range IN (SELECT user_id FROM events WHERE event_type = 'view') AS found FROM range(50)")
def _(s, d):
    return structures.set_has(members(s, d), s.range(50).select(F.lit("view").alias("key"), F.col("id").alias("member")))


@query("set_add", "SELECT 'view' AS key, count(*) AS added FROM range(2000) WHERE range NOT IN (SELECT user_id FROM events WHERE event_type = 'view')")
def _(s, d):
    return structures.set_add(members(s, d), s.range(2000).select(F.lit("view").alias("key"), F.col("id").alias("member")))[1]


@query("set_remove", "SELECT event_type AS key, count(DISTINCT user_id) AS size FROM events WHERE user_id % 2 = 1 GROUP BY ALL")
def _(s, d):
    m = members(s, d)
    return structures.set_size(structures.set_remove(m, m.where("member % 2 = 0"))[0])


@query("distinct_union", "SELECT count(DISTINCT user_id) AS size FROM events WHERE event_type IN ('view', 'click')")
def _(s, d):
    return structures.union_size(members(s, d), ["view", "click"])


@query("keys_glob", "SELECT c_name AS key FROM customer WHERE c_name LIKE 'Customer#%1%5'")
def _(s, d):
    return structures.keys_like(table(s, d, "customer").withColumnRenamed("c_name", "key"), "Customer#*1*5")


@query("scan_cursor", "SELECT key, 20 AS next FROM (SELECT c_name AS key FROM customer ORDER BY c_name LIMIT 10 OFFSET 10) WHERE key LIKE '%1%'")
def _(s, d):
    return structures.scan_page(table(s, d, "customer").withColumnRenamed("c_name", "key"), 10, 10, "*1*")


@query("db_size", "SELECT count(DISTINCT user_id) AS size FROM events")
def _(s, d):
    return structures.db_size(table(s, d, "events").withColumnRenamed("user_id", "key"))


@query("exists_count", "SELECT CAST(2 * count(*) AS BIGINT) AS found FROM customer WHERE c_custkey BETWEEN 1 AND 10")
def _(s, d):
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("key"))
    asked = s.range(1, 11).select(F.explode(F.array("id", "id", -F.col("id"))).alias("key"))
    return structures.exists_count(keys, asked)


@query("key_types", "SELECT range AS key, CASE WHEN range % 2 = 0 AND range IN (SELECT user_id FROM events) THEN 'list' WHEN range IN (SELECT o_custkey FROM orders) THEN 'zset' ELSE 'none' END AS type FROM range(60)")
def _(s, d):
    space = structures.key_space(list=event_list(s, d).where("key % 2 = 0"), zset=zset(s, d))
    return structures.type_of(space, s.range(60).select(F.col("id").alias("key")))


_S = "SELECT c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS value, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey * 100 END AS expire_at_ms FROM customer"


def strings(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), F.col("c_nationkey").cast("string").alias("value"), F.when(k % 4 == 0, 0).otherwise(k * 100).cast("long").alias("expire_at_ms"))


@query("string_get", f"SELECT range AS key, value FROM range(1, 400) LEFT JOIN (SELECT * FROM ({_S}) WHERE expire_at_ms = 0 OR expire_at_ms > 10050) s ON s.key = range")
def _(s, d):
    return structures.get_strings(strings(s, d), s.range(1, 400).select(F.col("id").alias("key")), 10050)


@query("string_set_if_new", f"SELECT range AS key, coalesce(expire_at_ms = 0 OR expire_at_ms > 10050, FALSE) AS had FROM range(1, 300) LEFT JOIN ({_S}) s ON s.key = range")
def _(s, d):
    new = s.range(1, 300).select(F.col("id").alias("key"), F.lit("n").alias("value"))
    return structures.set_strings(strings(s, d), new, 10050, only_new=True)[1].select("key", (~F.col("done")).alias("had"))


@query("string_increment", f"SELECT key, CAST(CAST(value AS BIGINT) + 2 AS VARCHAR) AS value FROM ({_S}) WHERE expire_at_ms = 0 OR expire_at_ms > 10050")
def _(s, d):
    live = strings(s, d).where(structures.alive(10050))
    return structures.increment(live, live.select("key", F.explode(F.array(F.lit(1), F.lit(1))).alias("n")), 10050).select("key", "value")


@query("ttl_seconds", f"SELECT range AS key, CASE WHEN s.key IS NULL OR (expire_at_ms > 0 AND expire_at_ms <= 10050) THEN -2 WHEN expire_at_ms = 0 THEN -1 ELSE (expire_at_ms - 10050) // 1000 END AS ttl FROM range(1, 2000) LEFT JOIN ({_S}) s ON s.key = range")
def _(s, d):
    return structures.ttl(strings(s, d), s.range(1, 2000).select(F.col("id").alias("key")), 10050)


@query("set_expiry", f"SELECT key, CASE WHEN key % 4 = 0 AND key % 3 = 0 THEN 10050 + 500 ELSE expire_at_ms END AS expire_at_ms FROM ({_S}) WHERE expire_at_ms = 0 OR expire_at_ms > 10050")
def _(s, d):
    asked = strings(s, d).where("key % 3 = 0").select("key", F.lit(500).cast("long").alias("ttl_ms"))
    return structures.set_expiry(strings(s, d), asked, 10050, only_without=True).select("key", "expire_at_ms")


@query("rename_key", "SELECT CASE WHEN user_id = 1 THEN '2' ELSE CAST(user_id AS VARCHAR) END AS key, count(*) AS n FROM events WHERE user_id <> 2 GROUP BY ALL")
def _(s, d):
    rows = event_list(s, d).withColumn("key", F.col("key").cast("string"))
    return structures.rename_key(rows, "1", "2").groupBy("key").agg(F.count("*").alias("n"))


@query("fold_deltas", "SELECT user_id AS key, greatest(count(*) + 100 - CAST(2 * count(*) FILTER (event_type = 'error') AS BIGINT), 0) AS length FROM events GROUP BY user_id")
def _(s, d):
    deltas = table(s, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("n"))
    base = deltas.select("key").distinct().select("key", F.lit(100).cast("long").alias("length"))
    return structures.fold_deltas(base, deltas)


@query("command_batch")
def _(s, d):
    state = strings(s, d).select(F.col("key").cast("string").alias("key"), "value")
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(n).alias("name"), F.lit(a).alias("argument")) for i, (n, a) in enumerate([("INCR", None), ("GET", None), ("SET", "x"), ("INCR", None), ("DEL", None)])])
    return batches.run_batch(state, state.select("key", F.explode(steps).alias("c")).select("key", "c.*"))


# ---- append logs -----------------------------------------------------------------------------------

_X = "SELECT user_id AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq, event_type AS fields FROM events"


def stream(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), millis().alias("ms"), F.col("event_id").alias("seq"), F.col("event_type").alias("fields"))


@query("log_range", f"SELECT key, ms, seq FROM ({_X}) WHERE ms >= 1704500000000 AND ms <= 1705000000000")
def _(s, d):
    return logs.log_range(stream(s, d), "1704500000000", "1705000000000").select("key", "ms", "seq")


@query("log_range_reverse", f"SELECT key, ms, seq FROM ({_X}) WHERE ms < 1705000000000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) <= 3")
def _(s, d):
    return logs.log_range(stream(s, d), "-", "(1705000000000-0", 3, reverse=True).select("key", "ms", "seq")


@query("log_read", f"SELECT key, ms, seq FROM ({_X}) WHERE key < 20 AND ms > 1705276800000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms, seq) <= 5")
def _(s, d):
    cursors = s.range(20).select(F.col("id").alias("key"), F.lit(1705276800000).alias("after_ms"), F.lit(1 << 60).alias("after_seq"))
    return logs.log_read(stream(s, d), cursors, 5).select("key", "ms", "seq")


@query("log_trim", f"SELECT key, ms, seq FROM ({_X}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) <= 4")
def _(s, d):
    return logs.log_trim(stream(s, d), 4).select("key", "ms", "seq")


@query("log_length", f"SELECT key, count(*) AS length FROM ({_X}) GROUP BY key")
def _(s, d):
    return logs.log_length(stream(s, d))


@query("log_add", f"SELECT key, max(ms) AS ms, max(seq) + 2 AS seq FROM (SELECT * FROM ({_X}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC) = 1) GROUP BY key")
def _(s, d):
    rows = stream(s, d)
    new = rows.select("key").distinct().select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.lit("x").alias("fields"))
    return logs.log_trim(logs.log_add(rows, new, 0), 1).select("key", "ms", "seq")


_GIVEN = "(VALUES (0, -1, 5), (1, 1, 0), (2, 1, 0), (3, 0, 9), (4, 1, 1)) AS g(pos, step, seq)"
_LAST = f"SELECT key, max(ms) AS last FROM ({_X}) GROUP BY key"


@query("log_add_given", f"SELECT key, pos, last + step AS ms, CAST(seq AS BIGINT) AS seq FROM ({_LAST}), {_GIVEN} WHERE pos IN (1, 4)")
def _(s, d):
    rows = stream(s, d)
    given = s.createDataFrame([(0, -1, 5), (1, 1, 0), (2, 1, 0), (3, 0, 9), (4, 1, 1)], "pos int, step int, seq long")
    new = rows.groupBy("key").agg(F.max("ms").alias("last")).crossJoin(F.broadcast(given)).select("key", "pos", (F.col("last") + F.col("step")).alias("ms"), "seq", F.lit("x").alias("fields"))
    added = logs.log_add_given(rows, new)[0].join(rows.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti")
    return added.select("key", F.when(F.col("seq") == 0, 1).otherwise(4).alias("pos"), "ms", "seq")


@query("log_add_rejected", f"SELECT key, pos, last + step AS ms, CAST(seq AS BIGINT) AS seq FROM ({_LAST}), {_GIVEN} WHERE pos IN (0, 2, 3)")
def _(s, d):
    rows = stream(s, d)
    given = s.createDataFrame([(0, -1, 5), (1, 1, 0), (2, 1, 0), (3, 0, 9), (4, 1, 1)], "pos int, step int, seq long")
    new = rows.groupBy("key").agg(F.max("ms").alias("last")).crossJoin(F.broadcast(given)).select("key", "pos", (F.col("last") + F.col("step")).alias("ms"), "seq", F.lit("x").alias("fields"))
    return logs.log_add_given(rows, new)[1].select("key", "pos", "ms", "seq")


# ---- queues ----------------------------------------------------------------------------------------

_M = "SELECT event_type AS queue, event_id AS id, props AS body, (epoch_us(ts) // 1000) AS sent_ms, (epoch_us(ts) // 1000) + event_id % 7 * 86400000 AS visible_ms, event_id % 5 AS receive_count, user_id AS group_id, user_id % 10 AS dedup_id FROM events"
_NOW = 1705276800000


def messages(spark, d) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("event_type").alias("queue"), i.alias("id"), F.col("props").alias("body"), millis().alias("sent_ms"), (millis() + i % 7 * 86400000).alias("visible_ms"),
        (i % 5).alias("receive_count"), F.col("user_id").alias("group_id"), (F.col("user_id") % 10).alias("dedup_id"),
    )


@query("queue_receive", f"SELECT queue, id, receive_count + 1 AS receive_count, CAST({_NOW} + 30000 AS BIGINT) AS visible_ms FROM ({_M}) WHERE visible_ms <= {_NOW} QUALIFY row_number() OVER (PARTITION BY queue ORDER BY visible_ms, id) <= 10")
def _(s, d):
    return queues.receive(messages(s, d), _NOW)[1].select("queue", "id", "receive_count", "visible_ms")


@query("queue_counters", f"SELECT queue, count(*) FILTER (visible_ms <= {_NOW}) AS visible, count(*) FILTER (visible_ms > {_NOW} AND receive_count > 0) AS not_visible, count(*) FILTER (visible_ms > {_NOW} AND receive_count = 0) AS delayed FROM ({_M}) GROUP BY queue")
def _(s, d):
    return queues.counters(messages(s, d), _NOW)


@query("queue_redrive", f"SELECT id, CASE WHEN receive_count + 1 > 3 THEN 'dead' ELSE queue END AS queue, CASE WHEN receive_count + 1 > 3 THEN queue END AS dead_letter_source FROM ({_M})")
def _(s, d):
    return queues.redrive(messages(s, d), 3, "dead").select("id", "queue", "dead_letter_source")


@query("queue_retention", f"SELECT id FROM ({_M}) WHERE {_NOW} - sent_ms <= 345600000")
def _(s, d):
    return queues.retained(messages(s, d), _NOW, 345600000).select("id")


@query("queue_sweep", f"SELECT CASE WHEN receive_count + 1 > 4 THEN 'dead' ELSE queue END AS queue, count(*) AS n FROM ({_M}) WHERE {_NOW} - sent_ms <= 345600000 GROUP BY ALL")
def _(s, d):
    return queues.sweep(messages(s, d), _NOW, 345600000, 4, "dead").groupBy("queue").agg(F.count("*").alias("n"))


@query("queue_fifo_heads", f"SELECT queue, group_id, id FROM (SELECT * FROM ({_M}) QUALIFY row_number() OVER (PARTITION BY queue, group_id ORDER BY sent_ms, id) = 1) m WHERE visible_ms <= {_NOW} AND (queue, group_id) NOT IN (SELECT (queue, group_id) FROM ({_M}) WHERE visible_ms > {_NOW} AND receive_count > 0)")
def _(s, d):
    return queues.fifo_heads(messages(s, d), _NOW).select("queue", "group_id", "id")


@query("queue_fifo_partition")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", queues.fifo_partition(F.col("c_name"), 16).alias("partition"))


@query("queue_deduplicate", f"""WITH RECURSIVE m AS (SELECT queue, dedup_id, id, sent_ms, row_number() OVER (PARTITION BY queue, dedup_id ORDER BY sent_ms, id) AS n FROM ({_M})),
f AS (SELECT queue, dedup_id, id, sent_ms, n, id AS original, sent_ms + 86400000 AS until FROM m WHERE n = 1
UNION ALL SELECT m.queue, m.dedup_id, m.id, m.sent_ms, m.n, CASE WHEN m.sent_ms > f.until THEN m.id ELSE f.original END, CASE WHEN m.sent_ms > f.until THEN m.sent_ms + 86400000 ELSE f.until END
FROM f JOIN m ON m.queue = f.queue AND m.dedup_id = f.dedup_id AND m.n = f.n + 1)
SELECT queue, id, original FROM f""")
def _(s, d):
    return queues.deduplicate(messages(s, d), 86400000).select("queue", "id", "original")


@query("queue_throttle")
def _(s, d):
    asked = messages(s, d).select("queue", "id", F.col("sent_ms").alias("ts_ms"), (F.col("id") % 4 + 1).alias("n"))
    return queues.throttle(asked, 10.0, 0.001)


@query("queue_change_visibility", f"SELECT id, CASE WHEN id % 3 = 0 THEN {_NOW} + 60000 ELSE visible_ms END AS visible_ms FROM ({_M})")
def _(s, d):
    handles = messages(s, d).where("id % 3 = 0").select("queue", "id", "receive_count", F.lit(60).alias("timeout_s"))
    return queues.change_visibility(messages(s, d), handles, _NOW).select("id", "visible_ms")


@query("queue_delete", f"SELECT id FROM ({_M}) WHERE id % 3 <> 0")
def _(s, d):
    handles = messages(s, d).where("id % 3 = 0").unionByName(messages(s, d).where("id % 3 = 1").withColumn("receive_count", F.col("receive_count") + 1))
    return queues.delete_received(messages(s, d), handles).select("id")


@query("queue_digest", "SELECT event_id AS id, md5(props) AS digest, sha256(props) AS dedup FROM events")
def _(s, d):
    return messages(s, d).select("id", queues.body_digest(F.col("body")).alias("digest"), queues.content_dedup_id(F.col("body")).alias("dedup"))


@query("queue_peek", f"SELECT id, substr(body, 1, 4) AS body, length(body) > 4 AS truncated FROM ({_M}) WHERE queue = 'view' AND id > 100 ORDER BY id LIMIT 20")
def _(s, d):
    return queues.peek(messages(s, d), "view", 100, 20, 4).select("id", "body", "truncated")


@query("queue_list", "SELECT DISTINCT event_type AS name FROM events WHERE event_type > 'click' AND starts_with(event_type, 'e') ORDER BY 1 LIMIT 3")
def _(s, d):
    return queues.list_queues(table(s, d, "events").select(F.col("event_type").alias("name")).distinct(), "e", "click", 3)


@query("queue_purge", "SELECT event_type AS queue, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL")
def _(s, d):
    return queues.purge(messages(s, d), "view").groupBy("queue").agg(F.count("*").alias("n"))


# ---- objects ---------------------------------------------------------------------------------------


@query("list_objects_delimiter", "SELECT name, is_prefix, n FROM (SELECT CASE WHEN instr(substr(url, 8), '/') > 0 THEN substr(url, 1, 7 + instr(substr(url, 8), '/')) ELSE url END AS name, instr(substr(url, 8), '/') > 0 AS is_prefix, count(*) AS n FROM pages WHERE starts_with(url, 'http://') GROUP BY ALL) ORDER BY name LIMIT 50")
def _(s, d):
    return objects.list_objects(table(s, d, "pages").select(F.col("url").alias("key")), "http://", "/", "", 50)


@query("list_objects_after", "SELECT url AS name FROM pages WHERE starts_with(url, 'https://') AND url > 'https://m.' ORDER BY url LIMIT 25")
def _(s, d):
    return objects.list_objects(table(s, d, "pages").select(F.col("url").alias("key")), "https://", "", "https://m.", 25).select("name")


def chunks(spark, d) -> DataFrame:
    """The bytes of nation names, five to a chunk."""
    rows = table(spark, d, "part").select(F.lit("b").alias("bucket"), F.col("p_partkey").cast("string").alias("key"), F.encode("p_name", "UTF-8").alias("all"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.lit(1).alias("part"), i.alias("chunk")))
    cut = rows.select("bucket", "key", "all", F.explode(numbers).alias("c")).select("bucket", "key", "c.part", "c.chunk", F.substring("all", F.col("c.chunk") * 5 + 1, F.when(F.col("c.chunk") < 4, F.lit(5)).otherwise(F.lit(1 << 20))).alias("data"))
    return cut.where(F.octet_length("data") > 0)


@query("get_object", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS text FROM part")
def _(s, d):
    return objects.get_object(chunks(s, d)).select("key", F.decode("data", "UTF-8").alias("text"))


@query("get_object_range", "SELECT CAST(p_partkey AS VARCHAR) AS key, substr(p_name, 4, 5) AS text FROM part WHERE length(p_name) > 3")
def _(s, d):
    first, last = objects.parse_range("bytes=3-7", 1 << 20)
    return objects.get_object(chunks(s, d), first, last).select("key", F.decode("data", "UTF-8").alias("text"))


@query("multipart_etag", "SELECT n_regionkey AS key, md5(unhex(string_agg(md5(n_name), '' ORDER BY n_nationkey))) || '-' || count(*) AS etag FROM nation GROUP BY n_regionkey")
def _(s, d):
    parts = table(s, d, "nation").select(F.lit("b").alias("bucket"), F.col("n_regionkey").alias("key"), F.col("n_nationkey").alias("part"), F.md5("n_name").alias("etag"))
    return objects.multipart_etag(parts).select("key", "etag")


@query("put_objects_if_absent", "SELECT n_nationkey AS key, n_nationkey >= 5 AS ok FROM nation")
def _(s, d):
    rows = table(s, d, "nation").select(F.lit("b").alias("bucket"), F.col("n_nationkey").alias("key"), F.md5("n_name").alias("etag"))
    return objects.put_objects(rows.where("key < 5"), rows, if_none_match=True)[1].select("key", "ok")


@query("damaged_chunks", "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 9 <> 0)")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.when(F.col("doc_id") % 9 == 0, F.lit("x")).otherwise(F.col("text")).cast("binary").alias("data"))
    return objects.damaged_chunks(rows.select("doc_id", "sha"), rows).select("doc_id")


@query("fs_paths", "SELECT '/' || r_name AS path FROM region UNION ALL SELECT '/' || r_name || '/' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(s, d):
    top = table(s, d, "region").select(F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).cast("long").alias("inode"))
    below = table(s, d, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("inode"))
    return objects.resolve_paths(top.unionByName(below)).select("path")


@query("fs_usage", "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def _(s, d):
    return objects.usage(table(s, d, "documents"), F.col("text"))


@query("fs_orphans", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) AND NOT (c_custkey % 2 = 0)")
def _(s, d):
    inodes = table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    leases = inodes.where("id % 2 = 0").select(F.col("id").alias("inode"), F.lit(100).alias("expire_ms"))
    return objects.orphans(inodes, table(s, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("inode")), leases, 50).select("id")


# ---- routes, heat map, decisions -------------------------------------------------------------------

_R = "SELECT range AS id, printf('Customer#%09d', range * 97) AS start, CASE WHEN range < 14 THEN printf('Customer#%09d', range * 97 + 97) END AS \"end\", 1 AS version FROM range(15)"


def route_table(spark) -> DataFrame:
    name = lambda c: F.format_string("Customer#%09d", c)
    i = F.col("id")
    return spark.range(15).select("id", name(i * 97).alias("start"), F.when(i < 14, name(i * 97 + 97)).alias("end"), F.lit(1).alias("version"))


@query("route_lookup", f"SELECT c_custkey, id FROM customer JOIN ({_R}) ON c_name >= start AND (\"end\" IS NULL OR c_name < \"end\")")
def _(s, d):
    return routes.lookup(table(s, d, "customer").withColumnRenamed("c_name", "key"), route_table(s)).select("c_custkey", "id")


@query("route_overlap", f"SELECT id FROM ({_R}) WHERE (\"end\" IS NULL OR \"end\" > 'Customer#000000300') AND start < 'Customer#000000700'")
def _(s, d):
    return routes.overlapping(route_table(s), "Customer#000000300", "Customer#000000700").select("id")


@query("route_split", f"SELECT id, start, \"end\", version FROM ({_R}) WHERE id <> 2 UNION ALL SELECT 15, 'Customer#000000194', 'Customer#000000200', 2 UNION ALL SELECT 16, 'Customer#000000200', 'Customer#000000291', 2")
def _(s, d):
    return routes.split(route_table(s), 2, "Customer#000000200", 1)


@query("route_faults", f"SELECT id FROM ({_R}) WHERE false")
def _(s, d):
    return routes.faults(route_table(s)).select("id")


@query("route_faults_found", f"WITH r AS (SELECT id, CASE WHEN id = 3 THEN \"end\" ELSE start END AS start, CASE WHEN id = 3 THEN start WHEN id = 5 THEN 'Customer#999999999' ELSE \"end\" END AS \"end\" FROM ({_R})) SELECT id FROM (SELECT *, lead(start) OVER (ORDER BY start, id) AS nxt FROM r) WHERE (\"end\" IS NOT NULL AND start >= \"end\") OR (nxt IS NOT NULL AND (\"end\" IS NULL OR \"end\" > nxt))")
def _(s, d):
    r = route_table(s)
    turned = r.select("id", F.when(F.col("id") == 3, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(F.col("id") == 3, F.col("start")).when(F.col("id") == 5, F.lit("Customer#999999999")).otherwise(F.col("end")).alias("end"))
    return routes.faults(turned).select("id")


@query("route_changes", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'removed'), (CAST(15 AS BIGINT), 'added'), (CAST(16 AS BIGINT), 'added')) AS t(id, kind)")
def _(s, d):
    return routes.changes(route_table(s), routes.split(route_table(s), 2, "Customer#000000200", 1))


@query("route_key", "SELECT c_custkey, substr(c_name, 10) AS rk FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", routes.route_key(F.col("c_name"), [("Customer#", "|"), ("x", "")]).alias("rk"))


@query("sub_bucket", "SELECT o_orderkey, CAST(least(greatest((o_orderkey - 1000) * 16 // 9000, 0), 15) AS INTEGER) AS bucket FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", routes.sub_bucket(F.col("o_orderkey"), F.lit(1000), F.lit(10000), 16).alias("bucket"))


_F = "SELECT event_type AS route_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"at\", CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS reads, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS writes FROM events GROUP BY ALL"


def facts(spark, d) -> DataFrame:
    w = F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).cast("long")
    return heatmap.observe(table(spark, d, "events"), F.col("event_type"), F.col("ts"), 1 - w, w, "1 hour")


@query("heatmap_windows", _F)
def _(s, d):
    return facts(s, d)


@query("heatmap_history", f"SELECT * FROM ({_F}) WHERE \"at\" >= TIMESTAMP '2024-01-10' AND \"at\" < TIMESTAMP '2024-01-12'")
def _(s, d):
    return heatmap.history(facts(s, d), stamp("2024-01-10"), stamp("2024-01-12"))


_DAYS = ["2024-01-05", "2024-01-06", "2024-01-07"]


@query("heatmap_matrix", f"SELECT route_id, {', '.join(f'CAST(coalesce(sum(reads) FILTER (CAST({chr(34)}at{chr(34)} AS DATE) = DATE {chr(39)}{x}{chr(39)}), 0) AS BIGINT) AS {chr(34)}{x}{chr(34)}' for x in _DAYS)} FROM ({_F}) GROUP BY route_id")
def _(s, d):
    return heatmap.matrix(facts(s, d).withColumn("at", F.date_format("at", "yyyy-MM-dd")), "reads", _DAYS)


@query("heatmap_busiest", f"SELECT route_id, CAST(sum(reads + writes) AS BIGINT) AS total FROM ({_F}) GROUP BY route_id ORDER BY total DESC, route_id LIMIT 3")
def _(s, d):
    return heatmap.busiest(facts(s, d), 3, F.col("reads") + F.col("writes"))


@query("heatmap_fold_cold", "SELECT CASE WHEN o_custkey <= 10 THEN o_custkey ELSE -1 END AS route_id, CAST(count(*) AS BIGINT) AS reads FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders) GROUP BY ALL")
def _(s, d):
    rows = table(s, d, "orders").groupBy(F.col("o_custkey").alias("route_id")).agg(F.count("*").alias("reads")).withColumn("at", F.lit(0)).withColumn("writes", F.lit(0))
    n = rows.where("route_id <= 10").count()
    return heatmap.fold_cold(rows, n).select(F.col("route_id").cast("long").alias("route_id"), "reads")


_N = "SELECT l_partkey % 50 AS route_id, l_linenumber AS node, CASE WHEN l_partkey % 50 = 7 THEN 0 ELSE l_suppkey % 3 + 1 END AS group_id, l_suppkey % 2 + 1 AS term, CAST(l_quantity AS BIGINT) AS writes, CAST(l_quantity AS BIGINT) + 1 AS reads FROM lineitem"


def nodes(spark, d) -> DataFrame:
    r = F.col("l_partkey") % 50
    return table(spark, d, "lineitem").select(
        r.alias("route_id"), F.col("l_linenumber").alias("node"), F.when(r == 7, 0).otherwise(F.col("l_suppkey") % 3 + 1).alias("group_id"), (F.col("l_suppkey") % 2 + 1).alias("term"),
        F.col("l_quantity").cast("long").alias("writes"), (F.col("l_quantity").cast("long") + 1).alias("reads"), F.lit(0).alias("at"),
    )


@query("merge_reads", f"SELECT route_id, CAST(sum(reads) AS BIGINT) AS reads FROM ({_N}) GROUP BY route_id")
def _(s, d):
    return heatmap.merge_reads(nodes(s, d)).select("route_id", "reads")


@query("merge_writes", f"SELECT route_id, CAST(CASE WHEN bool_or(group_id = 0 OR term = 0) THEN max(w) ELSE sum(w) END AS BIGINT) AS writes, bool_or(c) AS conflict FROM (SELECT route_id, group_id, term, max(writes) AS w, min(writes) <> max(writes) AS c FROM ({_N}) GROUP BY ALL) GROUP BY route_id")
def _(s, d):
    return heatmap.merge_writes(nodes(s, d)).select("route_id", "writes", "conflict")


@query("hot_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(s, d):
    return heatmap.hot_keys(table(s, d, "events"), "user_id", 10)


@query("hot_keys_sketch")
def _(s, d):
    return heatmap.hot_keys_sketch(table(s, d, "events"), "user_id", 10)


@query("hot_keys_space_saving")
def _(s, d):
    return heatmap.space_saving(table(s, d, "events"), "user_id", 200)


@query("hot_keys_sampled")
def _(s, d):
    return heatmap.sampled_counts(table(s, d, "events"), "user_id", 4, 10)


@query("hot_keys_merge", "SELECT l_partkey % 50 AS k, CAST(sum(l_quantity) AS BIGINT) AS n, max(l_linenumber) AS rate FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 5")
def _(s, d):
    rows = table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("k"), F.col("l_quantity").cast("long").alias("n"), F.lit(0).alias("bound"), F.col("l_linenumber").alias("rate"))
    return heatmap.merge_hot_keys(rows, "k", 5).select("k", "n", "rate")


@query("split_score", f"SELECT route_id, CAST(sum(writes) AS DOUBLE) * 60 / 3600 * 4 + CAST(sum(reads) AS DOUBLE) * 60 / 3600 AS score FROM ({_F}) GROUP BY route_id")
def _(s, d):
    return heatmap.split_score(facts(s, d), 3600).withColumn("score", F.col("score"))


SQL["split_score"] = f"SELECT route_id, CAST(round(score * 1000) AS BIGINT) AS score FROM ({SQL['split_score']})"
_raw_score = QUERIES["split_score"]
QUERIES["split_score"] = lambda s, d: _raw_score(s, d).select("route_id", F.round(F.col("score") * 1000).cast("long").alias("score"))

_B = "SELECT route_id, sub_bucket, n * (sub_bucket + 1) AS load, chr(CAST(97 + sub_bucket AS INTEGER)) AS start, chr(CAST(98 + sub_bucket AS INTEGER)) AS \"end\" FROM (SELECT c_nationkey AS route_id, c_custkey % 8 AS sub_bucket, count(*) AS n FROM customer GROUP BY ALL)"


@query("split_key", f"""WITH r AS (SELECT *, sum(load) OVER (PARTITION BY route_id ORDER BY sub_bucket) AS upto, sum(load) OVER (PARTITION BY route_id) AS total FROM ({_B})),
p AS (SELECT * FROM r WHERE upto * 2 >= total QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY sub_bucket) = 1)
SELECT route_id, CASE WHEN "end" >= 'i' THEN start ELSE "end" END AS split_key, CASE WHEN "end" >= 'i' THEN 'p50_last_bucket_lo' WHEN sub_bucket = 0 THEN 'p50_first_bucket_hi' ELSE 'p50_mid' END AS origin FROM p""")
def _(s, d):
    b = F.col("c_custkey") % 8
    rows = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("route_id"), b.alias("sub_bucket")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("load", F.col("n") * (F.col("sub_bucket") + 1)).withColumn("start", F.char(97 + F.col("sub_bucket"))).withColumn("end", F.char(98 + F.col("sub_bucket")))
    return heatmap.split_key(rows, table(s, d, "nation").select(F.col("n_nationkey").alias("route_id"), F.lit("a").alias("start"), F.lit("i").alias("end")))


@query("consecutive_hot", f"""WITH w AS (SELECT route_id, "at", reads + writes AS score FROM ({_F})), m AS (SELECT *, score >= 2 AS hot, sum(CASE WHEN score >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY route_id ORDER BY "at") AS island FROM w)
SELECT route_id, "at", CAST(row_number() OVER (PARTITION BY route_id, island, hot ORDER BY "at") AS INTEGER) AS streak FROM m QUALIFY hot AND streak >= 3""")
def _(s, d):
    return heatmap.consecutive_hot(facts(s, d).withColumn("score", F.col("reads") + F.col("writes")), 2, 3)


@query("split_decisions", "SELECT s_suppkey AS route_id, CASE WHEN s_nationkey % 5 < 3 THEN 'not_hot_long_enough' WHEN s_suppkey % 3 = 0 THEN 'no_split_key' WHEN row_number() OVER (PARTITION BY s_nationkey % 5 >= 3 AND s_suppkey % 3 <> 0 ORDER BY s_acctbal DESC, s_suppkey) > 4 THEN 'over_budget' ELSE 'split' END AS reason FROM supplier")
def _(s, d):
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("route_id"), F.col("s_acctbal").alias("score"), (F.col("s_nationkey") % 5).alias("streak"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("k")).alias("split_key"))
    return heatmap.decide(rows, 4).select("route_id", "reason")


# ---- comparison and metrics ------------------------------------------------------------------------


@query("shadow_compare", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'migration_gap' WHEN c_custkey % 10 = 2 THEN 'data_mismatch' END AS kind FROM customer WHERE c_custkey % 10 IN (1, 2) UNION ALL SELECT c_custkey + 10000000, 'extra_data' FROM customer WHERE c_custkey % 10 = 3")
def _(s, d):
    a = table(s, d, "customer").select("c_custkey", "c_name")
    b = a.where("c_custkey % 10 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 2, F.lit(None)).otherwise(F.col("c_name")))
    return compare.divergence(a, b.unionByName(a.where("c_custkey % 10 = 3").withColumn("c_custkey", F.col("c_custkey") + 10000000)), "c_custkey", "c_name")


@query("service_metrics", "SELECT event_type, count(*) AS requests, count(*) FILTER (value > 50) AS errors, CAST(round(max(value) * 1000) AS BIGINT) AS largest FROM events GROUP BY event_type")
def _(s, d):
    return compare.service_metrics(table(s, d, "events"), "event_type", "value", F.col("value") > 50).select("event_type", "requests", "errors", F.round(F.col("largest") * 1000).cast("long").alias("largest"))


@query("command_classes", "SELECT * FROM (VALUES ('GET', 'read'), ('zadd', 'write'), ('BZPOPMIN', 'blocking'), ('EVAL', 'script'), ('NOPE', 'other')) AS t(command, class)")
def _(s, d):
    rows = s.createDataFrame([("GET",), ("zadd",), ("BZPOPMIN",), ("EVAL",), ("NOPE",)], "command string")
    return rows.withColumn("class", compare.command_class(F.col("command")))


@query("command_routing", "SELECT * FROM (VALUES ('get', 'read'), ('MGET', 'read'), ('INCRBY', 'write'), ('BLPOP', 'blocking'), ('XREAD', 'blocking'), ('XREADGROUP', 'read'), ('PUBLISH', 'write'), ('SCAN', 'admin'), ('FCALL', 'script'), ('EXEC', 'transaction'), ('SSUBSCRIBE', 'pubsub'), ('NOPE', 'write')) AS t(command, class)")
def _(s, d):
    calls = [("get", ["a"]), ("MGET", ["a", "b"]), ("INCRBY", ["a", "1"]), ("BLPOP", ["a", "0"]), ("XREAD", ["block", "0", "STREAMS", "a", "$"]), ("XREADGROUP", ["GROUP", "g", "c"]), ("PUBLISH", ["c", "m"]), ("SCAN", ["0"]), ("FCALL", ["f"]), ("EXEC", []), ("SSUBSCRIBE", ["c"]), ("NOPE", None)]
    rows = s.createDataFrame(calls, "command string, arguments array<string>")
    return rows.select("command", compare.routing_class(F.col("command"), F.col("arguments")).alias("class"))


@query("channel_counts", "SELECT event_type AS channel, count(DISTINCT user_id) AS subscribers FROM events GROUP BY ALL")
def _(s, d):
    return compare.channel_counts(table(s, d, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("client")))
