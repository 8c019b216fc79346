"""Keyed structures as long tables: strings, lists, hashes, sets, sorted sets, and the key space.

A list is (key, seq, value), a hash (key, field, value), a set (key, member), a sorted set (key, member,
score), a string (key, value, expire_at_ms). Every operator works on all keys at once; a single key is
a filter. Ranks are windows by key; counts, lengths and extrema are aggregates with partial sums.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class WrongNumber(ValueError):
    """A bound or number that can't be read."""


# ---- key space -------------------------------------------------------------------------------------


def alive(now_ms) -> Column:
    """Rows that haven't expired; 0 or null never expires."""
    e = F.coalesce(F.col("expire_at_ms"), F.lit(0))
    return (e == 0) | (e > F.lit(now_ms))


def key_space(**structures: DataFrame) -> DataFrame:
    """(key, type) of tables by type name, probed in the order none of them shares keys: string, list, hash, set, zset, stream."""
    order = ["string", "list", "hash", "set", "zset", "stream"]
    parts = [structures[t].select("key").distinct().select("key", F.lit(t).alias("type"), F.lit(i).alias("_n")) for i, t in enumerate(order) if t in structures]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("key").agg(F.min_by("type", "_n").alias("type"))


def type_of(space: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(space, "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def glob(column: Column, pattern: str) -> Column:
    """* stands for any characters; nothing else is special. The part before the first * becomes a prefix test for the scan."""
    head, star, rest = pattern.partition("*")
    if not star:
        return column == F.lit(pattern)
    met = F.startswith(column, F.lit(head)) if head else F.lit(True)
    if rest.strip("*"):
        met = met & column.rlike("(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")
    return met


def keys_like(keys: DataFrame, pattern: str) -> DataFrame:
    return keys.where(glob(F.col("key"), pattern)).select("key").orderBy("key")


def scan_page(keys: DataFrame, cursor: int, count: int = 10, pattern: str | None = None) -> DataFrame:
    """Keys of the page at an offset into the sorted keys, those that match, with the next cursor (0 at the end)."""
    page = keys.select("key").distinct().orderBy("key").offset(cursor).limit(count + 1)
    n = page.agg(F.when(F.count("*") > count, F.lit(cursor + count)).otherwise(F.lit(0)).alias("next"))
    page = page.orderBy("key").limit(count)
    return (page.where(glob(F.col("key"), pattern)) if pattern else page).join(F.broadcast(n))


def db_size(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count_distinct("key").alias("size"))


def exists_count(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """How many of the asked keys exist, repeats counted."""
    return asked.join(keys.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("found"))


def drop_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("key").distinct(), "key", "left_anti")


def rename_key(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of old under new, which loses its own."""
    return rows.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key")))


def flush(rows: DataFrame, prefix: str = "") -> DataFrame:
    return rows.where(~F.startswith("key", F.lit(prefix)) if prefix else F.lit(False))


def ttl(rows: DataFrame, asked: DataFrame, now_ms, millis: bool = False) -> DataFrame:
    """-2 for keys that don't exist, -1 for those that never expire, else what is left (seconds cut off)."""
    left = F.col("expire_at_ms") - F.lit(now_ms)
    joined = asked.join(rows.where(alive(now_ms)).select("key", F.coalesce("expire_at_ms", F.lit(0)).alias("expire_at_ms"), F.lit(True).alias("_in")), "key", "left")
    value = F.when(F.col("_in").isNull(), F.lit(-2)).when(F.col("expire_at_ms") == 0, F.lit(-1)).otherwise(left if millis else F.floor(left / 1000))
    return joined.select("key", value.cast("long").alias("ttl"))


def set_expiry(rows: DataFrame, asked: DataFrame, now_ms, only_without: bool = False) -> DataFrame:
    """rows after EXPIRE: asked has key and ttl_ms; a ttl of 0 or less deletes; only_without leaves keys that have one."""
    joined = rows.where(alive(now_ms)).join(asked.select("key", "ttl_ms"), "key", "left")
    takes = F.col("ttl_ms").isNotNull() & (F.coalesce("expire_at_ms", F.lit(0)) == 0 if only_without else F.lit(True))
    joined = joined.where(~(takes & (F.col("ttl_ms") <= 0)))
    return joined.withColumn("expire_at_ms", F.when(takes, F.lit(now_ms) + F.col("ttl_ms")).otherwise(F.col("expire_at_ms"))).select(*rows.columns)


# ---- strings ---------------------------------------------------------------------------------------


def get_strings(rows: DataFrame, asked: DataFrame, now_ms) -> DataFrame:
    return asked.join(rows.where(alive(now_ms)).select("key", "value"), "key", "left")


def set_strings(rows: DataFrame, new: DataFrame, now_ms, ttl_ms: int | None = None, only_new: bool = False, only_old: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows after SET, results: key, done, old). new: key, value."""
    if only_new and only_old:
        raise WrongNumber("NX and XX exclude each other")
    if ttl_ms is not None and ttl_ms <= 0:
        raise WrongNumber("a time to live is positive")
    there = rows.where(alive(now_ms))
    judged = new.select("key", F.col("value").alias("new")).join(there.select("key", F.col("value").alias("old"), F.lit(True).alias("_in")), "key", "left")
    done = F.lit(True) if not (only_new or only_old) else F.col("_in").isNull() if only_new else F.col("_in").isNotNull()
    judged = judged.withColumn("done", done)
    put = judged.where("done").select("key", F.col("new").alias("value"), F.lit(0 if ttl_ms is None else now_ms + ttl_ms).cast("long").alias("expire_at_ms"))
    return there.join(put.select("key"), "key", "left_anti").unionByName(put), judged.select("key", "done", "old")


def increment(rows: DataFrame, steps: DataFrame, now_ms) -> DataFrame:
    """rows after INCR by the sum of steps (key, n); times to live stay; values that are no integers give null in a column `value`."""
    total = steps.groupBy("key").agg(F.sum("n").alias("_n"))
    joined = rows.where(alive(now_ms)).join(total, "key", "full_outer")
    value = F.when(F.col("_n").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("_n").cast("string")).otherwise((F.expr("try_cast(value AS BIGINT)") + F.col("_n")).cast("string"))
    return joined.select("key", value.alias("value"), F.coalesce("expire_at_ms", F.lit(0)).alias("expire_at_ms"))


def take_strings(rows: DataFrame, keys: DataFrame, now_ms) -> tuple[DataFrame, DataFrame]:
    """GETDEL: (rows left, values)."""
    return drop_keys(rows, keys), get_strings(rows, keys, now_ms)


# ---- lists -----------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, order: list, by: str = "key") -> DataFrame:
    """rank from 0 and size by key."""
    own = Window.partitionBy(by)
    return rows.withColumn("_rank", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_size", F.count("*").over(own))


def _from_end(i: int) -> Column:
    return F.lit(i) if i >= 0 else F.col("_size") + i


def _between_ranks(start: int, stop: int) -> Column:
    return F.col("_rank").between(F.greatest(_from_end(start), F.lit(0)), _from_end(stop))


def list_range(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE of every list: ranks start to stop, both included, negative from the end."""
    return _ranked(rows, ["seq"]).where(_between_ranks(start, stop)).select(*rows.columns, F.col("_rank").alias("rank"))


def list_index(rows: DataFrame, i: int) -> DataFrame:
    return _ranked(rows, ["seq"]).where(F.col("_rank") == _from_end(i)).select(*rows.columns)


def list_length(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("length"))


def push(rows: DataFrame, values: DataFrame, left: bool = False) -> DataFrame:
    """values: key, pos, value in the order given; pushed to the left the last one comes first."""
    ends = rows.groupBy("key").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    seq = F.coalesce("_lo", F.lit(0)) - n if left else F.coalesce("_hi", F.lit(-1)) + n
    return rows.unionByName(values.join(ends, "key", "left").withColumn("seq", seq).select("key", "seq", "value"))


def pop(rows: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows left, rows popped) of every list."""
    order = [F.col("seq").asc() if left else F.col("seq").desc()]
    ranked = _ranked(rows, order)
    return ranked.where(F.col("_rank") >= count).select(*rows.columns), ranked.where(F.col("_rank") < count).select(*rows.columns)


def rotate(rows: DataFrame, source: str, target: str) -> DataFrame:
    """RPOPLPUSH: the last value of source becomes the first of target."""
    left, popped = pop(rows.where(F.col("key") == source), 1, left=False)
    others = rows.where(F.col("key") != source).unionByName(left)
    return push(others, popped.select(F.lit(target).alias("key"), F.lit(0).alias("pos"), "value"), left=True)


def trim(rows: DataFrame, start: int, stop: int) -> DataFrame:
    return list_range(rows, start, stop).select(*rows.columns)


def remove_values(rows: DataFrame, value, count: int) -> DataFrame:
    """LREM: the first count of a value from the head (negative: from the tail; 0: all) go."""
    same = F.col("value") == F.lit(value)
    if count == 0:
        return rows.where(~F.coalesce(same, F.lit(False)))
    order = F.col("seq").asc() if count > 0 else F.col("seq").desc()
    nth = F.row_number().over(Window.partitionBy("key", F.coalesce(same, F.lit(False))).orderBy(order))
    return rows.withColumn("_nth", nth).where(~(F.coalesce(same, F.lit(False)) & (F.col("_nth") <= abs(count)))).select(*rows.columns)


def set_at(rows: DataFrame, i: int, value) -> DataFrame:
    return _ranked(rows, ["seq"]).withColumn("value", F.when(F.col("_rank") == _from_end(i), F.lit(value)).otherwise(F.col("value"))).select(*rows.columns)


def position_of(rows: DataFrame, value) -> DataFrame:
    """First rank of a value in each list that has it."""
    return _ranked(rows, ["seq"]).where(F.col("value") == F.lit(value)).groupBy("key").agg(F.min("_rank").alias("position"))


# ---- hashes ----------------------------------------------------------------------------------------


def _replies(asked: DataFrame, rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(key, added; key, removed): how many of each asked key's distinct members or fields rows lacks, and has.

    Every asked key has its reply, 0 as well."""
    joined = asked.select("key", by).distinct().join(rows.select("key", by, F.lit(True).alias("_in")), ["key", by], "left").groupBy("key")
    return joined.agg(F.count_if(F.col("_in").isNull()).alias("added")), joined.agg(F.count("_in").alias("removed"))


def hash_set(rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, key and number of fields added). new: key, field, value, without repeats."""
    added = _replies(new, rows, "field")[0]
    return rows.join(new.select("key", "field"), ["key", "field"], "left_anti").unionByName(new.select(*rows.columns)), added


def hash_get(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, field) with value, null where there is none."""
    return asked.join(rows, ["key", "field"], "left")


def hash_all(rows: DataFrame) -> DataFrame:
    """fields: a key's fields and values sorted, as JSON text."""
    return rows.groupBy("key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("value").cast("string")))))).alias("fields"))


def hash_length(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("length"))


def hash_delete(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.join(asked, ["key", "field"], "left_anti"), _replies(asked, rows, "field")[1]


def hash_increment(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """steps: key, field, n. Missing fields count as 0; values that are no integers give null."""
    total = steps.groupBy("key", "field").agg(F.sum("n").alias("_n"))
    joined = rows.join(total, ["key", "field"], "full_outer")
    value = F.when(F.col("_n").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("_n").cast("string")).otherwise((F.expr("try_cast(value AS BIGINT)") + F.col("_n")).cast("string"))
    return joined.select("key", "field", value.alias("value"))


# ---- sets ------------------------------------------------------------------------------------------


def set_add(rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, key and number of members added; 0 where a key had them all)."""
    fresh = new.select("key", "member").distinct().join(rows, ["key", "member"], "left_anti")
    return rows.unionByName(fresh), _replies(new, rows, "member")[0]


def set_remove(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.join(gone.select("key", "member"), ["key", "member"], "left_anti"), _replies(gone, rows, "member")[1]


def set_has(rows: DataFrame, asked: DataFrame) -> DataFrame:
    there = rows.select("key", "member", F.lit(True).alias("_in"))
    return asked.join(there, ["key", "member"], "left").withColumn("found", F.coalesce("_in", F.lit(False))).drop("_in")


def set_members(rows: DataFrame) -> DataFrame:
    """Members of each set, sorted and comma-joined."""
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(F.col("member").cast("string"))), ",").alias("members"))


def set_size(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count_distinct("member").alias("size"))


def union_size(rows: DataFrame, keys: list, approximate: bool = False) -> DataFrame:
    """Members of the union of some sets: exact; on demand by a HyperLogLog sketch."""
    found = rows.where(F.col("key").isin(*keys))
    return found.agg((F.hll_sketch_estimate(F.hll_sketch_agg("member")) if approximate else F.count_distinct("member")).alias("size"))


# ---- sorted sets -----------------------------------------------------------------------------------

_UP = ["score", "member"]


def zset_add(rows: DataFrame, new: DataFrame, only_new: bool = False, only_old: bool = False, greater: bool = False, less: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, key and number added). new: key, pos, member, score; later pairs of a member see the earlier ones.

    Under the flags a member's pairs fold to one: its first (only_new), greatest, least or last score."""
    if (only_new and (only_old or greater or less)) or (greater and less):
        raise WrongNumber("flags exclude each other")
    fold = F.min_by("score", "pos") if only_new else F.max("score") if greater else F.min("score") if less else F.max_by("score", "pos")
    one = new.groupBy("key", "member").agg(fold.alias("_new"))
    joined = rows.join(one, ["key", "member"], "full_outer")
    there, asked = F.col("score").isNotNull(), F.col("_new").isNotNull()
    better = F.col("_new") > F.col("score") if greater else F.col("_new") < F.col("score") if less else F.lit(not only_new)
    score = F.when(asked & ~there & F.lit(not only_old), F.col("_new")).when(asked & there & better, F.col("_new")).otherwise(F.col("score"))
    added = joined.where(asked).groupBy("key").agg(F.count_if(~there & F.lit(not only_old)).alias("added"))
    return joined.withColumn("score", score + F.lit(0.0)).where("score IS NOT NULL").select("key", "member", "score"), added


def zset_increment(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """steps: key, member, n (sums in any order)."""
    total = steps.groupBy("key", "member").agg(F.sum("n").alias("_n"))
    return rows.join(total, ["key", "member"], "full_outer").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0))).alias("score"))


def zset_remove(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["key", "member"], "left_anti")


def zset_range(rows: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Ranks start to stop by score and member, or exactly reversed, with rank."""
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in _UP]
    return _ranked(rows, order).where(_between_ranks(start, stop)).select("key", "member", "score", F.col("_rank").alias("rank"))


def score_bound(text: str) -> tuple[float, bool]:
    """(score, included) of a bound such as -inf, +inf, 3.5 or (3.5."""
    body = text[1:] if text.startswith("(") else text
    try:
        return float(body), not text.startswith("(")
    except ValueError:
        raise WrongNumber(f"no score: {text}") from None


def in_scores(low: str, high: str) -> Column:
    (a, a_in), (b, b_in) = score_bound(low), score_bound(high)
    s = F.col("score")
    return (s >= a if a_in else s > a) & (s <= b if b_in else s < b)


def zset_range_by_score(rows: DataFrame, low: str, high: str, offset: int = 0, count: int = -1, reverse: bool = False) -> DataFrame:
    """Members of each key within score bounds, from offset on, at most count (negative: all)."""
    if offset < 0:
        return rows.where(F.lit(False))
    found = rows.where(in_scores(low, high))
    if offset == 0 and count < 0:
        return found
    n = F.row_number().over(Window.partitionBy("key").orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in _UP]))
    found = found.withColumn("_n", n)  # compared with literals, so that each task sends only the first rows of a key
    found = found if count < 0 else found.where(F.col("_n") <= offset + count)
    return found.where(F.col("_n") > offset).drop("_n")


def zset_count(rows: DataFrame, low: str, high: str) -> DataFrame:
    """By key, 0 where no member is within."""
    return rows.groupBy("key").agg(F.count_if(in_scores(low, high)).alias("n"))


def zset_pop(rows: DataFrame, count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows left, the lowest by score and member)."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*_UP)))
    return ranked.where(F.col("_n") > count).drop("_n"), ranked.where(F.col("_n") <= count).drop("_n")


def zset_remove_ranks(rows: DataFrame, start: int, stop: int) -> DataFrame:
    return _ranked(rows, _UP).where(~_between_ranks(start, stop)).select("key", "member", "score")


def zset_remove_scores(rows: DataFrame, low: str, high: str) -> DataFrame:
    return rows.where(~in_scores(low, high))


def zset_size(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("size"))


# ---- lengths kept as deltas ------------------------------------------------------------------------


def fold_deltas(base: DataFrame, deltas: DataFrame, least: int = 1) -> DataFrame:
    """key, length: base (key, length) plus the sum of deltas (key, n) of keys that have `least` or more, never below 0."""
    sums = deltas.groupBy("key").agg(F.sum("n").alias("_n"), F.count("*").alias("_c")).where(F.col("_c") >= least)
    joined = base.join(sums, "key", "full_outer")
    return joined.select("key", F.greatest(F.coalesce("length", F.lit(0)) + F.coalesce("_n", F.lit(0)), F.lit(0)).alias("length"))
