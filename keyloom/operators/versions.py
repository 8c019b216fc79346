"""Multi-version keys: an append-only log (key, commit_ts, value, tombstone, expire_at) and reads of it.

A read at ts sees of each key the newest version with commit_ts <= ts, and then only if that version is
no tombstone and hasn't expired (expire_at 0 or null: never). An expired newest version hides older
ones, so the newest is taken first and tested after. Taking it is an aggregate by key (max_by, partial
before the shuffle), not a window, so hot keys don't gather in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["key", "commit_ts", "value", "tombstone", "expire_at"]


class ReadCompacted(ValueError):
    """A read below the retained timestamp."""


def live(ts) -> Column:
    expire = F.coalesce(F.col("expire_at"), F.lit(0))
    return ~F.coalesce(F.col("tombstone"), F.lit(False)) & ((expire == 0) | (expire > F.lit(ts)))


def newest(log: DataFrame, ts) -> DataFrame:
    """Newest version of each key at ts, tombstones and expired ones included."""
    rest = [c for c in log.columns if c != "key"]
    best = log.where(F.col("commit_ts") <= F.lit(ts)).groupBy("key").agg(F.max_by(F.struct(*rest), "commit_ts").alias("v"))
    return best.select("key", *[F.col("v")[c].alias(c) for c in rest])


def snapshot(log: DataFrame, ts, min_retained=None) -> DataFrame:
    """What a read at ts sees of every key."""
    if min_retained is not None and ts < min_retained:
        raise ReadCompacted(f"{ts} is below {min_retained}")
    return newest(log, ts).where(live(ts))


def get_at(log: DataFrame, key, ts) -> DataFrame:
    """The visible version of one key; the key filter reaches the scan."""
    return snapshot(log.where(F.col("key") == F.lit(key)), ts)


def exists_at(log: DataFrame, keys: DataFrame, ts) -> DataFrame:
    """keys (column key) with a boolean found."""
    seen = snapshot(log.join(keys.select("key").distinct(), "key", "left_semi"), ts).select("key", F.lit(True).alias("found"))
    return keys.join(seen, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def key_range(start=None, end=None, column: str = "key") -> Column:
    """start <= key < end; a missing bound is open."""
    terms = [F.col(column) >= F.lit(start)] if start is not None else []
    terms += [F.col(column) < F.lit(end)] if end is not None else []
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def scan_at(log: DataFrame, start, end, ts, limit: int | None = None, reverse: bool = False, keys_only: bool = False) -> DataFrame:
    """Visible versions in [start, end) by key; limit makes it a top-k, not a sort."""
    found = snapshot(log.where(key_range(start, end)), ts)
    found = found.select("key") if keys_only else found
    found = found.orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return found if limit is None else found.limit(limit)


def scan_physical(log: DataFrame, start, end, ts, visible_limit: int, physical_limit: int) -> DataFrame:
    """Forward scan that examines at most physical_limit keys; column truncated says if that bound was met."""
    examined = newest(log.where(key_range(start, end)), ts).orderBy("key").limit(physical_limit)
    total = examined.agg((F.count("*") >= physical_limit).alias("truncated"))
    return examined.where(live(ts)).orderBy("key").limit(visible_limit).join(F.broadcast(total))


def latest_commit(log: DataFrame) -> DataFrame:
    """key, commit_ts of the last version of each key, tombstones too."""
    return log.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))


def committed_at(log: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes (key, commit_ts) that a version has exactly."""
    return probes.join(log.select("key", "commit_ts").distinct(), ["key", "commit_ts"], "left_semi")


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with a batch; of versions of one key and timestamp the batch's wins."""
    both = log.withColumn("_n", F.lit(0)).unionByName(batch.select(*log.columns).withColumn("_n", F.lit(1)))
    rest = [c for c in log.columns if c not in ("key", "commit_ts")]
    best = both.groupBy("key", "commit_ts").agg(F.max_by(F.struct(*rest), "_n").alias("v"))
    return best.select(*[F.col("v")[c].alias(c) if c in rest else F.col(c) for c in log.columns])


def put(rows: DataFrame, commit_ts, expire_at: int = 0) -> DataFrame:
    """Versions of rows (key, value)."""
    return rows.select("key", F.lit(commit_ts).cast("long").alias("commit_ts"), "value", F.lit(False).alias("tombstone"), F.lit(expire_at).cast("long").alias("expire_at"))


def delete(keys: DataFrame, commit_ts) -> DataFrame:
    """Tombstones of keys (column key)."""
    return keys.select("key", F.lit(commit_ts).cast("long").alias("commit_ts"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), F.lit(0).cast("long").alias("expire_at"))


def expire(log: DataFrame, keys: DataFrame, commit_ts, expire_at: int) -> DataFrame:
    """New versions of the visible keys with another expiry; dead keys make none."""
    seen = snapshot(log.join(keys.select("key"), "key", "left_semi"), commit_ts)
    return seen.select("key", F.lit(commit_ts).cast("long").alias("commit_ts"), "value", F.lit(False).alias("tombstone"), F.lit(expire_at).cast("long").alias("expire_at"))


def delete_prefix(log: DataFrame, prefix: str, commit_ts, exclude: str | None = None) -> DataFrame:
    """Tombstones of the visible keys with the prefix, but those with the excluded one."""
    met = F.startswith("key", F.lit(prefix))
    met = met & ~F.startswith("key", F.lit(exclude)) if exclude else met
    return delete(snapshot(log.where(met), commit_ts).select("key"), commit_ts)


def conflicts(log: DataFrame, writes: DataFrame, reads: DataFrame, start_ts) -> DataFrame:
    """kind (write or read) and key of a batch's keys with a version after start_ts."""
    touched = writes.select("key", F.lit("write").alias("kind")).unionByName(reads.select("key", F.lit("read").alias("kind"))).distinct()
    return touched.join(log.where(F.col("commit_ts") > F.lit(start_ts)).select("key").distinct(), "key", "left_semi").select("kind", "key")


def apply_batch(log: DataFrame, batch: DataFrame, reads: DataFrame, start_ts) -> DataFrame:
    """The log with the batch, all or nothing: unchanged rows of the log alone where a key conflicts."""
    clash = conflicts(log, batch, reads, start_ts).limit(1).select(F.lit(1).alias("_clash"))
    allowed = batch.join(F.broadcast(clash), F.lit(True), "left_anti")
    return append(log, allowed)


def conflict_counts(found: DataFrame, family: Column) -> DataFrame:
    """Conflicts by kind and key family."""
    return found.groupBy("kind", family.alias("family")).agg(F.count("*").alias("n"))


def key_family(key: Column, families: dict[str, str], other: str = "other") -> Column:
    """The family of the longest of the prefixes that a key has."""
    out = F.lit(other)
    for prefix, name in sorted(families.items(), key=lambda kv: len(kv[0])):
        out = F.when(F.startswith(key, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def compact(log: DataFrame, min_ts) -> DataFrame:
    """Versions after min_ts, and of each key the newest up to it."""
    return newest(log, min_ts).select(*log.columns).unionByName(log.where(F.col("commit_ts") > F.lit(min_ts)))


def merge_shards(shards: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Rows of all shards, once a key (the first shard's), by key."""
    numbered = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    both = reduce(DataFrame.unionByName, numbered)
    rest = [c for c in shards[0].columns if c != "key"]
    best = both.groupBy("key").agg(F.min_by(F.struct(*rest), "_shard").alias("v")).select("key", *[F.col("v")[c].alias(c) for c in rest]).orderBy("key")
    return best if limit is None else best.limit(limit)


def hlc(millis: Column, logical: Column) -> Column:
    """Hybrid timestamp: 48 bits of milliseconds, 16 of a counter."""
    return F.shiftleft(millis.cast("long"), 16).bitwiseOR(logical.cast("long").bitwiseAND(F.lit(65535)))


def hlc_parts(ts: Column) -> tuple[Column, Column]:
    """Timestamp and counter of a hybrid timestamp."""
    return F.timestamp_millis(F.shiftright(ts, 16)), ts.bitwiseAND(F.lit(65535))
