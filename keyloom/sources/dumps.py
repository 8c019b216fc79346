"""Dump trees and version logs: reading and writing with fixed schemas, and round-trip checks.

A dump is a folder of JSON lines by structure (strings, lists, hashes, sets, zsets, streams, items,
messages, objects) with a manifest of row counts and digests. Everything is read and written through
Spark, so any store that it reaches will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "strings": "key string, value string, expire_at_ms long",
    "lists": "key string, seq long, value string",
    "hashes": "key string, field string, value string",
    "sets": "key string, member string",
    "zsets": "key string, member string, score double",
    "streams": "key string, ms decimal(20,0), seq decimal(20,0), fields array<string>",
    "items": "table string, item string",
    "messages": "queue string, id string, body string, sent_ms long, visible_ms long, receive_count long, group_id string, dedup_id string",
    "objects": "bucket string, key string, size long, etag string, modified long",
}
LOG = "key string, commit_ts long, value string, tombstone boolean, expire_at long"


def digest(df: DataFrame) -> DataFrame:
    """rows and a sum of row hashes, the same in any order and partitioning."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_dump(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables by name under path and returns the manifest (name, rows, digest), which is written too."""
    manifest = None
    for name, df in sorted(tables.items()):
        spark = df.sparkSession
        shaped = spark.createDataFrame([], SCHEMAS[name]).unionByName(df)
        shaped.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/{name}")
        line = digest(read_table(spark, path, name)).select(F.lit(name).alias("name"), "rows", "digest")
        manifest = line if manifest is None else manifest.unionByName(line)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/MANIFEST")
    return manifest


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).json(f"{path}/{name}")


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the manifest lists."""
    names = [r["name"] for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/MANIFEST").select("name").collect()]
    return {n: read_table(spark, path, n) for n in names}


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows whose table has other rows now."""
    manifest = spark.read.schema("name string, rows long, digest string").json(f"{path}/MANIFEST")
    now = None
    for name, df in read_dump(spark, path).items():
        line = digest(df).select(F.lit(name).alias("name"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
        now = line if now is None else now.unionByName(line)
    return manifest.join(now, "name").where((F.col("rows") != F.col("_rows")) | (F.col("digest") != F.col("_digest"))).select("name", "rows", "digest")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_log(log: DataFrame, path: str, partitions: int | None = None) -> None:
    """A version log as Parquet, range-partitioned and sorted by key so that key ranges prune row groups."""
    ordered = log.repartitionByRange(partitions, "key") if partitions else log.repartitionByRange("key")
    ordered.sortWithinPartitions("key", "commit_ts").write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def read_as_of(spark: SparkSession, path: str, ts: int | None = None) -> DataFrame:
    """A stored log's rows as a reader sees them: at ts, or the latest."""
    from ..operators.versions import snapshot

    return snapshot(read_log(spark, path), (1 << 63) - 1 if ts is None else ts)
