"""Object stores and file trees: listings, ranges, part digests, integrity, usage, orphans.

objects: bucket, key, size, etag, modified; chunks: bucket, key, part, chunk, data; inodes: id, kind,
links; entries: parent, name, inode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


class BadRange(ValueError):
    """A byte range that can't be read or met."""


def list_objects(objects: DataFrame, prefix: str = "", delimiter: str = "", after: str = "", most: int = 1000) -> DataFrame:
    """name, is_prefix, n: keys with the prefix, those with the delimiter further on folded to common prefixes; by name.

    Keys and common prefixes both count towards `most`."""
    found = objects.where(F.startswith("key", F.lit(prefix)))
    found = found.where(F.col("key") > after) if after else found
    if not delimiter:
        return found.select(F.col("key").alias("name"), F.lit(False).alias("is_prefix"), F.lit(1).cast("long").alias("n")).orderBy("name").limit(most)
    cut = F.locate(delimiter, F.col("key"), len(prefix) + 1)
    name = F.when(cut > 0, F.substring("key", F.lit(1), cut + len(delimiter) - 1)).otherwise(F.col("key"))
    folded = found.groupBy(name.alias("name"), (cut > 0).alias("is_prefix")).agg(F.count("*").alias("n"))
    folded = folded.where(F.col("name") > after) if after else folded
    return folded.orderBy("name").limit(most)


def list_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy("bucket")


def parse_range(text: str, size: int) -> tuple[int, int]:
    """First and last byte of bytes=a-b, a- or -n."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", text)
    if not m or not (m[1] or m[2]):
        raise BadRange(text)
    if not m[1]:
        first, last = max(0, size - int(m[2])), size - 1
        if int(m[2]) == 0:
            raise BadRange(text)
    else:
        first, last = int(m[1]), min(int(m[2]), size - 1) if m[2] else size - 1
    if first > last or first >= size:
        raise BadRange(text)
    return first, last


def get_object(chunks: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """bucket, key, data: whole objects or a byte range; chunks outside the range are left out before they are gathered."""
    own = Window.partitionBy("bucket", "key").orderBy("part", "chunk")
    at = chunks.withColumn("_len", F.octet_length("data")).withColumn("_from", F.sum("_len").over(own) - F.col("_len"))
    if first is not None:
        at = at.where((F.col("_from") <= last) & (F.col("_from") + F.col("_len") > first))
        begin = F.greatest(F.lit(first) - F.col("_from"), F.lit(0))
        length = F.least(F.lit(last) - F.col("_from") + 1, F.col("_len")) - begin
        at = at.withColumn("data", F.substring("data", begin + 1, length))
    parts = at.groupBy("bucket", "key").agg(F.array_sort(F.collect_list(F.struct("part", "chunk", "data"))).alias("p"))
    return parts.select("bucket", "key", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"])).alias("data"))


def put_objects(objects: DataFrame, new: DataFrame, if_none_match: bool = False, if_match: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, results: bucket, key, ok) of a conditional put."""
    old = objects.select("bucket", "key", F.col("etag").alias("_old"), F.lit(True).alias("_in"))
    judged = new.join(old, ["bucket", "key"], "left")
    ok = F.lit(True)
    if if_none_match:
        ok = F.col("_in").isNull()
    if if_match is not None:
        ok = ok & F.coalesce(F.col("_old") == if_match, F.lit(False))
    judged = judged.withColumn("ok", ok)
    put = judged.where("ok").select(*objects.columns)
    return objects.join(put.select("bucket", "key"), ["bucket", "key"], "left_anti").unionByName(put), judged.select("bucket", "key", "ok")


def multipart_etag(parts: DataFrame) -> DataFrame:
    """bucket, key, etag of parts (bucket, key, part, etag in hex): MD5 of the parts' digests in order, and their number."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "etag")))
    digest = F.md5(F.unhex(F.array_join(F.transform(ordered, lambda p: p["etag"]), "")))
    return parts.groupBy("bucket", "key").agg(F.concat(digest, F.lit("-"), F.count("*").cast("string")).alias("etag"))


def damaged_chunks(references: DataFrame, blobs: DataFrame) -> DataFrame:
    """References (sha) without a blob, or whose blob has another digest."""
    good = blobs.where(F.sha2("data", 256) == F.col("sha")).select("sha").distinct()
    return references.join(good, "sha", "left_anti")


def resolve_paths(entries: DataFrame, root: int = 0) -> DataFrame:
    """path, inode of everything below root: a join per level, until a level is empty. An entry that leads back to an
    inode on its own path is listed and not followed."""
    level = entries.where(F.col("parent") == root).select(F.concat(F.lit("/"), "name").alias("path"), "inode", F.array(F.lit(root).cast("long")).alias("way"))
    out = None
    while not (level := cut_lineage(level)).isEmpty():
        out = level if out is None else out.unionByName(level)
        open_ends = level.where(~F.array_contains("way", F.col("inode").cast("long"))).select("path", F.col("inode").alias("parent"), F.array_append("way", F.col("inode").cast("long")).alias("way"))
        level = open_ends.join(entries, "parent").select(F.concat("path", F.lit("/"), "name").alias("path"), "inode", "way")
    return (level if out is None else out).select("path", "inode")


def read_directory(entries: DataFrame, parent: int) -> DataFrame:
    return entries.where(F.col("parent") == parent).orderBy("name")


def move_entry(entries: DataFrame, parent: int, name: str, new_parent: int, new_name: str) -> DataFrame:
    """Rename; an entry of the new name is replaced."""
    here = (F.col("parent") == parent) & (F.col("name") == name)
    there = (F.col("parent") == new_parent) & (F.col("name") == new_name)
    return entries.where(here | ~there).withColumn("_m", here).select(F.when(F.col("_m"), F.lit(new_parent)).otherwise(F.col("parent")).cast("long").alias("parent"), F.when(F.col("_m"), F.lit(new_name)).otherwise(F.col("name")).alias("name"), "inode")


def usage(files: DataFrame, data: Column) -> DataFrame:
    """Number of files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(data).cast("long")), F.lit(0)).alias("bytes"))


def orphans(inodes: DataFrame, entries: DataFrame, leases: DataFrame, now_ms: int) -> DataFrame:
    """Inodes that no entry and no living lease (inode, expire_ms) holds."""
    held = entries.select("inode").unionByName(leases.where(F.col("expire_ms") > now_ms).select("inode")).distinct()
    return inodes.join(held, inodes["id"] == held["inode"], "left_anti")


# ---- buckets, deletes, uploads ---------------------------------------------------------------------


def create_bucket(buckets: DataFrame, name: str, now_ms: int, acl: str = "private") -> DataFrame:
    """buckets (bucket, generation, created_ms, acl) with a new one; an existing name stays as it is."""
    spark = buckets.sparkSession
    new = spark.createDataFrame([(name, 1, now_ms, acl)], "bucket string, generation long, created_ms long, acl string")
    return buckets.unionByName(new.join(buckets.select("bucket"), "bucket", "left_anti"))


def delete_bucket(buckets: DataFrame, objects_: DataFrame, name: str) -> DataFrame:
    """buckets without an empty one; a bucket that holds objects stays."""
    held = objects_.where(F.col("bucket") == name).select("bucket").distinct()
    gone = buckets.where(F.col("bucket") == name).join(held, "bucket", "left_anti").select("bucket")
    return buckets.join(gone, "bucket", "left_anti")


def set_acl(buckets: DataFrame, name: str, acl: str) -> DataFrame:
    return buckets.withColumn("acl", F.when(F.col("bucket") == name, F.lit(acl)).otherwise(F.col("acl")))


def head_objects(objects_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (bucket, key) with size, etag and modified, null where there is none."""
    return asked.join(objects_, ["bucket", "key"], "left")


def delete_objects(objects_: DataFrame, asked: DataFrame) -> DataFrame:
    return objects_.join(asked.select("bucket", "key"), ["bucket", "key"], "left_anti")


def list_parts(parts: DataFrame, upload: str, after: int = 0, most: int = 1000) -> DataFrame:
    """Parts (upload, part, etag, size) of an upload by number; of a part sent twice the last counts (column sent_ms)."""
    last = parts.where(F.col("upload") == upload).groupBy("upload", "part").agg(F.max_by(F.struct("etag", "size"), "sent_ms").alias("p"))
    return last.where(F.col("part") > after).select("part", "p.etag", "p.size").orderBy("part").limit(most)


def complete_upload(objects_: DataFrame, parts: DataFrame, wanted: DataFrame, bucket: str, key: str, upload: str, now_ms: int) -> DataFrame:
    """objects with the upload's object, if each wanted part (part, etag) is there; else unchanged."""
    there = list_parts(parts, upload, 0, 10_000)
    met = wanted.join(there, ["part", "etag"])
    whole = wanted.agg(F.count("*").alias("_w")).join(F.broadcast(met.agg(F.count("*").alias("_m"), F.sum("size").alias("size")))).where("_w = _m AND _w > 0")
    etag = multipart_etag(met.select(F.lit(bucket).alias("bucket"), F.lit(key).alias("key"), "part", "etag"))
    new = etag.join(F.broadcast(whole.select("size"))).select("bucket", "key", "size", "etag", F.lit(now_ms).cast("long").alias("modified"))
    return delete_objects(objects_, new).unionByName(new.select(*objects_.columns))


def abort_upload(parts: DataFrame, upload: str) -> DataFrame:
    return parts.where(F.col("upload") != upload)


# ---- file contents ---------------------------------------------------------------------------------


def make_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with new ones (parent, name, inode); names that are taken stay."""
    return entries.unionByName(new.join(entries, ["parent", "name"], "left_anti").select("parent", "name", "inode"))


def unlink(entries: DataFrame, parent: int, name: str) -> DataFrame:
    """A directory that holds entries stays."""
    here = (F.col("parent") == parent) & (F.col("name") == name)
    full = entries.select(F.col("parent").alias("inode")).distinct()
    gone = entries.where(here).join(full, "inode", "left_anti").select("parent", "name")
    return entries.join(gone, ["parent", "name"], "left_anti")


def read_file(chunks: DataFrame, inode: int) -> DataFrame:
    """inode, data of chunks (inode, chunk, data)."""
    parts = chunks.where(F.col("inode") == inode).groupBy("inode").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("p"))
    return parts.select("inode", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"])).alias("data"))


def write_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with new ones (inode, chunk, data) in place of those of the same number."""
    return chunks.join(new.select("inode", "chunk"), ["inode", "chunk"], "left_anti").unionByName(new.select(*chunks.columns))


def truncate(chunks: DataFrame, inode: int, size: int, chunk_bytes: int) -> DataFrame:
    """The file cut to a size; chunks are of chunk_bytes."""
    keep = F.lit(size) - F.col("chunk") * chunk_bytes
    return chunks.where((F.col("inode") != inode) | (keep > 0)).withColumn("data", F.when((F.col("inode") == inode) & (keep < F.octet_length("data")), F.substring("data", F.lit(1), keep.cast("int"))).otherwise(F.col("data")))
