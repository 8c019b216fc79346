"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 fingerprint bits gets a non-zero vector of GF(2)^(r+1); for each non-zero v of that
space a table masks the bits whose vector has odd parity with v. Up to r differing bits span at most
r dimensions, so some v is orthogonal to all of them and its table masks all of them out: every pair
within radius r meets in a table. With r = 4 there are 31 tables of about 33 bits.

Linking runs on distinct fingerprints. First each bucket's members are held against its smallest
member, then components are formed. Only buckets that still hold more than one component are searched
exactly, in blocks of bounded size; blocks send a spanning forest of the links found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import apart, settle, stash, text_bytes, written

WIDTH, RADIUS, SHINGLE = 64, 4, 4
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks, 2^(radius+1) - 1 of them."""
    vectors = (1 << (radius + 1)) - 1
    given = [1 + i % vectors for i in range(WIDTH)]
    masks = [sum(1 << i for i, g in enumerate(given) if bin(g & v).count("1") & 1) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 bytes; zero without a word."""
    words = text.translate(_LOWER).split()  # bytes.split cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        data, at = data.tobytes(), offsets.tolist()
        values = np.array([fingerprint(data[a:b]) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; one row per row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, roots: np.ndarray, roots_right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join different components, as few as join them all."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    found = []
    bits_left, bits_right = left.view(np.uint64), right.view(np.uint64)  # bitwise_count of a signed number counts its absolute value
    for i in range(len(left)):
        near = np.flatnonzero((np.bitwise_count(bits_right ^ bits_left[i]) <= radius) & (roots_right != roots[i]))
        if near.size:
            _, first = np.unique(roots_right[near], return_index=True)
            for j in near[first]:
                x, y = find(int(roots[i])), find(int(roots_right[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((int(left[i]), int(right[j])))
    return found


def _compare(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    a = pdf[pdf["side"] == 0] if (pdf["c1"] != pdf["c2"]).any() else pdf
    b = pdf[pdf["side"] == 1] if a is not pdf else pdf
    found = _forest(a["fp"].to_numpy(np.int64), b["fp"].to_numpy(np.int64), a["root"].to_numpy(np.int64), b["root"].to_numpy(np.int64), radius)
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, root) for fingerprints that reach a smaller one over links of at most `radius` bits.

    distinct: column fp (long), no repeats. Exact: all and only the components of the link graph.
    """
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = stash(apart(keyed).join(shared, ["t", "key"]), "simhash-members")
    star = members.where(F.col("fp") != F.col("rep")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))) <= radius)
    edges = stash(star.select(F.col("rep").alias("a"), F.col("fp").alias("b")).distinct(), "simhash-star")
    roots = connected_components(edges, "simhash")
    rooted = apart(members).join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("t", "key", "n", "fp", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "simhash-rooted")
    mixed = rooted.groupBy("t", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t", "key")
    # A bucket of n is cut into k parts by hash; each pair of parts (and each part with itself) is a group.
    cut = apart(rooted).join(mixed, ["t", "key"]).withColumn("k", F.ceil(F.col("n") / block).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = cut.select("t", "key", "fp", "root", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    pairs = pairs.select("t", "key", "fp", "root", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), (F.col("c") > F.col("o")).cast("int").alias("side"))
    # few bytes but much work: an explicit number of partitions is not coalesced
    pairs = pairs.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "key", "c1", "c2")
    more = pairs.groupBy("t", "key", "c1", "c2").applyInPandas(lambda pdf: _compare(pdf, radius), "a long, b long")
    edges = edges.unionByName(stash(more, "simhash-more"))
    roots = connected_components(edges, "simhash")
    return roots.select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    One row per row of docs, in any order; other columns of docs are ignored. Null text is empty text;
    texts without a word have fingerprint zero and link like any other. A null doc_id keeps its row
    and never becomes a component_id, unless nothing else is in the component (then null). Rows that
    repeat a doc_id are kept. An empty table gives an empty result.
    """
    marked = stash(fingerprints(docs), "simhash-fp")
    by_fp = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = settle(link_fingerprints(by_fp.select("fp"), radius), "simhash-roots", written())
    rooted = apart(by_fp).join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = apart(rooted).join(least, "root").select("fp", "component_id")
    return apart(marked).join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without the documents that link to a kept one: of each component the row of the smallest
    doc_id stays. Of rows that repeat that doc_id one stays: of the smallest text, then the smallest
    other columns. A null doc_id stays only where a component has no other."""
    found = simhash_components(docs.select("doc_id", "text"), radius)
    keep = found.groupBy("component_id").agg(F.min("doc_id").alias("keep_id")).select("keep_id").distinct()
    repeated = found.groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"))
    keep = keep.join(repeated, F.col("keep_id").eqNullSafe(F.col("doc_id"))).select("keep_id", "repeated")
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = stash(apart(rows).join(keep, F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "row", "repeated"), "simhash-kept")
    rest = [F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("row")["text"].alias("t"), *[c.alias(f"c{i}") for i, c in enumerate(rest)])
    best = kept.where("repeated").groupBy("id").agg(F.min_by("row", order).alias("row")).select("row")
    return kept.where("NOT repeated").select("row").unionByName(best).select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Whole documents table: doc_id, fingerprint, component_id."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
