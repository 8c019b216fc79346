"""Key-range routes [start, end) (null end: no upper bound): lookup, overlap, splits, versions, sub-ranges.

Lookup is an as-of match: the order of keys is cut at route starts (a bounded number of them), keys find
their block by binary search, and an equality join on the block brings the few routes that reach it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Routes that may be broadcast, and places where the order of keys is cut.
SMALL = 10_000


def covers(key: Column, start: str = "start", end: str = "end") -> Column:
    return (key >= F.col(start)) & (F.col(end).isNull() | (key < F.col(end)))


def lookup(keys: DataFrame, routes: DataFrame, key: str = "key") -> DataFrame:
    """keys with their route's columns; keys that no route covers are left out.

    Up to SMALL starts each begin a block, of more every so many-th; at most 2 * SMALL rows are broadcast."""
    starts = routes.select("start").distinct()
    n = starts.count()
    if n > SMALL:  # a catalog is bounded, so one ordered window serves
        nth = F.row_number().over(Window.orderBy("start"))
        starts = starts.withColumn("_n", nth).where(F.col("_n") % -(-n // SMALL) == 1).select("start")
    bounds = np.array(sorted(r[0] for r in starts.collect()), dtype=object)

    @F.pandas_udf("int")
    def block(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.full(len(values), -1, np.int32)
        out[known] = np.searchsorted(bounds, values.to_numpy(object)[known], "right")
        return pd.Series(out)

    last = F.coalesce(block("end"), F.lit(-1))
    spread = routes.withColumn("_b", F.explode(F.sequence(block("start"), F.when(F.col("end").isNull(), len(bounds)).otherwise(F.greatest(last, block("start"))))))
    spread = F.broadcast(spread) if spread.limit(2 * SMALL + 1).count() <= 2 * SMALL else spread  # overlapping routes reach many blocks
    return keys.withColumn("_b", block(key)).join(spread, "_b").where(covers(F.col(key))).drop("_b")


def overlapping(routes: DataFrame, start, end=None) -> DataFrame:
    """Routes that share a key with [start, end)."""
    met = F.col("end").isNull() | (F.col("end") > F.lit(start))
    return routes.where(met if end is None else met & (F.col("start") < F.lit(end)))


def route_key(key: Column, rules: list[tuple[str, str]]) -> Column:
    """The key that decides a record's route: of rules (prefix, delimiter) the first that applies gives what follows the prefix up to the delimiter."""
    out = key
    for prefix, delimiter in reversed(rules):
        rest = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
        out = F.when(F.startswith(key, F.lit(prefix)), F.substring_index(rest, delimiter, 1) if delimiter else rest).otherwise(out)
    return out


def split(routes: DataFrame, route_id: int, at: str, version: int) -> DataFrame:
    """routes (id, start, end, version) with one cut in two at a key strictly inside, if its version is the given one."""
    hit = (F.col("id") == route_id) & (F.col("version") == version) & (F.col("start") < at) & (F.col("end").isNull() | (F.col("end") > at))
    top = routes.agg(F.max("id").alias("_top"))
    marked = routes.withColumn("_hit", F.coalesce(hit, F.lit(False))).join(F.broadcast(top))
    half = F.explode(F.when(F.col("_hit"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    cut = marked.withColumn("_half", half)
    return cut.select(
        F.when(F.col("_half") > 0, F.col("_top") + F.col("_half")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("_half") == 2, F.lit(at)).otherwise(F.col("start")).alias("start"),
        F.when(F.col("_half") == 1, F.lit(at)).otherwise(F.col("end")).alias("end"),
        (F.col("version") + (F.col("_half") > 0).cast("int")).alias("version"),
    )


def faults(routes: DataFrame) -> DataFrame:
    """Routes out of order or overlapping the next. Routes are a catalog: their number is bounded, so one ordered window serves."""
    after = F.lead("start").over(Window.orderBy("start"))
    return routes.withColumn("next_start", after).where((F.col("end").isNotNull() & (F.col("start") >= F.col("end"))) | (F.col("next_start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("next_start")))))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and what happened between two versions of a catalog: added, removed, changed."""
    same = F.col("a.start").eqNullSafe(F.col("b.start")) & F.col("a.end").eqNullSafe(F.col("b.end"))
    kind = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "removed").when(~same, "changed")
    return old.alias("a").join(new.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), kind.alias("kind")).where("kind IS NOT NULL")


def route_load(facts: DataFrame) -> DataFrame:
    return facts.groupBy("route_id").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))


def sub_bucket(key: Column, low: Column, high: Column, buckets: int) -> Column:
    """Equal-width part of [low, high) that a number is in, clamped to the ends; decimals hold the products exactly."""
    wide = lambda c: c.cast("decimal(38,0)")
    part = F.floor((wide(key) - wide(low)) * F.lit(buckets) / (wide(high) - wide(low))).cast("int")
    return F.when(key < low, F.lit(0)).when(key >= high, F.lit(buckets - 1)).otherwise(F.least(part, F.lit(buckets - 1)))


def key_number(key: Column, skip: int = 0) -> Column:
    """The 8 bytes of a key after a common prefix, as a number."""
    padded = F.rpad(F.substring(F.hex(F.encode(key, "UTF-8")), 2 * skip + 1, 16), 16, "0")
    return F.conv(padded, 16, 10).cast("decimal(20,0)")
