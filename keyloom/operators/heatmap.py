"""Key-range activity: windows, pivots, budgets, merges over nodes, heavy hitters, split decisions.

facts: route_id, at (window end), sub_bucket, reads, writes, and for merges node, group_id, term.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("reads", "writes", "read_bytes", "write_bytes")


def observe(events: DataFrame, route: Column, ts: Column, reads: Column, writes: Column, step: str = "60 seconds") -> DataFrame:
    """Tumbling windows of activity by route: route_id, at, reads, writes."""
    rows = events.select(route.alias("route_id"), ts.alias("ts"), reads.alias("r"), writes.alias("w"))
    return rows.groupBy("route_id", F.window("ts", step).alias("win")).agg(F.sum("r").alias("reads"), F.sum("w").alias("writes")).select("route_id", F.col("win.end").alias("at"), "reads", "writes")


def history(facts: DataFrame, start=None, end=None) -> DataFrame:
    """Columns with start <= at < end; a missing bound is open."""
    out = facts if start is None else facts.where(F.col("at") >= F.lit(start))
    return out if end is None else out.where(F.col("at") < F.lit(end))


def fold_cold(facts: DataFrame, most: int) -> DataFrame:
    """Routes beyond the `most` of the smallest ids fold into route -1."""
    ids = facts.select("route_id").distinct().orderBy("route_id").limit(most).withColumn("_own", F.lit(True))
    marked = facts.join(ids, "route_id", "left").withColumn("route_id", F.when(F.col("_own"), F.col("route_id")).otherwise(F.lit(-1)))
    return marked.groupBy("route_id", "at").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))


def matrix(facts: DataFrame, series: str, columns: list) -> DataFrame:
    """A row per route, a column per given window, 0 where nothing happened."""
    if series not in SERIES:
        raise ValueError(f"no series {series}")
    return facts.groupBy("route_id").pivot("at", columns).agg(F.sum(series)).na.fill(0)


def busiest(facts: DataFrame, n: int, measure: Column) -> DataFrame:
    """route_id and total of the n routes with most activity, ties to the smaller id; a top-k."""
    return facts.groupBy("route_id").agg(F.sum(measure).alias("total")).orderBy(F.col("total").desc(), "route_id").limit(n)


def merge_reads(facts: DataFrame) -> DataFrame:
    """Reads add up over nodes."""
    return facts.groupBy("route_id", "at").agg(F.sum("reads").alias("reads"))


def merge_writes(facts: DataFrame) -> DataFrame:
    """Writes of a group and term are the nodes' maximum, summed over terms; with any unknown (0) group or term the plain maximum.

    conflict: nodes of one group and term disagree."""
    terms = facts.groupBy("route_id", "at", "group_id", "term").agg(F.max("writes").alias("w"), (F.min("writes") != F.max("writes")).alias("c"), F.bool_or((F.col("group_id") == 0) | (F.col("term") == 0)).alias("u"))
    cells = terms.groupBy("route_id", "at").agg(F.sum("w").alias("total"), F.max("w").alias("top"), F.bool_or("c").alias("conflict"), F.bool_or("u").alias("unknown"))
    return cells.select("route_id", "at", F.when(F.col("unknown"), F.col("top")).otherwise(F.col("total")).alias("writes"), "conflict")


def hot_keys(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Exact counts of the k most frequent keys, ties to the smaller key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def hot_keys_sketch(rows: DataFrame, key: str, k: int, counters: int = 1000) -> DataFrame:
    """The k most frequent keys by a mergeable frequent-items sketch: bounded memory, counts may be too high by rows / counters."""
    return rows.agg(F.expr(f"approx_top_k(`{key}`, {k}, {counters})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias(key), F.col("t.count").alias("n"))


def space_saving(rows: DataFrame, key: str, counters: int) -> DataFrame:
    """key, n, error of a frequent-items summary of `counters` counters a task, merged by key.

    A task that holds more counters lowers all by the largest it can't keep. n is the count and all
    that was lowered, in any task, so n is no less than the true count and n - error no more; a key that
    has more than rows / counters is always there."""

    def local(batches):
        held, lowered = pd.Series(dtype="int64"), 0
        for pdf in batches:
            held = held.add(pdf[key].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters:
                cut = int(held.nlargest(counters + 1).iloc[-1])
                held, lowered = held[held > cut] - cut, lowered + cut
        yield pd.DataFrame({key: pd.Series([*held.index, None], dtype=object), "n": [*held.tolist(), 0], "lowered": lowered})

    kind = dict(rows.dtypes)[key]
    parts = rows.select(key).mapInPandas(local, f"{key} {kind}, n long, lowered long")
    # the row without a key stands for its task
    total = parts.where(F.col(key).isNull()).agg(F.coalesce(F.sum("lowered"), F.lit(0)).alias("error"))
    merged = parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n"))
    return merged.join(F.broadcast(total)).select(key, (F.col("n") + F.col("error")).alias("n"), "error").orderBy(F.col("n").desc(), key).limit(counters)


def sampled_counts(rows: DataFrame, key: str, rate: int, k: int, most_length: int = 1024) -> DataFrame:
    """Hot keys of a 1 in `rate` sample (by hash of the row number within the task), counts scaled up."""
    kept = rows.where(F.octet_length(F.col(key).cast("string")) <= most_length).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rate)) == 0)
    return kept.groupBy(key).agg((F.count("*") * rate).alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def merge_hot_keys(nodes: DataFrame, key: str, k: int) -> DataFrame:
    """Sum of the nodes' counts (key, n, bound, rate), the largest rate, top k."""
    return nodes.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bound").alias("bound"), F.max("rate").alias("rate")).orderBy(F.col("n").desc(), key).limit(k)


def split_score(facts: DataFrame, seconds: int, write_weight: int = 4, read_weight: int = 1) -> DataFrame:
    """score by route: operations a minute, weighted."""
    per_minute = lambda c: F.sum(c) * 60.0 / seconds
    return facts.groupBy("route_id").agg((per_minute("writes") * write_weight + per_minute("reads") * read_weight).alias("score"))


def split_key(buckets: DataFrame, routes: DataFrame) -> DataFrame:
    """Weighted median: route_id, split_key, origin from sub-buckets (route_id, sub_bucket, start, end, load) and routes (route_id, start, end).

    The first bucket where the running load reaches half gives its end; where that is no key inside the route, its start.
    Routes without load, or without a key strictly inside, are left out. Null ends are open."""
    own = Window.partitionBy("route_id")
    run = buckets.withColumn("upto", F.sum("load").over(own.orderBy("sub_bucket", "start").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("load").over(own))
    met = run.where((F.col("upto") * 2 >= F.col("total")) & (F.col("total") > 0))
    pick = met.groupBy("route_id").agg(F.min_by(F.struct("sub_bucket", "start", "end"), F.struct("sub_bucket", "start")).alias("b"))
    met = pick.join(routes.select("route_id", F.col("start").alias("lo"), F.col("end").alias("hi")), "route_id")
    beyond = F.col("b.end").isNull() | F.coalesce(F.col("b.end") >= F.col("hi"), F.lit(False))
    first = (F.col("b.sub_bucket") == 0) & (F.col("b.start") == F.col("lo"))
    key = F.when(beyond, F.col("b.start")).otherwise(F.col("b.end"))
    origin = F.when(beyond, "p50_last_bucket_lo").when(first, "p50_first_bucket_hi").otherwise("p50_mid")
    out = met.select("route_id", key.alias("split_key"), origin.alias("origin"), "lo", "hi")
    return out.where((F.col("split_key") > F.col("lo")) & (F.col("hi").isNull() | (F.col("split_key") < F.col("hi")))).drop("lo", "hi")


def consecutive_hot(windows: DataFrame, threshold: float, least: int) -> DataFrame:
    """route_id, at, streak: windows at which a route has been at the threshold `least` windows in a row or more (windows: route_id, at, score)."""
    order = Window.partitionBy("route_id").orderBy("at")
    hot = F.col("score") >= threshold
    marked = windows.withColumn("hot", hot).withColumn("island", F.sum((~hot).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy("route_id", "island", "hot").orderBy("at"))
    return marked.withColumn("streak", streak).where(F.col("hot") & (F.col("streak") >= least)).select("route_id", "at", "streak")


def decide(candidates: DataFrame, budget: int, least: int = 3) -> DataFrame:
    """candidates (route_id, score, streak, split_key) with the reason they are split or not: by score, then id, within the budget.

    The candidates of a cycle are routes, a catalog of bounded size."""
    able = (F.col("streak") >= least) & F.col("split_key").isNotNull()
    rank = F.row_number().over(Window.partitionBy(able).orderBy(F.col("score").desc(), "route_id"))
    reason = F.when(F.col("streak") < least, "not_hot_long_enough").when(F.col("split_key").isNull(), "no_split_key").when(F.col("_rank") > budget, "over_budget").otherwise("split")
    return candidates.withColumn("_rank", rank).select("route_id", "score", reason.alias("reason"))
