"""Append logs (key, ms, seq, fields): ranges, cursors, trimming, and ids.

An id is ms-seq, two unsigned 64-bit numbers, kept as DECIMAL(20, 0) and compared as a pair.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = (1 << 64) - 1
READ_LIMIT = 100_000


class BadId(ValueError):
    """A text that is no stream id, or an id that doesn't follow the last."""


def parse_id(text: str, upper: bool = False) -> tuple[int, int, bool]:
    """(ms, seq, included). - and + are the ends; ms alone has seq 0, or the largest as an upper bound; ( excludes."""
    body = text[1:] if text.startswith("(") else text
    if body in ("-", "+"):
        return ((0, 0) if body == "-" else (MOST, MOST)) + (not text.startswith("("),)
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", body)
    if not m or int(m[1]) > MOST or int(m[2] or 0) > MOST:
        raise BadId(text)
    return int(m[1]), int(m[2]) if m[2] else (MOST if upper else 0), not text.startswith("(")


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def id_after(ms: int, seq: int, included: bool) -> Column:
    a, b = F.col("ms").cast("decimal(20,0)"), F.col("seq").cast("decimal(20,0)")
    return (a > _number(ms)) | ((a == _number(ms)) & (b >= _number(seq) if included else b > _number(seq)))


def id_before(ms: int, seq: int, included: bool) -> Column:
    a, b = F.col("ms").cast("decimal(20,0)"), F.col("seq").cast("decimal(20,0)")
    return (a < _number(ms)) | ((a == _number(ms)) & (b <= _number(seq) if included else b < _number(seq)))


def log_range(rows: DataFrame, start: str = "-", stop: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries of each key within bounds; of each key at most count, from the start or, reversed, from the stop."""
    found = rows.where(id_after(*parse_id(start)) & id_before(*parse_id(stop, upper=True)))
    if count is None:
        return found
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("ms", "seq")]
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_n") <= min(count, READ_LIMIT)).drop("_n")


def log_read(rows: DataFrame, cursors: DataFrame, count: int | None = None) -> DataFrame:
    """Entries strictly after each key's cursor (key, after_ms, after_seq; null: its last entry), at most count a key."""
    ends = rows.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_end"))
    at = cursors.join(ends, "key", "left").select("key", F.coalesce("after_ms", F.col("_end.ms")).alias("_ms"), F.coalesce("after_seq", F.col("_end.seq")).alias("_seq"))
    found = rows.join(at, "key").where((F.col("ms") > F.col("_ms")) | ((F.col("ms") == F.col("_ms")) & (F.col("seq") > F.col("_seq")))).drop("_ms", "_seq")
    if count is None:
        return found
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq"))).where(F.col("_n") <= count).drop("_n")


def log_trim(rows: DataFrame, most: int) -> DataFrame:
    """The newest `most` entries of each key."""
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.col("ms").desc(), F.col("seq").desc()))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def log_length(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("length"))


def log_add(rows: DataFrame, new: DataFrame, now_ms: int, most: int | None = None) -> DataFrame:
    """rows with new entries (key, pos, fields), ids given: now_ms, or the last ms if that is later, seq counting on."""
    last = rows.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_end"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    late = F.col("_end.ms") >= F.lit(now_ms)
    ms = F.when(late, F.col("_end.ms")).otherwise(F.lit(now_ms))
    seq = F.when(late, F.col("_end.seq") + F.col("_n")).otherwise(F.col("_n") - 1)
    kinds = dict(rows.dtypes)
    put = new.withColumn("_n", n).join(last, "key", "left").select("key", ms.cast(kinds["ms"]).alias("ms"), seq.cast(kinds["seq"]).alias("seq"), "fields")
    out = rows.unionByName(put)
    return out if most is None else log_trim(out, most)


def log_add_given(rows: DataFrame, new: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with new entries, rejected entries) for entries (key, pos, ms, seq, fields) that bring their ids.

    An entry is taken if its id is not 0-0 and follows its key's last one and those of the entries before it
    (by pos); one that is rejected changes nothing for the next."""
    kinds = dict(rows.dtypes)
    last = rows.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_end"))
    new = new.withColumns({c: F.col(c).cast(kinds[c]) for c in ("ms", "seq")})
    earlier = F.max(F.struct("ms", "seq")).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    judged = new.withColumn("_earlier", earlier).join(last, "key", "left")
    own = F.struct("ms", "seq")
    follows = lambda c: F.coalesce(own > F.col(c), F.lit(True))
    judged = judged.withColumn("_ok", ~((F.col("ms") == 0) & (F.col("seq") == 0)) & follows("_end") & follows("_earlier"))
    out = rows.unionByName(judged.where("_ok").select("key", "ms", "seq", "fields"))
    return (out if most is None else log_trim(out, most)), judged.where("NOT _ok").select("key", "pos", "ms", "seq", "fields")


def check_next(last: tuple[int, int], wanted: tuple[int, int]) -> tuple[int, int]:
    """An id given by hand must follow the last one and not be 0-0."""
    if wanted == (0, 0) or wanted <= last:
        raise BadId(f"{wanted} doesn't follow {last}")
    return wanted


def id_order(text: Column) -> Column:
    """Sort key of id texts: texts that are no ids first, by themselves, then ids by number."""
    parts = F.split(text, "-")
    valid = text.rlike(r"^\d+(-\d+)?$")
    number = lambda i: F.when(valid, F.coalesce(F.get(parts, i), F.lit("0")).cast("decimal(20,0)"))
    return F.struct(valid.alias("valid"), number(0).alias("ms"), number(1).alias("seq"), F.when(~valid, text).alias("text"))
