"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch of a measure is a table of counts by value rounded down to its 6 leading bits (an error of
at most 1/32 of the value). Sketches merge by adding counts, so the sketch of a language is the sum
over its sources and that of the corpus the sum over languages; the order of merging changes nothing.
Each (language, source) gets its own fences from its quartiles, q75 + REACH * (q75 - q25) + a spread,
joined back to the documents. Groups of fewer than LEAST_GROUP documents use their language's sketch,
or else the corpus's. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

BITS, REACH, LEAST_GROUP = 6, 3, 50
#: Groups (counted first, about 100 bytes each) whose limits are broadcast; beyond that tasks a group's rows are dealt to.
BROADCAST_GROUPS, SALTS = 50_000, 32
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Measure: least width of the upper fence, and of the lower one (None: no lower fence). Per mille; length in tenths.
SPREAD = {"symbol": (100, None), "line": (300, None), "repeat": (150, None), "upper": (200, None), "length": (20, 20)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a lambda inside refers to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of bytes other than \\x20 and \\x09-\\x0D; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _windows(words: Column) -> Column:
    """A hash of each run of WINDOW words."""

    def shift(a: Column) -> Column:
        # slice() needs a positive length, so short texts are sorted out by the caller
        return F.transform(F.slice(a, F.lit(1), F.size(a) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[a[i + k] for k in range(1, WINDOW)]))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shift)


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: their positions by sorting, then the union of [i, i + WINDOW)."""

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: ((k > 0) & (F.try_element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"])) | F.coalesce(F.try_element_at(s, k + 2)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def union(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(pairs, places), union)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (a struct of the columns in carry), lang, source, the base counts and the measures, one row per row of docs."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    df = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), have("lang").alias("lang"), have("source").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("words", words_of(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("windows", F.when(F.size("words") >= WINDOW, _windows(F.col("words"))).otherwise(F.array().cast("array<bigint>")))
    without = lambda p: (F.length("t") - F.length(F.regexp_replace("t", p, ""))).cast("long")
    df = df.select(
        "row", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]+").alias("n_upper"),
    )
    per = lambda a, b, k=1000: F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1))).cast("long")
    return df.select(
        "row", "lang", "source", *BASE,
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("symbol"), per("n_dup_lines", "n_lines").alias("line"), per("n_repeat_words", "n_words").alias("repeat"),
        per("n_upper", "word_chars").alias("upper"), per("word_chars", "n_words", 10).alias("length"),
    )


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over rows that don't fail the base rules."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in SPREAD])
    long = rows.where("NOT base_failed").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    drop = F.greatest(F.length(F.bin("v")) - BITS, F.lit(0))
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), drop), drop)
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, total, lo, hi from a sketch; counts of equal buckets are merged first."""
    from pyspark.sql import Window

    merged = counts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by, "measure")
    run = merged.select(*by, "measure", "bucket", F.sum("n").over(own.orderBy("bucket")).alias("upto"), F.sum("n").over(own).alias("total"))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    q = run.groupBy(*by, "measure").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
    pick = lambda side: F.coalesce(*[F.when(F.col("measure") == m, F.lit(s[side]).cast("long")) for m, s in SPREAD.items()])
    width = REACH * (F.col("q3") - F.col("q1"))
    return q.select(*by, "measure", "total", (F.col("q3") + width + pick(0)).alias("hi"), (F.col("q1") - width - pick(1)).alias("lo"))


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per (lang, source) with hi_<measure> and lo_<measure>."""
    own = fences(counts, ["lang", "source"])
    lang = fences(counts, ["lang"]).select("lang", "measure", F.col("total").alias("total2"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    every = fences(counts, []).select("measure", F.col("hi").alias("hi3"), F.col("lo").alias("lo3"))
    level = lambda c: F.when(F.col("total") >= LEAST_GROUP, F.col(c)).when(F.col("total2") >= LEAST_GROUP, F.col(f"{c}2")).otherwise(F.col(f"{c}3"))
    both = own.join(lang, ["lang", "measure"]).join(every, "measure").select("lang", "source", "measure", level("hi").alias("hi"), level("lo").alias("lo"))
    pick = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    return both.groupBy("lang", "source").agg(*[pick(c, m) for m in SPREAD for c in ("hi", "lo")])


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row, the base counts, base_failed, kept for each row of docs.

    Null text has no words and fails; null lang or source count as the empty string; repeated rows
    count as often as they occur; an empty table gives an empty result.
    """
    rows = stash(measured(docs, carry), "quality-measures")
    limits = stash(thresholds(stash(sketch(rows), "quality-sketch")), "quality-limits")
    met = F.lit(True)
    for m, (_, low) in SPREAD.items():
        met = met & F.coalesce(F.col(m) <= F.col(f"hi_{m}"), F.lit(True))
        if low is not None:
            met = met & F.coalesce(F.col(m) >= F.col(f"lo_{m}"), F.lit(True))
    if limits.count() <= BROADCAST_GROUPS:
        both = rows.join(F.broadcast(limits), ["lang", "source"], "left")
    else:  # a group's rows are dealt to SALTS tasks, each with a copy of its limits
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["lang", "source", "salt"], "left")
    return both.select("row", *BASE, "base_failed", (~F.col("base_failed") & met).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs, ["doc_id"]).select("row.doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return judged(docs, docs.columns).where("kept").select("row.*")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Whole documents table."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_MEASURES = "(VALUES " + ", ".join(f"('{m}', {a}, {'NULL' if b is None else b})" for m, (a, b) in SPREAD.items()) + ") AS s(measure, up, down)"
#: A part of the query, over a view `docs` with the columns of documents: view `judged` with doc_id, rid, the counts and kept.
JUDGED_SQL = f"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM docs),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
e AS (SELECT rid, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS win FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g WHERE win IS NOT NULL),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM h, range(0, 5) AS r(k) WHERE n > 1 GROUP BY rid),
b AS (SELECT rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN c USING (rid)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
             1000 * n_symbols // greatest(n_words, 1) AS symbol, 1000 * n_dup_lines // greatest(n_lines, 1) AS line, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat,
             1000 * n_upper // greatest(word_chars, 1) AS upper, 10 * word_chars // greatest(n_words, 1) AS length FROM b),
l AS (UNPIVOT (SELECT rid, lang, source, base_failed, CAST(symbol AS BIGINT) AS symbol, CAST(line AS BIGINT) AS line, CAST(repeat AS BIGINT) AS repeat, CAST(upper AS BIGINT) AS upper, CAST(length AS BIGINT) AS length FROM m)
      ON symbol, line, repeat, upper, length INTO NAME measure VALUE v),
k AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0) AS bucket, count(*) AS n FROM l WHERE NOT base_failed GROUP BY ALL),
sets AS (SELECT 1 AS lv, lang, source, measure, bucket, n FROM k UNION ALL SELECT 2, lang, '', measure, bucket, n FROM k UNION ALL SELECT 3, '', '', measure, bucket, n FROM k),
mg AS (SELECT lv, lang, source, measure, bucket, sum(n) AS n FROM sets GROUP BY ALL),
rn AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, measure) AS total FROM mg),
q AS (SELECT lv, lang, source, measure, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM rn GROUP BY ALL),
f AS (SELECT lv, lang, source, measure, total, q3 + {REACH} * (q3 - q1) + up AS hi, q1 - {REACH} * (q3 - q1) - down AS lo FROM q JOIN {_MEASURES} USING (measure)),
th AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {LEAST_GROUP} THEN a.hi WHEN b.total >= {LEAST_GROUP} THEN b.hi ELSE c.hi END AS hi,
              CASE WHEN a.total >= {LEAST_GROUP} THEN a.lo WHEN b.total >= {LEAST_GROUP} THEN b.lo ELSE c.lo END AS lo
       FROM f a JOIN f b ON b.lv = 2 AND b.lang = a.lang AND b.measure = a.measure JOIN f c ON c.lv = 3 AND c.measure = a.measure WHERE a.lv = 1),
bad AS (SELECT DISTINCT rid FROM l JOIN th USING (lang, source, measure) WHERE v > hi OR v < lo),
judged AS (SELECT m.*, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM m)
"""
OP4_SQL = f"WITH docs AS (SELECT * FROM documents), {JUDGED_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
