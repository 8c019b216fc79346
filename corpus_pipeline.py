"""A corpus pipeline of five stages over the documents table.

Quality rules, line dedup, SimHash near-duplicates, benchmark decontamination, SentencePiece encoding.
Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next one's docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, linededup, pieces, quality, shared, simhash
from keyloom.session import ship


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: work(ship(spark), docs, sf_dir)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("own"))
    out = linededup.dedup_lines(rows)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


STAGES = [
    ("quality_rules", _stage(lambda spark, docs, sf_dir: quality.keep_good(docs))),
    ("line_dedup", _stage(_lines)),
    ("simhash_near_dedup", _stage(lambda spark, docs, sf_dir: simhash.keep_one_per_component(docs))),
    ("benchmark_decontamination", _stage(lambda spark, docs, sf_dir: decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))),
    ("sentencepiece", _stage(lambda spark, docs, sf_dir: pieces.encode_decode(docs))),
]

#: Union-find over fingerprints, walks and merges by rank are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    A stage's own tables, and its input, are deleted as soon as its result is written. Texts, languages and
    sources may be null, rows may repeat, documents may have more columns; what each stage does with them
    its operator states. An empty table gives an empty result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.written()
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = shared.settle(out, f"pipeline-{name}", before)
    return STAGES[-1][1](spark, docs, sf_dir)
