import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import decontaminate, linededup, pieces, quality
from tests.llm.test_operators import brute_quality, brute_simhash


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert [len(r) for r in rows] == [f.count() for f in frames]
    for i, r in rows[0].items():  # base rules
        b = brute_quality(r.text)
        assert i not in rows[1] or not (b[0] < 10 or 100 * b[4] > 20 * b[0])
    assert set(rows[2]) == set(rows[1])
    lines = [x.strip().lower() for r in rows[2].values() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in rows[2].values())
    assert set(rows[3]) == {c for _, _, c in brute_simhash([(i, r.text) for i, r in rows[2].items()])}
    assert set(rows[4]) <= set(rows[3]) and not any(b in r.text for b in bench.values() for r in rows[4].values())
    assert set(rows[5]) == set(rows[4]) and all(r.round_trip for r in rows[5].values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, frames[5].collect()))


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, "one text of ten words and a few more to be kept here", "en", None, 1), (2, "one text of ten words and a few more to be kept here", "en", None, 1)]
    spark.createDataFrame([(1, "an item that nothing holds at all, of some length")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, data in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert [r.doc_id for r in docs.collect()] == ([2] if data else [])


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    names = "row id rid root key lines line d th pos h a b x y part size salt kept base_failed upto n_words n_lines n_removed gone body _d _th _leak repeated keep_id fp limits lang2".split()
    long = "\n".join(f"line {i} of a very long text with number {i * i % 9973} and {i * 7919 % 10007}" for i in range(40_000))
    rows = [(1, long, "en", "a", len(long)), (2, "one text of ten words and a few more to be kept here", "en", "a", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in names})
    columns = docs.columns
    spark.createDataFrame([(1, "an item that nothing holds at all, of some length")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"wide{k}"))
        docs = spark.read.parquet(str(tmp_path / f"wide{k}"))
        if k < 4:
            assert docs.columns == columns
            assert all(r[c] == f"own {c}" for r in docs.select(names).collect() for c in names)
    assert {r.doc_id for r in docs.collect()} <= {1, 2} and docs.where("doc_id = 2 AND round_trip").count() == 1
