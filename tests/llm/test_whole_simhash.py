import random
import re

from keyloom.llm import simhash
from tests.llm.test_operators import brute_simhash


def test_no_table_that_grows_is_sent_to_all(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(20)]
    rows = list(enumerate(texts + [x + " q" for x in texts] + texts[:5]))
    plans = {}

    def noted(df, label, *rest, own=simhash.stash):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return own(df, label)

    monkeypatch.setattr(simhash, "stash", noted)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # these tables are far below
    found = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    plans["found"] = found._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(brute_simhash(rows).elements())
    assert all("SortMergeJoin" in plans[label] for label in ("simhash-members", "simhash-rooted", "simhash-more", "found"))
    assert not [label for label, p in plans.items() if "Broadcast" in p]


def test_documents_are_not_sent_to_all(spark, monkeypatch, tmp_path):
    words = "many words that repeat take next to nothing in a file".split()
    rows = [(i, " ".join([w] * 500), w) for i, w in enumerate(words + words)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    joins = []

    def noted(df, label, own=simhash.stash):
        if label == "simhash-kept":
            joins.extend(re.findall(r"\w+Join", df._jdf.queryExecution().sparkPlan().toString()))
        return own(df, label)

    monkeypatch.setattr(simhash, "stash", noted)
    assert sorted(r.doc_id for r in simhash.keep_one_per_component(docs).collect()) == list(range(len(words)))
    assert joins[0] == "SortMergeJoin"  # the last one, of documents with the ids that stay
