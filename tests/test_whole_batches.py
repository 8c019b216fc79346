from pyspark.sql import functions as F

from keyloom.operators import batches
from keyloom.plans import registry


def test_command_batch_runs_over_all_keys(spark, sf):
    keys = registry.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    got = registry.QUERIES["command_batch"](spark, sf)
    assert got.count() == 5 * keys.count() > 1000 / 2
    assert keys.join(got, "key", "left_anti").count() == 0


def folded(state, commands):
    """The same by plain Python: (key, pos, result, value)."""
    values, results = dict(state), []
    for key, pos, name, argument in sorted(commands, key=lambda c: (c[0] or "", c[1])):
        values[key], result = batches._strings(values.get(key), name, argument)
        results.append((key, pos, result))
    return sorted(((k, p, r, values[k]) for k, p, r in results), key=str)


def test_a_batch_passes_tasks_as_a_stream_of_rows(spark, sf):
    plan = registry.QUERIES["command_batch"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_command_batch_has_every_result(spark, sf):
    value = {str(r.c_custkey): str(r.c_nationkey + 1) for r in registry.table(spark, sf, "customer").collect()}
    want = [(k, p, r, None) for k, v in value.items() for p, r in enumerate([v, v, "OK", "ERR not an integer", "1"])]
    got = [(r.key, r.pos, r.result, r.value) for r in registry.QUERIES["command_batch"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_batches_of_any_keys_are_folded_in_order(spark):
    state = [("a", "5"), ("b", None), ("c", ""), ("idle", "9"), (None, "1"), ("odd", " 1_0 "), ("big", "9" * 30)]
    names = [("INCR", None), ("GET", None), ("exists", None), ("NO", "x"), ("GETDEL", None), ("DEL", None), ("SET", "7"), ("INCR", None), ("SET", None), ("EXISTS", None)]
    keys = ["a", "b", "c", "new", None, "odd", "big"]
    commands = [(k, (i * 7 + n) % 10 - 3, *names[(i * 7 + n) % 10]) for n, k in enumerate(keys) for i in range(10)]
    commands += [("last", 2, "SET", "end"), ("last", 1, "INCR", None)]
    left = spark.createDataFrame(state, "key string, value string")
    right = spark.createDataFrame(commands, "key string, pos long, name string, argument string").repartition(3)
    got = batches.run_batch(left, right).collect()
    assert sorted((tuple(r) for r in got), key=str) == folded(state, commands)
    assert batches.run_batch(left.limit(0), right.limit(0)).count() == batches.run_batch(left, right.limit(0)).count() == 0


def test_a_key_of_more_commands_than_a_block(spark):
    n = 3 * batches.BLOCK_ROWS + 5
    hot = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("pos"), F.lit("INCR").alias("name"), F.lit(None).cast("string").alias("argument"))
    got = batches.run_batch(spark.createDataFrame([("hot", "10")], "key string, value string"), hot.orderBy(F.desc("pos")))
    right = (F.col("result") == (F.col("pos") + 11).cast("string")) & (F.col("value") == str(n + 10))
    assert got.agg(F.count("*"), F.count_distinct("pos"), F.count_if(right)).first()[:] == (n, n, n)


def test_waiting_results_are_given_in_order():
    waiting = batches._Waiting()
    many = [(i, None if i % 3 else str(i)) for i in range(2 * batches.BLOCK_ROWS + 3)] + [(-1, "x" * batches.BLOCK_CHARS), (-2, "y")]
    for pos, result in many:
        waiting.add(pos, result)
    assert len(waiting.block) == 1 and waiting.written == 3 and list(waiting) == many
    assert waiting.file.closed
