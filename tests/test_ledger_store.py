"""Append-only tables: batches run twice, second outcomes, null keys, repeats."""

import tempfile
import time

from pyspark.sql import functions as F

from tidemark.shared import write
from tidemark.sources import ledger_store as store

PREDICTIONS = "event_id string, horizon_days int, predicted_impact double"
OUTCOMES = "event_id string, horizon_days int, realized double, observed_at long"
NATURAL = ["event_id", "horizon_days"]


def rows_of(spark, path, df):
    table = store.read(spark, path, store.keyed(df, NATURAL).schema)
    return sorted((tuple(r)[:-2] for r in table.collect()), key=str)


def test_batches_are_appended_once(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/predictions"
    one = spark.createDataFrame([("a", 1, 0.1), ("b", 1, None), (None, 5, 0.2), ("a", 1, 0.1)], PREDICTIONS)
    two = spark.createDataFrame([("a", 1, 0.9), ("c", 1, 0.3), ("c", 1, 0.2)], PREDICTIONS)
    assert store.append(one, path, NATURAL, "b1").count() == 0
    refused = store.append(two, path, NATURAL, "b2").collect()
    assert sorted(tuple(r) for r in refused) == [("a", 1, 0.9), ("c", 1, 0.3)]
    first = rows_of(spark, path, one)
    assert first == sorted([("a", 1, 0.1), ("b", 1, None), (None, 5, 0.2), ("c", 1, 0.2)], key=str)
    for df, batch in ((two, "b2"), (one, "b1"), (two, "b2")):  # again, in any order
        store.append(df, path, NATURAL, batch).count()
        assert rows_of(spark, path, one) == first
    assert store.append(one.limit(0), path, NATURAL, "b3").count() == 0 and rows_of(spark, path, one) == first


def test_outcomes_are_facts(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    predictions = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.1)], PREDICTIONS)
    outcomes = spark.createDataFrame([("a", 1, 0.5, 20), ("a", 1, 0.4, 10), ("x", 1, 0.1, 5)], OUTCOMES)
    refused = {tuple(r) for r in store.record_outcomes(outcomes, predictions, f"{base}/outcomes", NATURAL, "o1").collect()}
    assert refused == {("a", 1, 0.5, 20, "SECOND_OUTCOME"), ("x", 1, 0.1, 5, "NO_PREDICTION")}
    again = spark.createDataFrame([("a", 1, 0.7, 1), ("b", 1, 0.2, 30)], OUTCOMES)
    assert {tuple(r) for r in store.record_outcomes(again, predictions, f"{base}/outcomes", NATURAL, "o2").collect()} == {("a", 1, 0.7, 1, "SECOND_OUTCOME")}
    held = store.read(spark, f"{base}/outcomes", store.keyed(outcomes, NATURAL).schema)
    got = {r["event_id"]: (r["realized"], r["outcome_locked"]) for r in store.ledger(predictions, held.drop(store.KEY), NATURAL, ["realized"]).collect()}
    assert got == {"a": (0.4, True), "b": (0.2, True)}
    none = store.ledger(predictions, held.drop(store.KEY).where(F.lit(False)), NATURAL, ["realized"])
    assert {r["outcome_locked"] for r in none.collect()} == {False}


def test_no_table_is_broadcast(spark):
    """Keys are many and their files small, which Spark takes for a table to send through the driver."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    predictions = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.1)], PREDICTIONS)
    outcomes = spark.createDataFrame([("a", 1, 0.5, 20), ("x", 1, 0.1, 5)], OUTCOMES)
    refused = store.record_outcomes(outcomes, predictions, f"{base}/outcomes", NATURAL, "o1")
    known = store.ledger(predictions, outcomes, NATURAL, ["realized"])
    for df in (refused, known):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shuffle_files_of_a_written_table_go(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {b.toString() for b in [blocks.getAllBlocks().apply(i) for i in range(blocks.getAllBlocks().size())] if "shuffle" in b.toString()}
    earlier = held()
    write(spark.range(1000).repartition(4, "id"), f"{folder}/rows")
    until = time.time() + 20  # files are deleted a little later
    while held() - earlier and time.time() < until:
        time.sleep(0.2)
    assert not held() - earlier and spark.conf.get(key, None) == before and spark.read.parquet(f"{folder}/rows").count() == 1000
