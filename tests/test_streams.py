"""Streams against the batch result over the same rows, in several batches, out of order, and after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.streaming import states

DAY = dt.datetime(2024, 1, 1)


def test_decayed_states(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ABC"), DAY + dt.timedelta(hours=rng.randint(0, 900)), rng.choice([None, rng.uniform(-1, 1)]), rng.choice([0.3, 1.0])) for _ in range(120)]
    schema = "entity string, published_at timestamp, score double, weight double"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def keep(batch, _):
        seen.extend(r.asDict() for r in batch.collect())

    for part in range(3):  # each run is a restart from the checkpoint, with new files
        for k in range(2):
            spark.createDataFrame(rows[part * 40 + k * 20 : part * 40 + k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = states.decayed_states(source, "score", "weight").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
        query.trigger(availableNow=True).start().awaitTermination()
    want = {r["entity"]: r for r in states.decayed_now(spark.createDataFrame(rows, schema), "score", "weight").collect()}
    last = {}
    for r in seen:
        if last.get(r["entity"]):
            assert r["delta"] == pytest.approx(r["mean"] - last[r["entity"]]["mean"])
        last[r["entity"]] = r
    assert last.keys() == want.keys()
    for e, r in want.items():
        assert last[e]["n_events"] == r["n_events"] and last[e]["as_of"] == r["as_of"]
        assert last[e]["mean"] == pytest.approx(r["mean"]) and last[e]["weight"] == pytest.approx(r["weight"])


def test_returns_are_resolved_once(spark, tmp_path):
    days = [DAY + dt.timedelta(days=i) for i in range(80)]
    bars = spark.createDataFrame([(e, d, 100.0 + i * (1 + k)) for k, e in enumerate("AB") for i, d in enumerate(days)], "entity string, ts timestamp, close double")
    bench = spark.createDataFrame([("ALL", d, 50.0 + i % 7) for i, d in enumerate(days)], "entity string, ts timestamp, close double")
    rows = [(f"e{i}", "AB"[i % 2], days[i], 5 if i % 3 else 20) for i in range(40)] + [("z", "Q", days[0], 5)]
    due = spark.createDataFrame(rows, "event_id string, entity string, published_at timestamp, horizon_days int")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(due.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    due.where("event_id < 'e3'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    due.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for run in ("ck", "ck", "again"):  # a restart, and all of it once more
        states.resolving_returns(source, str(tmp_path / "out"), ["event_id", "horizon_days"], bars, bench, str(tmp_path / run)).trigger(availableNow=True).start().awaitTermination()
    held = {r["event_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows) == len(held)
    both = asof.abnormal_returns(due.drop("horizon_days"), bars, bench, (5, 20)).join(due.select("event_id", F.col("horizon_days").alias("h")), "event_id").where("horizon_days = h")
    for r in both.collect():
        assert held[r["event_id"]]["realized"] == (None if r["realized"] is None else pytest.approx(r["realized"])) and held[r["event_id"]]["outcome_status"] == r["outcome_status"]
