"""Resamples: draws are Poisson with mean 1, the same in every run, and made without a row per row and replicate."""

import math

import numpy as np

from pyspark.sql import functions as F

from tidemark.operators import strategy


def test_draws_are_poisson():
    times = strategy._draws(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500), 1000)
    for k in range(5):
        want = math.exp(-1) / math.factorial(k)
        assert abs((times == k).mean() - want) < 5 * math.sqrt(want / times.size)
    # Neither rows nor replicates go together.
    assert abs(np.corrcoef(times[0], times[1])[0, 1]) < 0.2 and abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.25


def test_sums_are_those_of_the_draws(spark, monkeypatch):
    """Groups over several batches and tasks, a null key among them, null values left out, more groups than are held."""
    data = [(None if i % 7 == 0 else f"g{i % 7}", i, None if i % 11 == 0 else float(i)) for i in range(700)]
    rows = spark.createDataFrame(data, "g string, id long, x double")
    number = {r.id: r.n for r in rows.select("id", F.xxhash64(F.lit(7), "g", "id").alias("n")).collect()}
    got = {(r.g, r.replicate): r["mean"] for r in strategy.bootstrap_means(rows.repartition(3), ["g"], "x", ["id"], 20, 7).collect()}
    for g in {g for g, _, _ in data}:
        ids, values = zip(*[(i, x) for h, i, x in data if h == g and x is not None])
        times = strategy._draws(np.array([number[i] for i in ids]), 20).astype(float)
        for k in range(20):
            assert math.isclose(got[g, k], (np.array(values) @ times[:, k]) / times[:, k].sum(), rel_tol=1e-12)
    assert len(got) == 7 * 20
    again = strategy.bootstrap_means(rows.repartition(5), ["g"], "x", ["id"], 20, 7)
    assert "Generate explode(" not in again._jdf.queryExecution().toString()
    assert all(math.isclose(r["mean"], got[r.g, r.replicate], rel_tol=1e-12) for r in again.collect())


def test_groups_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(strategy, "_GROUPS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 1, 2, 3]), pa.array([1.0] * 6), pa.array(range(6))], ["k", "v", "r"])
    parts = list(strategy._resampled([batch, batch], 10, 1))
    assert all(p.num_rows <= 2 for p in parts) and sum(np.sum(p.column(2).to_pylist()) for p in parts) == 2 * strategy._draws(np.arange(6), 10).sum()
