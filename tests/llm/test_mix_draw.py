"""The blocks that a shard's quota takes are a draw: of the right number, in no runs and no lattice."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mix import block_draw, last_drawn


@pytest.mark.parametrize(("n", "rest"), [(107, 20), (781, 200), (7918, 4000), (2, 1), (37, 37)])
def test_drawn_blocks(spark, n, rest):
    chosen = {}
    for seed in (17, 18):
        df = spark.range(n).select("id", F.lit("web").alias("source"), F.lit(3).cast("long").alias("shard"), F.lit(n).cast("long").alias("n"), F.lit(rest).cast("long").alias("rest"))
        last = last_drawn(F.col("source"), F.col("shard"), F.col("n"), F.col("rest"), seed)
        taken = [r["t"] for r in df.select("id", (block_draw(F.col("source"), F.col("shard"), F.col("id"), seed) <= last).alias("t")).orderBy("id").collect()]
        assert sum(taken) == rest
        chosen[seed] = taken
        if 20 <= rest < n:
            runs = 1 + sum(a != b for a, b in zip(taken, taken[1:]))
            mean = 1 + 2 * rest * (n - rest) / n
            sd = math.sqrt((mean - 1) * (mean - 2) / (n - 1))
            assert abs(runs - mean) < 3.5 * sd
            gaps = {b - a for a, b in zip(*(lambda at: (at, at[1:]))([i for i, t in enumerate(taken) if t]))}
            assert len(gaps) > 4  # a lattice has two or three
    if 20 <= rest < n:
        assert chosen[17] != chosen[18]
