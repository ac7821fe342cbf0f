"""The forest against comparing all vectors: exact where all are candidates, recall elsewhere; odd vectors, copies, ties."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.prefix_forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(v).tolist())), None)
    out = set()
    for i, v in good:
        if i % 20 == 0:
            met = {}
            for j, w in good:
                if j != i and len(w) == len(v):
                    score = 0.0
                    for a, b in zip(v, w):
                        score += a * b
                    met.setdefault((-score, j), None)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(met)[:k])}
    return out


def test_all_candidates_are_compared_exactly(spark):
    rng = np.random.default_rng(4)
    vector = lambda n=12: rng.normal(size=n).round(1).tolist()
    rows = [(i, vector(), 0) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, *[0.0] * 10], 0) for i in range(150)]  # copies, of which seven ask
    rows += [(2000 + i, [float(i % 3), float(i % 2), 1.0], 0) for i in range(60)]  # ties, and another length
    rows += [(3000, None, 0), (3020, [], 0), (3040, [0.0] * 12, 0), (3060, [float("nan")] * 12, 0), (3080, [None, *[1.0] * 11], 0), (3100, [float("inf"), *[1.0] * 11], 0), (None, vector(), 0), (3120, [1.0] * 7, 0)]
    rows += [rows[5], rows[20], (20, vector(), 0), (40, rows[40][1], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("ids", "gid", "rank", "shard", "v", "id"):
        df = df.withColumn(c, F.lit("x"))
    want = brute(rows)
    for shard in (2048, 16):  # one shard a tree; many, of which those of the copies' neighbourhood are split
        got = [tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, shard=shard).collect()]
        # Id 20 has two vectors: two queries of one id.
        assert {g for g in got if g[0] != 20} == {w for w in want if w[0] != 20}
    assert not [w for w in want if w[0] in (3000, 3020, 3040, 3060, 3080, 3100, 3120)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_over_shards(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32))
    x[:2000] = x[0] + 0.01 * rng.normal(size=(2000, 32))  # a third in one place
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, shard=200, least=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(np.float32).astype(float)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    asked = range(0, 6000, 20)
    recall = np.mean([len(got[i] & set(np.argsort(-score[i])[:20].tolist())) / 20 for i in asked])
    assert recall >= 0.93
