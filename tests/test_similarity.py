"""Similar texts against all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import similarity
from tidemark.operators.similarity import similar_texts


def test_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.expovariate(0.08))}" for _ in range(400)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for i in range(150)}
    texts |= {200 + i: texts[i] + " extra" for i in range(20)} | {300: texts[0].upper(), 301: None, 302: "", 303: "the a of", 304: "the same", 305: "Same, the!"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")
    pairs, classes = similar_texts(df, "id", "text", 0.5, ("the", "of"))
    bags = {i: Counter(t for t in re.findall(r"\w{2,}", (t or "").lower()) if t not in ("the", "of")) for i, t in texts.items()}
    bags = {i: b for i, b in bags.items() if b}
    df_of = Counter(t for b in bags.values() for t in b)
    vectors = {}
    for i, b in bags.items():
        raw = {t: c * (math.log((1 + len(texts)) / (1 + df_of[t])) + 1) for t, c in b.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        vectors[i] = {t: x / size for t, x in raw.items()}
    head = {i: min(j for j, c in bags.items() if c == b) for i, b in bags.items()}
    assert {r["id"]: r["class_id"] for r in classes.collect()} == head
    cosine = lambda a, b: sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items())
    heads = sorted(set(head.values()))
    want = {(a, b): cosine(a, b) for a in heads for b in heads if a < b and cosine(a, b) >= 0.5}
    got = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert similar_texts(df.limit(0), "id", "text", 0.5)[0].count() == 0


def test_pairs_that_share_a_few_rare_terms_are_not_worked_out(spark):
    """Every two texts share one rare term; vectors are joined only for the pairs that may be near."""
    own = {i: [f"own{i}x{j}" for j in range(12)] for i in range(30)}
    texts = {i: " ".join(own[i] + [f"pair{min(i, j)}z{max(i, j)}" for j in range(30) if j != i]) for i in range(30)} | {100: " ".join(own[3] + own[3] + ["other"]), 101: " ".join(own[3] + own[3])}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs, _ = similar_texts(df, "id", "text", 0.7)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(100, 101)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "sofar" in plan


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Many blocks of a few texts, keys that are strings and may be null."""
    rng = random.Random(5)
    words = [f"w{int(rng.expovariate(0.2))}" for _ in range(200)]
    texts = [(f"k{i:03}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    texts += [(f"z{i}", texts[0][1]) for i in range(30)] + [("z0", "and more"), (None, texts[1][1]), ("q", None)]
    df = spark.createDataFrame(texts, "id string, text string")
    whole = [sorted(map(tuple, d.collect())) for d in similar_texts(df, "id", "text", 0.4)]
    monkeypatch.setattr(similarity, "TERMS", 50)
    cut = [sorted(map(tuple, d.collect())) for d in similar_texts(df, "id", "text", 0.4)]
    assert [r[:2] for r in cut[0]] == [r[:2] for r in whole[0]] and len(cut[0]) > 50 and cut[1] == whole[1]
    assert all(x[2] == pytest.approx(y[2]) for x, y in zip(cut[0], whole[0]))
    assert len({k for k, c in cut[1] if c == texts[0][0]}) == 30 and None not in {k for k, _ in cut[1]}


def test_near_pairs_are_not_written(spark, monkeypatch):
    """What two texts' common terms add up to stays in the task: a table holds pairs that are similar, and no others."""
    written, plain = {}, similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, label: written.setdefault(label, plain(df, label)))
    texts = [(i, f"common{i % 2} rare{i // 2} other{i}") for i in range(40)]
    pairs, _ = similar_texts(spark.createDataFrame(texts, "id long, text string"), "id", "text", 0.9)
    assert pairs.count() == written["pairs"].count() == 0
    assert not any("sofar" in df.columns for label, df in written.items() if label != "pairs")


def test_strips_lose_no_pair(monkeypatch):
    """Two blocks met in strips of a text each and a few products at once give what all pairs give; rows of keys that stand
    for no class count for nothing."""
    rng = np.random.default_rng(3)
    vectors = {(side, i): {int(t): float(rng.integers(1, 4)) for t in rng.integers(0, 30, rng.integers(1, 9))} for side in (0, 1) for i in range(25)}

    def block(side):
        rows = [(side, i, t, x) for (s, i), v in vectors.items() if s == side for t, x in v.items()] + [(side, i, None, 0.5) for i in range(25)]
        rows += [(side, i, None, None) for i in range(20)]  # the last five are copies
        rng.shuffle(rows := np.array(rows, object))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64())
        return similarity._block(pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(("block", "key", "rank", "raw"), kinds))}), 0.45)

    def unit(v):
        size = math.sqrt(sum(x * x for x in v.values()) + 0.25)
        return {t: x / size for t, x in v.items()}

    units = {k: unit(v) for k, v in vectors.items()}
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("sofar", pa.float64()), ("similarity", pa.float64())])
    for x, y in ((0, 1), (0, 0)):
        a = block(x)
        b = a if x == y else block(y)
        row = pa.RecordBatch.from_arrays([t[c].combine_chunks() for t in (a, b) for c in t.column_names], names=[f"{s}_{c}" for s, t in (("x", a), ("y", b)) for c in t.column_names])
        sums = {(i, j): sum(w * units[y, j].get(t, 0.0) for t, w in units[x, i].items()) for i in range(20) for j in range(20) if x != y or i < j}
        want = {k: s for k, s in sums.items() if s >= 0.5}
        for cells, products in ((2_000_000, 4_000_000), (7, 3), (60, 1)):
            monkeypatch.setattr(similarity, "CELLS", cells)
            monkeypatch.setattr(similarity, "PRODUCTS", products)
            got = {tuple(sorted((r["one"], r["two"]))) if x == y else (r["one"], r["two"]): r["similarity"] for out in similarity._meet(iter([row]), 0.5, 0.45, 30, schema) for r in out.to_pylist()}
            assert got.keys() == want.keys() and len(got) > 5 and all(got[k] == pytest.approx(want[k]) for k in want)
