"""Importance resampling against plain counting of all runs of words, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.importance import followed, importance_resample, word_crcs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def buckets(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def expected(docs, target, percent=5):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in buckets(text)[0]:
                counts[b] += 1
    all_s, all_t = sum(s) + 10000, sum(t) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    rows = []
    for doc_id, text, *_ in docs:
        found, n = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_crcs_are_put_together():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 3, 63, 64, 65, 200, 5, 1)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    crcs = word_crcs(data, ends - [len(w) for w in words], ends)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    after = followed(crcs[:-1], crcs[1:], np.array([len(w) for w in words[1:]]))
    assert after.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_importance_resample(spark):
    rng = random.Random(2)
    vocabulary = ["the", "The", "ÄRGER", "naïve", "日本", "x" * 70, "42", "don't", "a-b", "end.", "Z", "q9", *(f"w{i}" for i in range(40))]
    line = lambda: rng.choice([" ", "  ", "\t", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))
    shared = [line() for _ in range(5)] + ["one", "", "--", "two three"]
    docs = [(i, rng.choice(["\n", "\n\n", "\r\n", "\n-\n"]).join(rng.choice([line(), rng.choice(shared)]) for _ in range(rng.randint(0, 9))), "en", "s", 1) for i in range(400)]
    docs += [(900, None, "en", "s", 1), (901, "", None, None, None), (902, "word " * 30000, "en", "s", 1), (903, "\n".join(["same line here"] * 4000), "en", "s", 1), (None, "a b c " * 20, "en", "s", 1)]
    docs += [docs[7], docs[7], (905, docs[7][1], "en", "s", 1), (7, docs[9][1], "en", "s", 1)]
    target = [line() for _ in range(30)] + [None, "", "the the\nthe"]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("line", "h", "dk", "n", "weight", "n_words", "buckets", "place", "copies"):
        df = df.withColumn(c, F.lit("x"))
    aim = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = sorted((tuple(r) for r in importance_resample(df, aim).collect()), key=str)
    want = expected(docs, target)
    # Rows alike in id and score may take each other's rank.
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted((r for r in got if r[4]), key=lambda r: r[4]) == sorted((r for r in want if r[4]), key=lambda r: r[4])
    assert len([r for r in got if r[4]]) > 10
    assert importance_resample(df.limit(0), aim).count() == 0
    none = importance_resample(df.where("doc_id < 40"), aim.limit(0), percent=100)
    assert {r["n_features"] for r in none.collect()} == {len(buckets(d[1])[0]) for d in docs if d[0] is not None and d[0] < 40}
