"""Licence notices against a plain search for the best chain of runs, with words put in, left out and changed anywhere."""

import random
import re

from tidemark.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses

WORD = re.compile("[a-z0-9]+")


def words(text):
    return WORD.findall(text.lower())


def chain(file, template, run):
    """The most words of the template in runs of at least `run` that follow each other in the file."""
    n = len(file)
    best = [[0] * (n + 1) for _ in range(len(template) + 1)]
    for p in range(1, len(template) + 1):
        for q in range(1, n + 1):
            best[p][q] = max(best[p - 1][q], best[p][q - 1])
            k = 0
            while k < min(p, q) and template[p - 1 - k] == file[q - 1 - k]:
                k += 1
                if k >= run:
                    best[p][q] = max(best[p][q], best[p - k][q - k] + k)
    return best[-1][-1]


def expected(text):
    w = words(text)
    joined = f" {' '.join(w)} "
    labels = {label for p, label in BASE_PHRASES.items() if f" {p} " in joined}
    score = 1.0 if labels else 0.0
    for t in TEMPLATES:
        if all(f" {' '.join(words(k))} " in joined for k in t.key_phrases):
            of = words(t.text)
            share = chain(w, of, 3 if len(of) >= 12 else 2) / len(of)
            if share >= 0.8 - 1e-9:
                labels.add(t.label)
                score = max(score, share)
    return ",".join(sorted(labels)), round(score, 9)


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in scan_licenses(df).collect()}


def test_random_edits_of_all_templates(spark):
    rng = random.Random(6)
    texts = []
    for t in TEMPLATES:
        for edits in (0, 1, 2, 4, 8, 12):
            w = t.text.split()
            for _ in range(edits):
                i = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.4:
                    w.insert(i, " ".join(["filler"] * rng.choice([1, 3, 20])))
                elif kind < 0.7 and len(w) > 2:
                    del w[i]
                else:
                    w[i] = rng.choice(["changed", w[rng.randrange(len(w))]])
            texts.append("some words before " + " ".join(w) + " and after")
    got = scanned(spark, texts)
    wrong = [(i, got[i], expected(t)) for i, t in enumerate(texts) if got[i] != expected(t)]
    assert not wrong
    assert len({x for label, _ in got.values() for x in label.split(",")}) > 20


def test_words_put_in_anywhere(spark):
    mit = TEMPLATES[0].text.split()
    keys = [i for i in range(len(mit)) if words(" ".join(mit[i - 3 : i + 3])) != words(" ".join([*mit[i - 3 : i], "x", *mit[i : i + 3]]))]
    texts, places = [], []
    for n in (3, 5, 20):
        for i in range(len(mit) + 1):
            texts.append(" ".join([*mit[:i], *["other"] * n, *mit[i:]]))
            places.append(i)
    got = scanned(spark, texts)
    inside = {j for k in TEMPLATES[0].key_phrases for i in range(len(mit)) if words(" ".join(mit[i : i + len(k.split())])) == words(k) for j in range(i + 1, i + len(k.split()))}
    assert keys and all((got[i][0] == "mit") == (place not in inside) for i, place in enumerate(places))
    long = " ".join(["the rights to use a copy of this software and the terms of it"] * 3000)
    near = " ".join(mit[: len(mit) // 2])
    odd = scanned(spark, [f"{long} {' '.join(mit)} {long}", f"{near} {long}", long, None, "", " ".join(mit[:20] + long.split() + mit[20:])])
    assert [odd[i][0] for i in range(6)] == ["mit", "", "", "", "", "mit"]
