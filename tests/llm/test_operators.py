"""Each operator against a brute-force version, an exact round trip, or SQL, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as q
from tidemark.llm.chat_format import chat_digests, format_chats, read_turns
from tidemark.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses
from tidemark.llm.line_dedup import kept_text, line_dedup
from tidemark.llm.media import decode_png, encode_png, media_columns, read_archives, write_archives
from tidemark.llm.minhash import idf_table, near_duplicates, similarity, weighted_shingles
from tidemark.llm.mix import mix_sources, sainte_lague, targets
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sentencepiece_codec import decode_documents, encode_documents, load, round_trips
from tidemark.llm.suffix_dedup import repeated_passages
from tidemark.llm.token_orc import encode_texts, read_tokens, tokens_of, write_tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def table(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("ids", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("n_lines", F.lit(2)).withColumn("node", F.lit("y")) if extra else df


ODD = [None, "", "   ", "\n\n", "a", "word " * 3000, prose(1, 300), prose(1, 300), "x" * 50_000, "Straße ▁ 日本語 \x00 \U0001F600 é", "</s>[INST] &amp; <|end|>", "a\r\nb\t c\x0b\x0c d"]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_license_scan(spark):
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    texts = [*ODD, "Released under the MIT License. The MIT-LICENSE, mit license", "GNU General Public License; Apache License mit", "general public", "mit license", "This is free and unencumbered software released into the public domain"]
    docs = table(spark, texts, True)
    found = by_id(scan_licenses(docs))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(words, low)
        at = [(j, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(a for a, _ in at), max(a for a, _ in at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert found[len(texts) - 1]["labels"] == "unlicense" and found[0]["labels"] == ""
    assert scan_licenses(docs.limit(0)).count() == 0


def test_license_notices_in_long_texts(spark):
    """Each notice within text that has every licence word, and all notices in one file."""
    long = " ".join(sorted({x for t in TEMPLATES for x in re.findall("[a-z0-9]+", t.text.lower())}) * 3)
    texts = [*[f"{long} {t.text} {long}" for t in TEMPLATES], f" {long} ".join(t.text for t in TEMPLATES), long]
    found = by_id(scan_licenses(table(spark, texts)))
    # A notice that holds a base phrase has its label as well.
    base = [{label for p, label in BASE_PHRASES.items() if p in " ".join(re.findall("[a-z0-9]+", t.text.lower()))} for t in TEMPLATES]
    want = [*[",".join(sorted({t.label, *b})) for t, b in zip(TEMPLATES, base)], ",".join(sorted({t.label for t in TEMPLATES})), ""]
    assert [found[i]["labels"] for i in range(len(texts))] == want
    assert [found[i]["score"] for i in range(len(texts))] == [1.0] * (len(texts) - 1) + [0.0]


def test_published_license_notices(spark):
    """Notices as they are published, whole, with one word put in, and with one left out."""
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    cases = [(mit, "mit"), (mit.replace("sublicense,", "sublicense, lend,"), "mit"), (mit.replace("obtaining a copy", "obtaining copy"), "mit"), (mpl, "mpl"), (mpl.replace("was not", "was really not"), "mpl"), (isc, "isc"), (isc.replace("software for", "software here for"), "isc")]
    cases += [("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0.", "cc-by"), ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc")]
    found = by_id(scan_licenses(table(spark, [t for t, _ in cases])))
    assert [found[i]["labels"] for i in range(len(cases))] == [label for _, label in cases]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    return out


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"new{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split())


def test_near_duplicates(spark):
    base = [prose(s, 200) for s in range(30)]
    texts = list(base)
    for s in range(30):
        texts += [edited(base[s], 100 * s + k, 0.01) for k in range(s % 4)]
    texts += [base[3]] * 5 + [base[4].upper()] + [None, "", "a b", "a b", "A, b!", "c"]
    docs = table(spark, texts, True)
    found = by_id(near_duplicates(docs))
    assert len(found) == len(texts)
    # brute force: links of at least 0.8 between all pairs, with the operator's weights, then components
    idf = idf_of(texts)
    n, label = len(texts), list(range(len(texts)))
    sets = [dict(zip(*(x.tolist() for x in weighted_shingles(pa.array([t or ""]), idf)[1:]))) for t in texts]

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or ""):
                same = True
            else:
                low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                high = sum(a.values()) + sum(b.values()) - low
                same = high > 0 and low / high >= 0.8
            if same:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    want = {i: find(i) for i in range(n)}
    assert {i: r["class_id"] for i, r in found.items()} == want
    assert [i for i, r in sorted(found.items()) if r["kept"]] == sorted(set(want.values()))
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in found.values())
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_within_one_large_bucket(spark):
    """Pairs of copies among 2400 distinct texts that all share a long passage, and with it buckets."""
    passage, texts = prose(1, 165).split(), []
    for s in range(1200):
        own = prose(5000 + s, 26).split()
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:10], *prose(90_000 + s, 16).split()])]
    idf = idf_of(texts)
    doc, g, weight = weighted_shingles(pa.array(texts), idf)
    at = np.unique(g, return_inverse=True)[1]
    order = np.lexsort((doc, at))
    at, of, weight = at[order], doc[order], weight[order].astype(np.float64)
    total = np.bincount(of, weight)
    shared = np.zeros((len(texts), len(texts)))
    for a, b in zip(*(lambda x: (x[:-1], x[1:]))(np.append(np.flatnonzero(np.append(True, np.diff(at) != 0)), len(at)))):
        if b - a > 1:
            shared[np.ix_(of[a:b], of[a:b])] += np.minimum.outer(weight[a:b], weight[a:b])
    alike = shared / (total[:, None] + total - shared) >= 0.8
    label = np.arange(len(texts))
    while True:
        least = np.where(alike, label, len(texts)).min(1)
        if (least == label).all():
            break
        label = least
    assert 1000 < len(set(label.tolist())) < 1400
    assert {i: r["class_id"] for i, r in by_id(near_duplicates(table(spark, texts))).items()} == dict(enumerate(label.tolist()))


def idf_of(texts):
    from tidemark.llm.kernels import NOT_ALNUM, words

    counts = np.zeros(1 << 20, np.int64)
    for t in texts:
        np.add.at(counts, np.unique((words(pa.array([t or ""]), NOT_ALNUM, True).hash % np.uint64(1 << 20)).astype(np.int64)), 1)
    return idf_table(counts, len(texts))


def test_similarity_against_counters():
    texts = [prose(5, 100), edited(prose(5, 100), 1, 0.05), "", "a b c", "A-b.C"]
    zero = np.zeros(1 << 20, np.float32)
    sets = shingle_sets(texts)
    for i in range(len(texts)):
        for j in range(len(texts)):
            a, b = sets[i], sets[j]
            high = sum((a | b).values())
            assert similarity(pa.array([texts[i]]), pa.array([texts[j]]), zero)[0] == pytest.approx(sum((a & b).values()) / high if high else 0)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 97 + (0 if i % 11 else 900))), None if i % 13 == 0 else f"s{i % 7 if i % 3 else 0}") for i in range(1500)]
    docs = spark.createDataFrame([*rows, (1, None, "s9"), (None, "a b", "s1"), (None, "a b", "s1")], "doc_id long, text string, source string")
    out = mix_sources(docs, shard_words=2000).toPandas()
    assert len(out) == 1503 and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] >= 0).all()
    size = out.fillna({"source": "~"}).groupby("source")["size"].sum()
    left, open_, target = float(size.sum()), {}, {}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size.index))}
    open_ = set(size.index)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < level * weight[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    got = out.fillna({"source": "~"}).groupby("source").agg({"target": "first", "taken": "sum", "source_size": "first"})
    for s in size.index:
        assert got["target"][s] == pytest.approx(target[s]) and got["source_size"][s] == size[s]
        assert abs(got["taken"][s] - target[s]) <= 64 + 0.01 * target[s]
    again = mix_sources(docs.repartition(3), shard_words=2000).toPandas()
    order = ["doc_id", "digest", "taken"]
    assert out[order].sort_values(order).astype(str).values.tolist() == again[order].sort_values(order).astype(str).values.tolist()
    assert mix_sources(docs.limit(0)).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    for seed in range(4):
        rng = random.Random(seed)
        votes = [(f"g{g}", f"p{i:02d}", float(rng.choice([0, 1, 5, rng.randint(1, 5000)]))) for g in range(3) for i in range(12)]
        seats = {f"g{g}": rng.randint(0, 300) for g in range(3)}
        df = spark.createDataFrame([(g, p, v, seats[g]) for g, p, v in votes], "g string, p string, v double, s long")
        got = {(r["g"], r["p"]): r["quota"] for r in sainte_lague(df, ["g"], "p", "v", "s").collect()}
        for g, n in seats.items():
            quotients = sorted(((-v / (2 * k + 1), p, k) for x, p, v in votes if x == g and v > 0 for k in range(n)))[:n]
            want = Counter(p for _, p, _ in quotients)
            assert {p: got[g, p] for x, p, _ in votes if x == g} == {p: want.get(p, 0) for x, p, _ in votes if x == g}


def test_targets_when_all_are_full(spark):
    df = spark.createDataFrame([("a", 10)], "source string, source_size long")
    assert targets(df, (5, 2, 1), 3.0).first()["target"] == pytest.approx(10)


def test_token_orc(spark, tmp_path):
    from tokenizers import Tokenizer

    path = q.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "a <|endoftext|> b", " lead", "two  spaces", "tail ", "a　b \x1c c"]
    docs = table(spark, texts, True)
    found, start = by_id(tokens_of(docs, path)), 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    write_tokens(docs, f"file://{tmp_path}/t", path)
    one = read_tokens(spark, f"file://{tmp_path}/t").where("doc_id = 4")
    assert one.first()["ids"][-1] == 0 and "doc_id = 4" in one._jdf.queryExecution().toString().replace("#", " ").replace("EqualTo(doc_id,4)", "doc_id = 4")
    assert tokens_of(docs.limit(0), path).count() == 0
    # Stripe footers: a row index (6) and a Bloom filter (7, 8) beside the data
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    file = next(str(f) for f in sorted((tmp_path / "t").glob("*.orc")))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    kinds = {streams.get(i).getKind().getNumber() for i in range(streams.size())}
    assert 6 in kinds and kinds & {7, 8}


def test_token_ids_of_equal_documents(spark):
    """One id in most rows, texts that differ and that repeat, null ids: starts count up in order of the ids."""
    path = q.tokenizer("byte_bpe_50k.json")
    texts = ["a b, c.\nD", "a b, c.\nD", "it's (x) \"y\"", None, "\n\n"] * 40
    docs = spark.createDataFrame([(None if i % 7 == 0 else 5 if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(tokens_of(docs.repartition(5), path).collect(), key=lambda r: r["start"])
    assert len(rows) == len(texts) and [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_tokens(seed):
    from tokenizers import Tokenizer

    path = q.tokenizer("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(seed)
    parts = ["a", "b ", " ", "  ", " ", "\u3000", "é", "é.", "日", "\n", "\t", "1", "'s", "'", "\x1c", "\u2009", "<|endoftext|>", "a<|endoftext|>", ".", " x", "(", '"q', "ab", "q's"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert encode_texts(path, pa.array(texts)).to_pylist() == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def keys(text):
    strip = " \t\n\x0b\x0c\r"
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip)) for line in (text or "").split("\n")]


def test_line_dedup(spark):
    texts = [*ODD, *[f"Shared Line\n{prose(i, 5)}\n É shared\t\n\n{'twice' if i < 9 else ''}" for i in range(14)], *[" shared line \nÉ SHARED", "é shared", "twice\ntwice\nTWICE"]]
    docs = table(spark, texts, True)
    df = Counter(k for t in texts for k in set(keys(t)) if k)
    found = by_id(line_dedup(docs).withColumn("out", kept_text()))
    for i, t in enumerate(texts):
        kept = [line for line, k in zip((t or "").split("\n"), keys(t)) if not (k and df[k] >= 10)]
        assert found[i]["out"] == "\n".join(kept)
        assert (found[i]["n_lines"], found[i]["n_dropped"]) == (len(keys(t)), len(keys(t)) - len(kept))
    first = line_dedup(docs, min_docs=2, keep_first=True).withColumn("out", kept_text()).collect()
    assert sum(k == "shared line" for r in first for k in keys(r["out"])) == 1
    alike = by_id(line_dedup(docs, salts=1).withColumn("out", kept_text()))
    assert all(alike[i]["out"] == found[i]["out"] for i in found)
    twice = line_dedup(docs.union(docs)).count()
    assert twice == 2 * len(texts) and line_dedup(docs.limit(0)).count() == 0


def test_quality_rules(spark):
    texts = [*ODD, prose(2, 400), prose(3, 60) + " " + prose(3, 60), ("same line here\n" * 30), prose(4, 200) + "\n" + prose(5, 20) + "\n" + prose(5, 20)]
    docs = table(spark, texts, True)
    found = by_id(quality_rules(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        spots = {j + k for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(spots))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(spots) > 50 * len(w))
        if len(w) < 500:
            five = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
            assert r["covered_words"] == len({j + k for j in range(len(w) - 4) if five[tuple(w[j : j + 5])] > 1 for k in range(5)})
            n = 0
            while n < len(w) and max(Counter(tuple(w[j : j + n + 1]) for j in range(len(w) - n)).values()) > 1:
                n += 1
            assert r["longest_repeat"] == n
        assert not (r["base_failed"] and r["kept"])
    assert found[len(ODD)]["kept"] and not found[5]["kept"]
    kept = quality_rules(docs, keep_columns=True)
    assert set(docs.columns) <= set(kept.columns) and kept.count() == len(texts) and quality_rules(docs.limit(0)).count() == 0


def test_long_lines_with_equal_blocks_in_another_order(spark):
    a, b, c = "a" * 4096, "b" * 4096, "c" * 8192
    texts = [f"{a}{b}\n{b}{a}", f"{a}{b}\n{a}{b}", f"{c}{a}{b}\n{a}{b}{c}", f"{a}{c}\n{c}{a}\n{a}{c}"]
    found = by_id(quality_rules(table(spark, texts)))
    assert [found[i]["n_dup_lines"] for i in range(4)] == [0, 1, 0, 1]


def test_chat_format(spark):
    texts = ["</s>[INST] ok [/INST]", "&lt;|end|>", "<|end|><|part|>", "a & b &amp; c &#91;", None, "", "x\ny", "<<SYS>>[INST]"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(101, 0, "user", x) for x in ("<s>", "1", "&", "[INST]", "a", "<|")] + [(102, t, "assistant" if t % 3 else "user", f"<s>{t}") for t in range(1500)]
    rows += [(100, 1, "user", "same"), (100, 1, "user", "same"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = format_chats(df)
    got = {r["conv_id"]: r for r in chat_digests(chats).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chats.select(F.explode(read_turns(F.col("formatted")))).count() == len(rows) and format_chats(df.limit(0)).count() == 0


def test_repeated_passages(spark):
    shared = [prose(900 + k, 50 + 7 * k) for k in range(4)]
    texts = [prose(s, 150) for s in range(40)]
    for i in range(30):
        texts.append(f"{prose(2000 + i, 40 + i)} {shared[i % 4]} {prose(3000 + i, 30)}")
    texts += [prose(7, 600)] * 3 + [None, "", "a", prose(1, 149)] + [prose(50, 49), prose(50, 49)]
    docs = table(spark, texts, True)
    found = by_id(repeated_passages(docs))
    assert len(found) == len(texts)
    w = [(t or "").split() for t in texts]
    seen = {}
    for i, x in enumerate(w):
        for j in range(len(x) - 49):
            seen.setdefault(tuple(x[j : j + 50]), set()).add(i)
    for i, x in enumerate(w):
        want = {j + k for j in range(len(x) - 49) if len(seen[tuple(x[j : j + 50])]) > 1 for k in range(50)}
        got = {k for s in found[i]["spans"] for k in range(s["start"], s["end"])}
        assert got == want, i
        assert found[i]["repeated_words"] == len(want)
    assert repeated_passages(docs.limit(0)).count() == 0


def test_passages_cut_at_different_places(spark):
    """Edited copies, and one passage of 74 words cut at all places, so that texts sorted next to each other share less."""
    texts, passage = [], prose(70, 74).split()
    for cut in range(25):
        for end in range(50 + cut, 75):
            texts.append(f"{prose(4000 + 100 * cut + end, 3)} {' '.join(passage[cut:end])} {prose(8000 + 100 * cut + end, 3)}")
    texts += [edited(prose(s, 300), 100 * s + c, 0.02) for s in range(3) for c in range(25)]
    texts += [f"{prose(61, 60)} {prose(62, 5)} {prose(61, 55)}"] + [prose(61, 60)] * 2
    w = [t.split() for t in texts]
    seen = {}
    for i, x in enumerate(w):
        for j in range(len(x) - 49):
            seen.setdefault(tuple(x[j : j + 50]), set()).add(i)
    found = by_id(repeated_passages(table(spark, texts)))
    for i, x in enumerate(w):
        want = {j + k for j in range(len(x) - 49) if len(seen[tuple(x[j : j + 50])]) > 1 for k in range(50)}
        assert {k for s in found[i]["spans"] for k in range(s["start"], s["end"])} == want, i


def test_passages_of_too_few_words(spark):
    """49 shared words, then words of which each two differ, whatever short code they have: no passage."""
    passage = prose(77, 49)
    texts = [f"x{i} {passage} w{i}" for i in range(2000)] + [f"{passage} same y{i} {prose(i, 9)}" for i in range(2)]
    found = by_id(repeated_passages(table(spark, texts)))
    assert {i for i in found if found[i]["repeated_words"]} == {2000, 2001}
    assert {(s["start"], s["end"]) for i in (2000, 2001) for s in found[i]["spans"]} == {(0, 50)}


def test_sentencepiece(spark):
    path = q.tokenizer("piece_bpe_32k.model")
    library = load(path).library
    texts = [*ODD, "  a   b  ", "▁▁x▁", "aaaaaaaaaaaaaaaaa", "퟿�"]
    docs = table(spark, texts, True)
    rows = by_id(decode_documents(encode_documents(docs, path), path))
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library.encode(t or "") and rows[i]["decoded"] == library.decode(library.encode(t or ""))
    again = by_id(round_trips(docs, path))
    for i, t in enumerate(texts):
        ids, decoded = rows[i]["ids"], rows[i]["decoded"]
        assert tuple(again[i]) == (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(decoded), hashlib.md5(decoded.encode()).hexdigest(), decoded == (t or ""))
    assert encode_documents(docs.limit(0), path).count() == 0 and round_trips(docs.limit(0), path).count() == 0


def test_media(spark, tmp_path):
    docs = table(spark, [*ODD, "same", "same"], True).union(spark.createDataFrame([(None, "no id", "en", "s", 0)], DOCS).withColumns({"ids": F.lit("x"), "kept": F.lit(1), "n_lines": F.lit(2), "node": F.lit("y")}))
    found = by_id(media_columns(docs))
    for i, t in enumerate([*ODD, "same", "same"]):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert decode_png(encode_png(payload)).tobytes() == payload and hashlib.sha256(encode_png(payload)).hexdigest() == r["media_sha256"]
    n = len(ODD)
    assert found[n][1:] == found[n + 1][1:] and None in found
    write_archives(docs, str(tmp_path / "a"), archive_mb=0)
    archives = sorted((tmp_path / "a").iterdir())
    assert read_archives(spark, str(tmp_path / "a"), range_mb=1).where("error is null").count() == n + 3
    damaged = bytearray(archives[0].read_bytes())
    damaged[80] ^= 255
    archives[0].write_bytes(damaged)
    bad = read_archives(spark, str(tmp_path / "a")).where("error is not null").collect()
    assert len(bad) == 1 and bad[0]["media"] is None
    assert media_columns(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_oracle(spark, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(q.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: "-" if v is None or v != v else str(round(float(v), 9)) if isinstance(v, (int, float, np.number)) else str(v)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist())
    assert rows(got) == rows(want)
