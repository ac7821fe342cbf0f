"""Turn repair against a shortest-path search, with nulls, ties, repeats, long conversations and clashing columns."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm.turn_repair import damage, parse, repair_conversations, repair_digests, written

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(codes):
    """Dijkstra over (turn, place), by cost and audit."""
    done, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, i, p = heapq.heappop(heap)
        if (i, p) in done:
            continue
        done[i, p] = cost, audit
        steps = [(3, "I", i, NEXT[p, c]) for c in "ua" if (p, c) in NEXT]
        if i < len(codes):
            steps.append((4, "D", i + 1, p))
            if codes[i] != "x":
                more = 3 * codes[i].isupper()
                steps += [(more, "K", i + 1, q) for (r, c), q in NEXT.items() if (r, c) == (p, codes[i].lower())]
                steps += [(3 + more, "R", i + 1, NEXT[p, c]) for c in "ua" if (p, c) in NEXT]
        for more, letter, j, q in steps:
            heapq.heappush(heap, (cost + more, audit + letter, j, q))
    return min(done[len(codes), p] for p in (0, 3) if (len(codes), p) in done)


def test_parse_is_the_cheapest_repair():
    rng = random.Random(5)
    every = ["".join(c) for n in range(4) for c in itertools.product("suaoSUAOx", repeat=n)]
    longer = ["".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(5, 70))) for _ in range(300)]
    for codes in every + longer:
        cost, audit = parse(codes)
        assert (cost, audit) == cheapest(codes), codes
        rows, roles = written(audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] if r else codes[i].lower() for i, r in zip(rows, roles))), codes


def expected(rows):
    """What the contract says of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    codes = "".join("x" if f in ("blank", "duplicate") else (c.upper() if f else c) for f, c in zip(faults, (r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in rows)))
    cost, audit = cheapest(codes)
    said = "\n".join((new or rows[i][1]) + ":" + ("" if i < 0 else rows[i][2]) for i, new in zip(*written(audit)))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()


def test_repair_of_odd_rows(spark):
    rng = random.Random(11)
    texts = [None, "", " \t", "Yes.", "No", "Yes.", "…é!", "a" * 5000 + "?", "word " * 4000 + "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice([None, "", "system", "user", "assistant", "tool", "usr"]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "Hm."), (None, 0, "user", "Hm."), (77, None, "user", "x")] + [(99, i, ("user", "assistant")[i % 3 % 2], f"t{i}.") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit("x")).withColumn("lost", F.lit(1)).withColumn("seen", F.lit(2)).withColumn("draw", F.lit(3))
    got = {r["conv_id"]: r for r in repair_digests(repair_conversations(damage(df), lost_col="lost")).collect()}
    want = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        kept = [(turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
        want.setdefault(c, []).extend(kept)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert tuple(got[c])[1:] == expected(turns), c
    plain = repair_conversations(df)  # the column `lost` of the input plays no part
    assert plain.count() == len(want) and repair_conversations(df.limit(0)).count() == 0
    texts_of = {r["conv_id"]: [t["text"] for t in r["repaired"]] for r in plain.collect()}
    assert "Hm." in texts_of[None]
