"""Conversation structure repair by weighted interval parsing.

A conversation is in order when its role initials read (s?(ua)+)?. The grammar is in Chomsky normal form: a nonterminal
(p, q) stands for turns that lead from place p to place q of that pattern (START, or after a system, user or assistant
turn). Its rules are

    (p, q) -> (p, r) (r, q)          two neighbouring spans
    (p, q) -> one turn               kept, given another role, or deleted, at a cost
    (p, q) -> nothing                the cheapest turns inserted between p and q: the insertion closure

and a conversation derives from (START, START) or (START, after assistant). A cell of the chart holds, for a span of turns
and a nonterminal, the least (cost, audit), an audit being the initials of its edits in order: K keep, R change the role,
D delete, I insert. Cells are combined bottom-up by the length of their span, over all places to split it, the closure
being applied to single turns. Audits of one cell and one cost have as many letters D, K and R as the span has turns and
equally many I, so none is another's beginning, and the least audit of a whole is made of the least audits of its parts.

Conversations of over BLOCK turns are parsed in blocks of so many; the blocks' cells are then combined pairwise, again
bottom-up by length: nonterminals are pairs of places, so each way to split a span has the same least cell. Spark damages,
orders and judges turns and puts the repaired text together; Python sees one letter a turn.

Defined results: null roles and texts are one space; a null conversation id is a conversation; null turns come first;
turns of equal number stand by role, then text; repeated rows are duplicates; other columns are ignored; a conversation
without turns has zeros, an empty audit and the hash of the empty string; empty input gives no rows. A conversation is one
row of the result and its hash spans all its texts, so its turns meet in one task.
"""

from __future__ import annotations

from functools import lru_cache
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACES

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 8
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a place and by a role initial to the next place.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Nonterminals: pairs of places of which the second follows from the first.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q in (USER, ASSISTANT) or (p, q) == (START, SYSTEM)]
#: For each nonterminal, its rules (p, r) (r, q) as numbers of nonterminals.
RULES = [[(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS]
#: A span's least (cost, audit) for each nonterminal.
Cells = list[tuple[float, str]]


def _least(cells: Cells, p: int, q: int, cost: float, audit: str) -> None:
    k = PAIRS.index((p, q))
    cells[k] = min(cells[k], (cost, audit))


def _joined(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """All (p, q) -> (p, r) (r, q) of two neighbouring spans, and what is in `into` already."""
    out = []
    for k, rules in enumerate(RULES):
        cost, audit = into[k] if into else (inf, "")
        for a, b in rules:
            (c, x), (d, y) = left[a], right[b]
            c += d
            if c < cost or c == cost and x + y < audit:
                cost, audit = c, x + y
        out.append((cost, audit))
    return out


def _closure() -> Cells:
    """Cells of the empty span: the cheapest inserted turns between two places."""
    cells: Cells = [(0, "") if p == q else (inf, "") for p, q in PAIRS]
    for _ in range(4):
        for (p, r), (cost, audit) in zip(PAIRS, list(cells)):
            for c in "ua":
                if cost < inf and (r, c) in STEPS:
                    _least(cells, p, STEPS[r, c], cost + INSERT, audit + "I")
    return cells


NOTHING = _closure()


@lru_cache(maxsize=64)
def _turn(code: str) -> Cells:
    """Cells of one turn. code: s, u, a or o (another role); upper case: truncated; x: it has to go."""
    cells: Cells = [(DELETE, "D") if p == q else (inf, "") for p, q in PAIRS]
    if code != "x":
        more = TRUNCATED * code.isupper()
        for (p, c), q in STEPS.items():
            if c == code.lower():
                _least(cells, p, q, KEEP + more, "K")
            if c != "s":
                _least(cells, p, q, REROLE + more, "R")
    return _joined(_joined(NOTHING, cells), NOTHING)


@lru_cache(maxsize=1 << 15)
def _block(codes: str) -> Cells:
    """Cells of the whole span, from all its spans, by length, and all their splits."""
    n = len(codes)
    chart = {(i, i + 1): _turn(c) for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = None
            for k in range(i + 1, i + length):
                cell = _joined(chart[i, k], chart[k, i + length], cell)
            chart[i, i + length] = cell
    return chart[0, n]


def parse(codes: str) -> tuple[int, str]:
    """The least (cost, audit) that puts turns of these codes in order."""
    spans = [_block(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)]
    while len(spans) > 1:
        pairs = [_joined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[2 * len(pairs) :]
    return min(spans[0][PAIRS.index((START, q))] for q in (START, ASSISTANT)) if spans else (0, "")


def written(audit: str) -> tuple[list[int], list[str]]:
    """What the edits leave: the index of each turn, -1 where it is inserted, and its new role, empty where it stays."""
    n = sum(c != "D" for c in audit)
    rows, roles, at = [], [], 0
    for c in audit:
        if c != "D":
            role = "user" if (len(rows) - n % 2) % 2 == 0 else "assistant"
            rows.append(-1 if c == "I" else at)
            roles.append("" if c == "K" else role)
        at += c != "I"
    return rows, roles


_REPAIR = T.StructType().add("cost", T.LongType()).add("audit", T.StringType()).add("rows", T.ArrayType(T.IntegerType())).add("roles", T.ArrayType(T.StringType()))


@F.pandas_udf(_REPAIR)
def repaired(codes: pd.Series) -> pd.DataFrame:
    out = [(*p, *written(p[1])) for p in map(parse, codes)]
    return pd.DataFrame(out, columns=["cost", "audit", "rows", "roles"])


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, drawn by id and turn; `lost` marks the dropped ones."""
    blank = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = rows.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"), F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (draw == 0).alias("lost"), draw.alias("draw"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))).drop("draw", "copy")


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role,
    text). Rows that `lost_col` marks are no turns, but their conversations are in the result."""
    blank = F.lit(" ")
    lost = F.col(f"`{lost_col}`") if lost_col else F.lit(False)
    turns = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), blank).alias("role"), F.coalesce(F.col(f"`{text_col}`"), blank).alias("text"), lost.alias("lost"))
    # One shuffle by conversation serves the search for repeats and the gathering of turns.
    turns = turns.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    bare = _stripped(F.col("text"))
    fault = F.when(bare == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    turns = turns.withColumn("seen", seen).withColumn("fault", fault)
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text", "seen", "fault", code.alias("code"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("lost"), turn))).alias("turns"))
    chats = chats.withColumn("fixed", repaired(F.array_join(F.transform("turns", lambda t: t["code"]), "")))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce((F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))).cast("long"), F.lit(0).cast("long"))
    count = lambda fault: F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long")
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    pairs = F.zip_with(initials, F.slice(initials, 2, F.greatest(F.size("turns"), F.lit(1))), lambda a, b: F.when(b.isNull(), False).otherwise(~F.concat(a, b).isin("su", "ua", "au")))
    edits = F.zip_with("fixed.rows", "fixed.roles", lambda i, role: F.struct(F.when(role != "", role).otherwise(F.get("turns", i)["role"]).alias("role"), F.when(i < 0, "").otherwise(F.get("turns", i)["text"]).alias("text")))
    return chats.select("conv_id", gaps.alias("gaps"), count("blank").alias("blank"), count("duplicate").alias("duplicate"), count("truncated").alias("truncated"), F.size(F.filter(pairs, lambda bad: bad)).cast("long").alias("illegal"), "fixed.cost", "fixed.audit", edits.alias("repaired"))


def repair_digests(repaired_chats: DataFrame) -> DataFrame:
    """The repaired turns as a digest of role:text, joined by newlines."""
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired_chats.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))
