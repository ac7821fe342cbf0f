"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted by turn; runs of turns of one role are merged into one block,
and the blocks are joined. Within a block the texts keep a part mark between them, so that the turns can be read back.

Template, marks written as they are:
    <|role|>ROLE<|text|>TEXT[<|part|>TEXT...]<|end|>     per block, one after the other
Texts and roles are escaped: & as &amp;, and the first character of each control string as &lt; or &#91;. Undoing that in
the opposite order gives the text back, whatever it holds.

The loss mask is an array of (start, length) in characters of the formatted text: each text of the trained role, without
marks.

Defined results: null text is empty; null role is the empty role; turns tie by role, then text, as they are before escaping; repeated rows
are turns of their own; a null conversation id is a conversation; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
ROLE, TEXT, PART, END = "<|role|>", "<|text|>", "<|part|>", "<|end|>"
# Control strings of common chat templates, which no text may bring in.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_FIRST = {"<": "&lt;", "[": "&#91;"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(_FIRST[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for first, code in _FIRST.items():
        text = F.replace(text, F.lit(code), F.lit(first))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start, length)."""
    empty = F.lit("")
    turns = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), empty).alias("role"), F.coalesce(F.col(f"`{text_col}`"), empty).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Plain texts set the order of ties; what is written is escaped.
    chats = chats.select("conv_id", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    # Where a block starts: a role other than the one before.
    n = F.size("turns")
    same = lambda i: F.get("turns", i)["role"] == F.get("turns", i - 1)["role"]
    chats = chats.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(i)))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(n))
    blocks = F.zip_with("starts", ends, lambda a, b: F.struct(F.get("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda t: t["text"]).alias("texts")))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    # Segments in order, each with whether it counts as loss.
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT))
    body = lambda b: F.flatten(F.transform(b["texts"], lambda t, i: F.array(segment(F.when(i > 0, PART).otherwise(""), F.lit(False)), segment(t, b["role"] == trained))))
    segments = F.flatten(F.transform("blocks", lambda b: F.concat(F.array(segment(head(b), F.lit(False))), body(b), F.array(segment(F.lit(END), F.lit(False))))))
    chats = chats.select("conv_id", segments.alias("segments"))
    # Places are summed up within chunks of segments, then over chunks, so that long conversations stay cheap.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("segments") - 1) / CHUNK).cast("int")), lambda i: F.slice("segments", i * CHUNK + 1, CHUNK))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    placed = lambda chunk: F.aggregate(chunk, start, lambda acc, s: F.struct((acc["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(acc["mask"], F.array(F.struct(acc["at"].alias("start"), F.length(s["text"]).alias("length"))))).otherwise(acc["mask"]).alias("mask")))
    chats = chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.transform(chunks, placed).alias("chunks"))
    bases = F.aggregate("chunks", F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
    chats = chats.select("conv_id", "formatted", "chunks", bases.alias("bases"))
    mask = F.flatten(F.transform("chunks", lambda c, i: F.transform(c["mask"], lambda m: F.struct((m["start"] + F.get("bases", i)).alias("start"), m["length"].alias("length")))))
    return chats.select("conv_id", "formatted", mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    def turns(block: Column) -> Column:
        sides = F.split(F.substr(block, F.lit(len(ROLE) + 1)), r"<\|text\|>", 2)
        return F.transform(F.split(sides[1], r"<\|part\|>", -1), lambda t: F.struct(unescape(sides[0]).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted text and its mask."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
