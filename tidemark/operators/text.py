"""Source documents: duplicates of a story, clauses, and rule-based labels of clauses. Column expressions throughout; word
lists are parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import connected_components
from tidemark.shared import Scratch, stored

# Trust in a source, best first.
RELIABILITY = ("PRIMARY", "SECONDARY", "TERTIARY")
#: The characters of a squeezed body that its fingerprint takes, and those of the body that mostly hold them.
PRINTED, READ = 400, 1200


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def fingerprint(title: Column, body: Column) -> Column:
    """24 hex digits of the squeezed title and the first 400 characters of the squeezed body."""
    # What stands before a space that more text follows is the same whatever comes later; few texts have to be squeezed whole.
    start = _squeezed(F.substring(body, 1, READ))
    start = F.when(F.locate(" ", start, PRINTED + 1) > 0, start).otherwise(_squeezed(body))
    return F.substring(F.sha2(F.concat(_squeezed(title), F.lit("|"), F.substring(start, 1, PRINTED)).cast("binary"), 256), 1, 24)


def title_key(title: Column) -> Column:
    """The title in lower case without a publisher's suffix, punctuation and repeated spaces."""
    key = F.regexp_replace(F.trim(F.lower(title)), r"\s*[-|]\s*[a-z0-9 .]{2,40}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(key, "[^a-z0-9 ]", ""), " +", " "))


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """docs with title_key and duplicate_of: the most trusted, then earliest, then least document of the same story; null
    for that document itself. Documents of one title key or one fingerprint are one story, and what these join; without a
    title the fingerprint alone counts, without a column `body` the title alone. Partial minima and joins, so a title that very many share is no hot window; only
    title keys that share a fingerprint with another are looked at as a graph."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RELIABILITY]), F.col("reliability"))
    rank = F.when(rank > 0, rank).otherwise(len(RELIABILITY) + 1)
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")) if "body" in docs.columns else F.when(F.col("title").isNull(), F.col("source_id").cast("string")).otherwise("")
    keyed = docs.withColumns({"title_key": title_key(F.col("title")), "__fingerprint": fingerprint(title, body)})
    keyed = keyed.withColumn("__story", F.coalesce("title_key", F.concat(F.lit("#"), "__fingerprint")))
    pairs = keyed.select("__fingerprint", "__story").distinct()
    several = pairs.groupBy("__fingerprint").agg(F.min("__story").alias("src"), F.max("__story").alias("high")).where("src <> high")
    room = Scratch(docs.sparkSession, "stories")
    edges, n = room.counted(pairs.join(several, "__fingerprint").select("src", F.col("__story").alias("dst")), "edges")
    # Heads are found among titles, so that documents are joined, and their texts shuffled, once.
    heads = keyed.groupBy("__story").agg(F.min(F.struct(rank, "published_at", "source_id")).alias("first"))
    if n:
        joined = connected_components(edges).select(F.col("node").alias("__story"), "component")
        heads = stored(heads.join(joined, "__story", "left").withColumn("__of", F.coalesce("component", "__story")).drop("component"), "stories")
        whole = heads.groupBy("__of").agg(F.min("first").alias("least"))
        heads = heads.join(whole, "__of").select("__story", F.col("least").alias("first"))
    room.drop()
    heads = heads.select("__story", F.col("first")["source_id"].alias("head"))
    return keyed.join(heads, "__story").withColumn("duplicate_of", F.when(F.col("head") != F.col("source_id"), F.col("head"))).drop("head", "__story", "__fingerprint")


def independent_sources(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return docs.groupBy(*keys).agg(F.countDistinct(F.coalesce("duplicate_of", "source_id")).alias("independent"), F.count(F.lit(1)).alias("documents"))


def words_of(text: Column) -> Column:
    """The text's ASCII words in lower case, with spaces before, between and after them. Made once, it tells of any number
    of words whether they stand in the text, without a pattern for each."""
    # \W is [^a-z0-9_] in lower case; a class that is spelt out takes Java's patterns over ten times as long.
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\W+", " "), F.lit(" "))


def _holds(text: Column, parts: Sequence[str]) -> Column:
    held = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        held = held | F.contains(text, F.lit(part))
    return held


def any_word(text: Column, words: Sequence[str], among: Column | None = None) -> Column:
    """Whether one of the words stands in the text, in lower case, between characters that make no ASCII word. `among`:
    the text's words_of, where it is at hand."""
    low = F.lower(text)
    whole = lambda ws: low.rlike(rf"(?<!\w)(?:{'|'.join(ws)})(?!\w)")
    if not words or any(not w or set(w) & set(r"\.[](){}*+?|^$") for w in words):
        return whole(words)
    spaced = {w: re.sub("[^a-z0-9_]+", " ", w).strip() for w in words}
    if among is None or not all(spaced.values()):
        # Most texts hold none of the words, which a plain search tells without the pattern.
        return _holds(low, words) & whole(words)
    plain, phrases = [w for w in words if spaced[w] == w and " " not in w], [w for w in words if spaced[w] != w or " " in w]
    hits = [_holds(among, [f" {w} " for w in plain])] if plain else []
    if phrases:  # what stands between their words is left to the pattern
        hits.append(_holds(among, [f" {spaced[w]} " for w in phrases]) & whole(phrases))
    return hits[0] if len(hits) == 1 else hits[0] | hits[1]


def split_clauses(docs: DataFrame, contrast: Sequence[str], least: int = 1, words: str | None = None) -> DataFrame:
    """One row per clause with clause_index: sentences, cut at contrast words, trimmed, those under `least` dropped. With
    `words`, a column of that name with each clause's words_of: made here, no filter on what is read from it makes it anew."""
    letters = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in w) for w in contrast)
    cuts = r"(?<=[.!?])[ \t\n\f\r]+|\x02" + (rf"|(?<!\w)(?:{letters})(?!\w)" if letters else "")
    clean = F.filter(F.transform(F.split("body", cuts), lambda c: F.btrim(c, F.lit(" ,.;:"))), lambda c: c != "")
    if words is None:
        rows = docs.select(*docs.columns, F.posexplode(clean).alias("clause_index", "clause"))
    else:
        told = F.transform(clean, lambda c: F.struct(c.alias("clause"), words_of(c).alias(words)))
        rows = docs.select(*docs.columns, F.posexplode(told).alias("clause_index", "__told")).select(*docs.columns, "clause_index", "__told.clause", f"__told.{words}")
    return rows.where(F.length("clause") >= least)


def evidence_type(clause: Column, source_type: Column, cues: Mapping[str, Sequence[str]]) -> Column:
    """FACT for filings; else the first label, in order, with a cue in the clause; else REPORTING."""
    out = F.when(source_type == "filing", "FACT")
    for label, words in cues.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(clause), F.lit(w))
        out = out.when(hit, label)
    return out.otherwise("REPORTING")


def sentiment(clause: Column, positive: Sequence[str], negative: Sequence[str], negation: Sequence[str], among: Column | None = None) -> Column:
    """Polarity by word lists; one-sided polarity turns round under a negation word, both sides are MIXED."""
    pos, neg, turned = (any_word(clause, words, among) for words in (positive, negative, negation))
    return F.when(pos & neg, "MIXED").when(pos, F.when(turned, "NEGATIVE").otherwise("POSITIVE")).when(neg, F.when(turned, "POSITIVE").otherwise("NEGATIVE")).otherwise("NEUTRAL")


def affected_area(clause: Column, areas: Mapping[str, Sequence[str]], among: Column | None = None) -> Column:
    """The first area, in order, with a word in the clause; null if none."""
    return F.coalesce(*[F.when(any_word(clause, words, among), area) for area, words in areas.items()])


def event_clusters(events: DataFrame, keys: Sequence[str], time_col: str, tie: str, days: int = 4) -> DataFrame:
    """events with cluster, from 1 in time: a new one where the gap to the event before is over `days`. For events
    without diverging magnitudes; where magnitudes forbid some links, use connected components of the allowed ones."""
    by = Window.partitionBy(*keys).orderBy(time_col, tie)
    gap = F.col(time_col).cast("long") - F.lag(time_col).over(by).cast("long")
    marked = events.withColumn("__new", F.when(gap.isNull() | (gap > days * 86400), 1).otherwise(0))
    return marked.withColumn("cluster", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
