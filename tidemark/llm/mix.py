"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words per document. Each source gets a target: its weight's share of all words, at most `most` times its own
size, the excess shared anew among the others (solved at once by ranking sources by limit over weight). Targets are cut
into blocks of `block` words, and the blocks are allotted to sources by the highest quotients target / (2k + 1). A
source's blocks are allotted in the same way to the parts of its shards, level by level, by size: groups of FAN x FAN
shards, groups of FAN shards, shards. So no window ranks more than about FAN parties, however large a source is. Nobody
counts blocks one by one: a divisor gives nearly all seats, and only the few quotients next to it are ranked.

A shard's documents stand in an order drawn from the seed, and their words are cut into equal blocks of about `block`. Of a quota, whole rounds
take every block; the rest are the blocks with the least of the numbers that all blocks of the shard draw from seed, source
and shard. A source that
takes `most` times its size takes every block as many times.

Everything is DataFrame work. A source's documents are spread over shards of about `shard_words` words, so a hot source
is many windows; only the table of sources (one row each) meets in a window of its own.

Defined results: null text has size 0; null source is a source of its own, last in order; sizes of 0 take 0; repeated rows
each take part, in an order that doesn't change results; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_or_empty

#: Parties that a level of shards has at most, as far as three levels reach (10^9 shards a source).
FAN = 1000


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sources(source, source_size) with target: the weighted share of all words, at most `most` times source_size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("limit", most * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / weight)
    # The first source whose limit is above its share sets the level for all from there on; those before it are full.
    level = level.withColumn("level", F.first(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(all_rows))
    full = F.col("level").isNull() | (F.col("limit") <= F.col("level") * F.col("weight"))
    return level.select("source", "source_size", "weight", F.when(full, F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], party: str, votes: str, seats: str) -> DataFrame:
    """parties with quota: how many of its group's `seats` each gets by the highest quotients votes / (2k + 1); ties go
    to the lower party. The divisor votes / seats rounds to nearly all seats at once; the quotients within the number of
    parties of it are then ranked."""
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(by), F.count(F.lit(1)).over(by)
    near = parties.withColumn("near", F.when(total > 0, F.floor(F.col(votes) * F.col(seats) / total + 0.5)).otherwise(0).cast("long"))
    # Rounding errs by at most half a seat a party; a party's share of that is at most its share of votes, plus one.
    reach = F.ceil(n * F.col(votes) / total).cast("long") + 2
    near = near.withColumn("sure", F.greatest(F.lit(0), F.col("near") - F.when(total > 0, reach).otherwise(0))).withColumn("reach", F.when(total > 0, 2 * reach + 1).otherwise(0))
    near = near.withColumn("open", F.col(seats) - F.sum("sure").over(by))
    quotients = near.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reach")))).withColumn("quotient", F.col(votes) / (2 * (F.col("sure") + F.col("k")) + 1))
    ranked = quotients.withColumn("rank", F.row_number().over(by.orderBy(F.col("quotient").desc(), F.col(party).asc_nulls_last(), "k")))
    won = F.sum(F.when((F.col("rank") <= F.col("open")) & (F.col(votes) > 0), 1).otherwise(0))
    keys = [*dict.fromkeys([*parties.columns, "sure"])]
    return ranked.groupBy(*keys).agg(won.alias("won")).withColumn("quota", F.col("sure") + F.col("won")).drop("sure", "won")


def hash32(*parts) -> F.Column:
    """32 bits of md5, so that SQL elsewhere can draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _beside(parts: DataFrame, above: DataFrame, level: str) -> DataFrame:
    """parts with the blocks of the group of the level above that they are in."""
    of = above.select(F.col("source").alias("of"), F.col(level).alias("up"), "blocks")
    return parts.join(of, parts["source"].eqNullSafe(of["of"]) & (parts[level] == of["up"])).drop("of", "up")


def block_draw(source: F.Column, shard: F.Column, block: F.Column, seed: int) -> F.Column:
    """The number that a block draws: those of the least numbers of a shard are taken."""
    return F.xxhash64(F.lit(seed), source, shard, block)


def last_drawn(source: F.Column, shard: F.Column, n: F.Column, rest: F.Column, seed: int) -> F.Column:
    """The greatest number that is taken where `rest` of a shard's n blocks are; null where none is."""
    numbers = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: block_draw(source, shard, b, seed)))
    return F.when(rest > 0, F.get(numbers, (F.least(rest, n) - 1).cast("int")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, block: int = 64, shard_words: int = 50_000, seed: int = 17, keep_columns: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target (its source's), taken (words the mix takes of it)
    and digest (md5 of its text). keep_columns: and row, a struct of all columns of docs."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_columns else []
    rows = docs.select(*kept, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), F.md5(text_or_empty(text_col).cast("binary")).alias("digest"))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("blocks", F.round(F.sum("target").over(everything) / block).cast("long"))
    sources = sainte_lague(sources, [], "source", "target", "blocks")
    sources = sources.select(F.col("source").alias("of"), "source_size", "target", F.col("quota").alias("source_blocks"), (F.col("target") >= most * F.col("source_size")).alias("full"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards"))
    # One row a source; Spark broadcasts it where its size allows and splits the join otherwise.
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["of"])).drop("of")
    placed = placed.withColumn("draw", hash32(F.lit(str(seed)), name, "digest")).withColumn("shard", F.col("draw") % F.col("n_shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("votes"), F.first("source_blocks").alias("blocks"), F.first("full").alias("full"))
    shards = shards.withColumns({"outer": F.floor(F.col("shard") / FAN**2), "middle": F.floor(F.col("shard") / FAN)})
    outer = shards.groupBy("source", "outer").agg(F.sum("votes").alias("votes"), F.first("blocks").alias("blocks"))
    outer = sainte_lague(outer, ["source"], "outer", "votes", "blocks").select("source", "outer", F.col("quota").alias("blocks"))
    middle = shards.groupBy("source", "outer", "middle").agg(F.sum("votes").alias("votes"))
    middle = sainte_lague(_beside(middle, outer, "outer"), ["source", "outer"], "middle", "votes", "blocks").select("source", "middle", F.col("quota").alias("blocks"))
    inner = _beside(shards.select("source", "middle", "shard", "votes", "full"), middle, "middle")
    inner = sainte_lague(inner, ["source", "middle"], "shard", "votes", "blocks")
    has = F.greatest(F.lit(1), F.col("votes"))
    inner = inner.withColumns({"has": has, "n_blocks": F.greatest(F.lit(1), F.round(has / block)).cast("long")})
    has, n = F.col("has"), F.col("n_blocks")
    rounds = F.when(F.col("full"), F.lit(int(most))).otherwise(F.least(F.lit(int(most)), F.floor(F.col("quota") * block / has)))
    inner = inner.withColumn("rounds", rounds).withColumn("rest", F.when(F.col("rounds") >= int(most), 0).otherwise(F.round((F.col("quota") * block - F.col("rounds") * has) * n / has)).cast("long"))
    inner = inner.select(F.col("source").alias("of"), F.col("shard").alias("at"), "has", "n_blocks", "rounds", last_drawn(F.col("source"), F.col("shard"), n, F.col("rest"), seed).alias("last"))
    whole = placed.drop("full").join(inner, placed["source"].eqNullSafe(inner["of"]) & (placed["shard"] == inner["at"]))
    order = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    whole = whole.withColumn("before", before)
    has, n = F.col("has"), F.col("n_blocks")
    # The words of this document in each block that it reaches into, where that block is drawn.
    first, last = F.floor(F.col("before") * n / has), F.floor((F.col("before") + F.greatest(F.lit(1), F.col("size")) - 1) * n / has)
    words = lambda b: F.least(F.ceil((b + 1) * has / n), F.col("before") + F.col("size")) - F.greatest(F.ceil(b * has / n), F.col("before"))
    drawn = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + F.when(block_draw(F.col("source"), F.col("shard"), b, seed) <= F.col("last"), words(b)).otherwise(0))
    taken = F.col("rounds") * F.col("size") + F.when(F.col("last").isNotNull() & (F.col("size") > 0), drawn).otherwise(0)
    return whole.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "digest", *(["row"] if keep_columns else []))
