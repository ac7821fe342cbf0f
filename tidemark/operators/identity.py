"""Which reports tell of one occurrence: events of one topic within days of each other, unless their sizes diverge.

Two events are linked when their days are at most `days` apart and their sizes don't diverge: sizes of one unit diverge
when they differ by over half of the larger; a size of another unit, or none, diverges from nothing. Occurrences are the
connected components of links. No pair of events is made. Sizes of one day, unit and sign fall into bands between powers
of two: all of a band are linked, and sizes two bands apart never are, so a band needs its least and greatest size only.
Bands of one unit meet the same and the next band of days nearby; all that stands for another unit meets as a whole.
A topic of any number of events thus has some tens of cells a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import connected_components
from tidemark.operators.research import magnitude
from tidemark.shared import stored

# Days within which reports may be of one occurrence, and the share of the larger size that tells two apart.
DAYS, DIVERGENCE = 4, 0.5
TOPIC = ("entity", "event_type", "area")
#: Bands are numbered from 1 on either side of zero; the least size that has one is 2 to the power of 1 - MIDDLE.
MIDDLE = 1100


def _topic(keys: Sequence[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])


def _band(value: Column) -> Column:
    """The place of a size between powers of two, with its sign; 0 for none and for zero."""
    size = F.abs(value)
    k = F.floor(F.log2(size))
    # The logarithm is rounded; powers of two are not.
    k = k - (F.pow(F.lit(2.0), k) > size).cast("int") + (F.pow(F.lit(2.0), k + 1) <= size).cast("int")
    return F.when(size > 0, F.signum(value).cast("int") * (k + MIDDLE).cast("int")).otherwise(F.lit(0)).cast("int")


def cells(events: DataFrame, keys: Sequence[str], unit: Column, value: Column) -> DataFrame:
    """events with topic, day, unit_of (empty: no size), band and size."""
    sized = unit.isNotNull() & value.isNotNull()
    # A value that belongs to no size must not decide the band.
    return events.withColumns({"topic": _topic(keys), "day": F.to_date("published_at"), "unit_of": F.when(sized, unit).otherwise(""), "band": F.when(sized, _band(value)).otherwise(0), "size": F.when(sized, F.abs(value)).otherwise(0.0)})


def links(celled: DataFrame, days: int = DAYS) -> DataFrame:
    """(topic, day, unit_of, band, other_day, other_unit, other_band) of linked cells, one direction each; bands are null
    where all cells of two units are linked."""
    each = stored(celled.groupBy("topic", "day", "unit_of", "band").agg(F.min("size").alias("low"), F.max("size").alias("high")), "cells")
    later = F.explode(F.sequence(F.lit(0), F.lit(days))).alias("later")
    other = each.select(F.col("topic").alias("t"), F.col("day").alias("other_day"), F.col("unit_of").alias("u"), F.col("band").alias("other_band"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    near = each.select("*", later).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).where("later > 0 or step > 0")
    met = near.join(other, (F.col("topic") == F.col("t")) & (F.col("unit_of") == F.col("u")) & (F.date_add("day", F.col("later")) == F.col("other_day")) & (F.col("band") + F.col("step") == F.col("other_band")))
    # Of two bands next to each other, the greatest below and the least above are nearest.
    mine_below = F.abs("band") < F.abs("other_band")
    below, above = F.when(mine_below, F.col("high")).otherwise(F.col("other_high")), F.when(mine_below, F.col("other_low")).otherwise(F.col("low"))
    alike = (F.col("step") == 0) | ((F.col("band") != 0) & (F.col("other_band") != 0) & ((above - below) / above <= DIVERGENCE))
    same = met.where(alike).select("topic", "day", "unit_of", "band", "other_day", F.col("u").alias("other_unit"), "other_band")
    kinds = each.select("topic", "day", "unit_of").distinct()
    others = kinds.select(F.col("topic").alias("t"), F.col("day").alias("other_day"), F.col("unit_of").alias("other_unit"))
    mixed = kinds.select("*", later).join(others, (F.col("topic") == F.col("t")) & (F.date_add("day", F.col("later")) == F.col("other_day")))
    mixed = mixed.where("unit_of <> other_unit and (later > 0 or unit_of < other_unit)")
    none = F.lit(None).cast("int")
    return same.unionByName(mixed.select("topic", "day", "unit_of", none.alias("band"), "other_day", "other_unit", none.alias("other_band")))


def _node(day: str, unit: str, band: Column | str) -> Column:
    return F.concat_ws("\x1e", "topic", F.col(day).cast("string"), F.col(unit), F.coalesce((F.col(band) if isinstance(band, str) else band).cast("string"), F.lit("*")))


def event_instances(events: DataFrame, keys: Sequence[str] = TOPIC, unit: Column | None = None, value: Column | None = None, days: int = DAYS, tie: str = "event_id") -> DataFrame:
    """events (with published_at) with cluster: the number, from 1 in time, of their occurrence in their
    topic. Sizes are those that the clauses state, unless unit and value are given. Occurrences that begin at the same time
    go by their least `tie`; events without a time are an occurrence of their topic; null keys are a topic."""
    found = magnitude(F.col("clause")) if unit is None else None
    celled = cells(events, keys, found["unit"] if unit is None else unit, found["value"] if unit is None else value)
    linked = stored(links(celled, days), "links")
    # Where units meet, all cells of each are joined through one node for the unit.
    hubs = linked.where("band is null")
    met = hubs.select("topic", "day", "unit_of").union(hubs.select("topic", "other_day", "other_unit")).distinct()
    own = celled.select("topic", "day", "unit_of", "band").distinct().join(met, ["topic", "day", "unit_of"])
    edges = linked.select(_node("day", "unit_of", "band").alias("src"), _node("other_day", "other_unit", "other_band").alias("dst"))
    edges = edges.union(own.select(_node("day", "unit_of", "band"), _node("day", "unit_of", F.lit(None))))
    joined = connected_components(edges).select(F.col("node").alias("__node"), "component")
    told = celled.withColumn("__cell", _node("day", "unit_of", "band"))
    told = told.join(joined, told["__cell"] == joined["__node"], "left").withColumn("__of", F.coalesce("component", "__cell"))
    first = told.groupBy("topic", "__of").agg(F.min(F.struct("published_at", tie)).alias("first"))
    number = F.row_number().over(Window.partitionBy("topic").orderBy("first"))
    numbered = first.select(F.col("topic").alias("__t"), F.col("__of").alias("__c"), number.alias("cluster"))
    out = told.join(numbered, (told["topic"] == numbered["__t"]) & (told["__of"] == numbered["__c"]))
    return out.select(*[F.col(f"`{c}`") for c in events.columns], "cluster")
