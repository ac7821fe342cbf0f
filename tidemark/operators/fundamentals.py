"""Reported figures: one series per entity and concept, the latest values, and growth over the year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMS = ("10-K", "10-Q")


def plausible(start: Column, end: Column) -> Column:
    """A quarter, a year, or a value at a date; cumulative periods between are not."""
    days = F.datediff(end, start)
    return start.isNull() | days.between(80, 100) | days.between(350, 380)


def series(facts: DataFrame, tags: Mapping[str, Sequence[str]], forms: Sequence[str] = FORMS) -> DataFrame:
    """facts(entity, tag, start, end, val, form, filed) as (entity, concept, tag, start, end, val): the value filed last of
    each period, from the concept's tag with the most recent period, the earlier-named one on ties."""
    listed = [(tag, concept, place) for concept, names in tags.items() for place, tag in enumerate(names)]
    names = F.create_map(*[x for tag, concept, place in listed for x in (F.lit(tag), F.struct(F.lit(concept).alias("concept"), F.lit(place).alias("place")))])
    rows = facts.where(F.col("form").isin(*forms) & plausible(F.col("start"), F.col("end"))).withColumn("of", names[F.col("tag")]).where("of is not null")
    rows = rows.select("entity", "of.concept", "of.place", "tag", "start", "end", "val", "filed")
    last = rows.groupBy("entity", "concept", "place", "tag", "start", "end").agg(F.max_by("val", F.struct("filed", "val")).alias("val"))
    by = Window.partitionBy("entity", "concept")
    recent = last.withColumn("reach", F.max("end").over(Window.partitionBy("entity", "concept", "tag")))
    best = F.max(F.struct("reach", -F.col("place"))).over(by)
    return recent.withColumn("best", best).where("best.reach = reach and best.col2 = -place").select("entity", "concept", "tag", "start", "end", "val")


def latest(found: DataFrame) -> DataFrame:
    """The latest value of each concept, and free cash flow where operating cash flow and spending end on one day."""
    rows = found.groupBy("entity", "concept").agg(F.max_by(F.struct("start", "end", "val"), F.struct("end", "start")).alias("x")).select("entity", "concept", "x.*")
    part = lambda concept: F.max(F.when(F.col("concept") == concept, F.struct("end", "val")))
    flow = rows.groupBy("entity").agg(part("OperatingCashFlow").alias("ocf"), part("CapitalExpenditure").alias("capex"))
    flow = flow.where("ocf.end = capex.end").select("entity", F.lit("FreeCashFlow").alias("concept"), F.lit(None).cast("date").alias("start"), F.col("ocf.end").alias("end"), (F.col("ocf.val") - F.col("capex.val")).alias("val"))
    return rows.unionByName(flow)


def yoy_growth(found: DataFrame) -> DataFrame:
    """Growth of each concept's latest value over the period of like length that ended 350 to 380 days before."""
    by = Window.partitionBy("entity", "concept").orderBy(F.col("end").desc(), F.col("start").desc())
    head = F.first(F.struct("start", "end", "val")).over(by)
    rows = found.withColumn("head", head)
    gap = F.datediff("head.end", "end")
    like = F.col("head.start").isNull() | (F.abs(F.datediff("head.end", "head.start") - F.datediff("end", "start")) <= 15)
    prior = F.max(F.when(gap.between(350, 380) & like, F.struct("end", "start", "val")))
    out = rows.groupBy("entity", "concept").agg(F.first("head").alias("head"), prior.alias("prior"))
    growth = F.when(F.col("prior.val") != 0, (F.col("head.val") - F.col("prior.val")) / F.abs("prior.val"))
    return out.select("entity", "concept", F.col("head.end").alias("end"), F.col("head.val").alias("val"), F.col("prior.val").alias("prior_val"), growth.alias("growth"))


def direction(growth: DataFrame) -> DataFrame:
    """POSITIVE, NEGATIVE, MIXED or UNKNOWN per entity, by which statements its figures bear out."""
    g = {c: F.max(F.when(F.col("concept") == c, F.col("growth"))).alias(c) for c in ("Revenues", "OperatingCashFlow", "CapitalExpenditure", "NetIncomeLoss")}
    rows = growth.groupBy("entity").agg(*g.values())
    revenue, cash, spent, net = (F.col(c) for c in g)
    base = F.coalesce(revenue, F.lit(0.0))
    # Every statement about net income or cash speaks of growth, whatever its sign.
    grew = (revenue > 0) | (cash.isNotNull() & spent.isNotNull()) | (F.abs(net - revenue) > 0.05)
    fell = revenue <= 0
    grew, fell = F.coalesce(grew, F.lit(False)), F.coalesce(fell, F.lit(False))
    diluted = F.coalesce((cash < base) & (spent > base), F.lit(False))
    out = F.when(grew & fell, "MIXED").when(grew, "POSITIVE").when(fell, "NEGATIVE").otherwise("UNKNOWN")
    return rows.select("entity", out.alias("direction"), diluted.alias("cash_flow_diluted"))
