"""From clauses to a timeline, magnitudes, narratives and their contradictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import RELIABILITY

# Patterns of magnitudes, best unit first, and anchors (size, score) between which scores run straight.
PERCENT, BPS = r"(?i)(-?\d+(?:\.\d+)?)\s*(?:percent|%)", r"(?i)(-?\d+(?:\.\d+)?)\s*(?:bps|basis points?)"
DOLLAR = r"(?i)\$\s?(\d+(?:\.\d+)?)\s*(billion|million|bn|mn|b|m)\b"
ANCHORS = {"PERCENT": ((0.0, 0.0), (5.0, 0.3), (15.0, 0.6), (30.0, 1.0)), "BPS": ((0.0, 0.0), (50.0, 0.3), (150.0, 0.6), (300.0, 1.0))}
DIRECTION_ONLY = 0.5
RECENT_DAYS, EARLIER_DAYS = 7, 14


def timeline_events(clauses: DataFrame, event_types: Mapping[str, str], least: int = 25) -> DataFrame:
    """Clauses (with area, sentiment, evidence_type, source_type, reliability) as events: short ones and news without an
    area go; event_id, event_type, confidence and materiality are added."""
    named = F.create_map(*[F.lit(x) for kv in event_types.items() for x in kv])
    filing = F.col("source_type") == "filing"
    rows = clauses.where((F.length("clause") >= least) & (filing | F.col("area").isNotNull()))
    kind = F.coalesce(named[F.col("area")], F.when(filing, "PERIODIC_FILING").otherwise("GENERAL_NEWS"))
    sure = F.when(F.col("evidence_type") == "FACT", "HIGH").when(F.col("evidence_type") == "SPECULATION", "LOW").when(F.col("reliability") == "PRIMARY", "HIGH").when(F.col("reliability") == "SECONDARY", "MEDIUM").otherwise("LOW")
    key = F.concat_ws(":", F.col("source_id").cast("string"), F.col("clause_index").cast("string"))
    rows = rows.withColumns({"event_id": F.substring(F.sha2(key.cast("binary"), 256), 1, 16), "event_type": kind, "confidence": sure})
    return rows.withColumn("materiality", F.when(filing, "HIGH").when(F.col("event_type") == "GENERAL_NEWS", "LOW").otherwise("MEDIUM"))


def _anchored(x: Column, anchors: Sequence[tuple[float, float]]) -> Column:
    case = F
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        case = case.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.round(case.otherwise(anchors[-1][1]), 2)


def magnitude(text: Column) -> Column:
    """Struct of unit, value (as written; dollars in full) and score (null for dollars): the first percent figure, else
    the first of basis points, else of dollars; null where there is none."""
    low = F.lower(text)
    # Most texts lack what a unit is written with, which a plain search tells without the pattern.
    written = {PERCENT: F.contains(low, F.lit("percent")) | F.contains(low, F.lit("%")), BPS: F.contains(low, F.lit("bps")) | F.contains(low, F.lit("basis point")), DOLLAR: F.contains(low, F.lit("$"))}
    large = F.when(F.lower(F.regexp_extract(text, DOLLAR, 2)).isin("billion", "bn", "b"), 1e9).otherwise(1e6)
    number = lambda p: F.when(written[p], F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double"))
    read = F.struct(number(PERCENT).alias("percent"), number(BPS).alias("bps"), (number(DOLLAR) * large).alias("dollar"))

    def told(m: Column) -> Column:
        unit = F.when(m["percent"].isNotNull(), "PERCENT").when(m["bps"].isNotNull(), "BPS").when(m["dollar"].isNotNull(), "USD")
        score = F.when(m["percent"].isNotNull(), _anchored(F.abs(m["percent"]), ANCHORS["PERCENT"])).when(m["bps"].isNotNull(), _anchored(F.abs(m["bps"]), ANCHORS["BPS"]))
        return F.when(unit.isNotNull(), F.struct(unit.alias("unit"), F.coalesce(m["percent"], m["bps"], m["dollar"]).alias("value"), score.alias("score")))

    # As an element of an array the numbers are read once, however often they are named.
    return F.get(F.transform(F.array(read), told), F.lit(0))


def clause_score(found: Column, sentiment: Column) -> Column:
    """Signed score: the magnitude's with the sign it was written with, else with that of the sentiment; without a
    scored magnitude the sentiment's sign times one half; null without a sign."""
    way = F.when(sentiment == "POSITIVE", 1.0).when(sentiment == "NEGATIVE", -1.0)
    return F.coalesce(F.when(found["value"] < 0, -1.0).otherwise(way) * found["score"], way * DIRECTION_ONLY)


def event_weight(age_days: Column, materiality: Column, confirmation: Column, half_life: float = 7.0, floor: float = 0.3) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life) * materiality * (floor + (1 - floor) * confirmation)


def _dominant(p: Column, n: Column, m: Column) -> Column:
    """The most frequent polarity; MIXED where all that occur are equally frequent; NEUTRAL where none does."""
    most = F.greatest(p, n, m)
    kinds = (p > 0).cast("int") + (n > 0).cast("int") + (m > 0).cast("int")
    tied = (kinds > 1) & ((p == 0) | (p == most)) & ((n == 0) | (n == most)) & ((m == 0) | (m == most))
    return F.when(most == 0, "NEUTRAL").when(tied, "MIXED").when(p == most, "POSITIVE").when(n == most, "NEGATIVE").otherwise("MIXED")


def narratives(events: DataFrame, now: Column, keys: Sequence[str] = ("entity", "event_type", "area")) -> DataFrame:
    """One row per narrative: sentiment, supporting and contradicting counts with the first event of each side, dates,
    sources, quality, confidence, and trend of the last week against the two before. All partial aggregates: a story that
    everybody tells is one row per task before the shuffle."""
    at, s = F.col("published_at"), F.col("sentiment")
    week, month = now - F.expr(f"interval {RECENT_DAYS} days"), now - F.expr(f"interval {RECENT_DAYS + EARLIER_DAYS} days")
    spans = {"": F.lit(True), "recent_": (at >= week) & (at <= now), "earlier_": (at >= month) & (at <= week)}
    counts = [F.count(F.when(span & (s == kind), 1)).alias(f"{p}{kind.lower()}") for p, span in spans.items() for kind in ("POSITIVE", "NEGATIVE", "MIXED")]
    totals = [F.count(F.when(span, 1)).alias(f"{p}n") for p, span in spans.items()]
    rank = F.array_position(F.array(*[F.lit(r) for r in RELIABILITY]), F.col("reliability"))
    first = lambda negative: F.min(F.when((s == "NEGATIVE") == F.lit(negative), F.struct("published_at", "event_id")))["event_id"]
    out = events.groupBy(*keys).agg(*counts, *totals, F.min(at).alias("first_observed"), F.max(at).alias("latest_update"), F.countDistinct(F.coalesce("duplicate_of", "source_id")).alias("independent_sources"), F.min(F.when(rank > 0, rank)).alias("best"), first(False).alias("first_other"), first(True).alias("first_negative"))
    c = F.col
    out = out.withColumns({f"{p}dominant": _dominant(c(f"{p}positive"), c(f"{p}negative"), c(f"{p}mixed")) for p in spans})
    turned = (c("recent_dominant") != c("earlier_dominant")) & (c("recent_dominant") != "NEUTRAL") & (c("earlier_dominant") != "NEUTRAL")
    trend = F.when((c("earlier_n") == 0) & (c("recent_n") > 0), "EMERGING").when((c("recent_n") == 0) & (c("earlier_n") > 0), "FADING").when((c("recent_n") == 0) & (c("earlier_n") == 0), "STABLE")
    trend = trend.when(c("recent_dominant") == "MIXED", "DISPUTED").when(turned, F.when(c("recent_n") > c("earlier_n"), "STRENGTHENING").otherwise("WEAKENING"))
    trend = trend.when(c("recent_n") > c("earlier_n") * 1.3, "STRENGTHENING").when(c("recent_n") < c("earlier_n") * 0.7, "WEAKENING").otherwise("STABLE")
    negative, other = c("negative"), c("n") - c("negative")
    lead = c("dominant") == "NEGATIVE"
    sure = F.when((c("independent_sources") >= 3) & (c("best") <= 2), "HIGH").when(c("independent_sources") >= 2, "MEDIUM").otherwise("LOW")
    return out.select(*keys, c("dominant").alias("sentiment"), F.when(lead, negative).otherwise(other).alias("supporting"), F.when(lead, other).otherwise(negative).alias("contradicting"), F.when(lead, c("first_negative")).otherwise(c("first_other")).alias("side_a"), F.when(lead, c("first_other")).otherwise(c("first_negative")).alias("side_b"), "first_observed", "latest_update", c("n").alias("source_count"), "independent_sources", F.coalesce(F.get(F.array(*[F.lit(r) for r in RELIABILITY]), (c("best") - 1).cast("int")), F.lit("MIXED")).alias("source_quality"), sure.alias("confidence"), trend.alias("trend"))


def contradictions(found: DataFrame) -> DataFrame:
    """Narratives with events on both sides, and the first of each."""
    return found.where("side_a is not null and side_b is not null")
