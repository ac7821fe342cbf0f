"""What narratives, risks and reported figures say together about a company, and how that became different."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.news_state import rounded

# Areas that figures speak to, risk categories, weights and thresholds of the score.
PERFORMANCE = ("revenue", "earnings", "guidance", "demand", "margins", "cash_flow")
RISK_OF_AREA = {
    "regulatory": "REGULATORY", "geopolitical": "GEOPOLITICAL", "competition": "COMPETITION", "supply_chain": "SUPPLY_CHAIN", "workforce": "EXECUTION", "management": "EXECUTION", "debt": "BALANCE_SHEET",
    "capital_allocation": "BALANCE_SHEET", "cash_flow": "LIQUIDITY", "demand": "BUSINESS", "revenue": "BUSINESS", "margins": "BUSINESS", "earnings": "BUSINESS", "guidance": "BUSINESS", "product": "BUSINESS",
}
DEBT_TO_CASH = 3.0
CONFIDENCE_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
CONFIDENCE_SHARE = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
PENALTY = {"HIGH": -2, "MEDIUM": -1, "LOW": 0}
GRADES = ((8, "FAVORABLE"), (3, "CAUTIOUSLY_FAVORABLE"), (-2, "NEUTRAL"), (-7, "CAUTIOUS"))
IMPACT = {"FAVORABLE": 1.0, "CAUTIOUSLY_FAVORABLE": 0.5, "NEUTRAL": 0.0, "UNCERTAIN": 0.0, "CAUTIOUS": -0.5, "NEGATIVE": -1.0}
NEWS_WEIGHT = 3.0
SURE, LIKELY = 0.7, 0.4
TOPIC = ("entity", "event_type", "area")


def _of(labels: Mapping, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[key], F.lit(default))


def consistency(narratives: DataFrame, direction: DataFrame) -> DataFrame:
    """Narratives with verdict: do the company's figures (entity, direction) bear them out? Where they don't speak to the
    area, or nobody claims anything, the evidence is insufficient."""
    rows = narratives.join(direction.select("entity", "direction"), "entity", "left")
    told, shown = F.col("sentiment"), F.coalesce("direction", F.lit("UNKNOWN"))
    silent = ~F.coalesce(F.col("area").isin(*PERFORMANCE), F.lit(False)) | (shown == "UNKNOWN") | (told == "NEUTRAL")
    return rows.withColumn("verdict", F.when(silent, "INSUFFICIENT_EVIDENCE").when((shown == "MIXED") | (told == "MIXED"), "PARTIALLY_SUPPORTED").when(told == shown, "SUPPORTED").otherwise("CONTRADICTED")).drop("direction")


def risks(narratives: DataFrame, figures: DataFrame) -> DataFrame:
    """Risks (entity, event_type, area, origin, category, status, severity, confidence) from negative narratives (with
    speculative: all of their events are), from contradictions, and from the latest figures (entity, concept, val)."""
    shape = lambda df, origin, category, status, severity, sure: df.select(*TOPIC, F.lit(origin).alias("origin"), category.alias("category"), status.alias("status"), severity.alias("severity"), sure.alias("confidence"))
    growing = F.col("trend").isin("STRENGTHENING", "EMERGING") & (F.col("independent_sources") >= 2)
    severity = F.when(growing, "HIGH").when(F.col("independent_sources") == 1, "LOW").otherwise("MEDIUM")
    status = F.when(F.col("speculative"), "SPECULATIVE").when(F.col("trend") == "EMERGING", "EMERGING").otherwise("KNOWN")
    told = shape(narratives.where("sentiment = 'NEGATIVE'"), "NARRATIVE", _of(RISK_OF_AREA, F.col("area"), "BUSINESS"), status, severity, F.col("confidence"))
    split = shape(narratives.where("side_a is not null and side_b is not null"), "CONTRADICTION", F.lit("NARRATIVE"), F.lit("EMERGING"), F.lit("MEDIUM"), F.lit("LOW"))
    last = lambda concept: F.max(F.when(F.col("concept") == concept, F.col("val")))
    books = figures.groupBy("entity").agg(last("LongTermDebt").alias("debt"), last("CashAndCashEquivalents").alias("cash"), last("FreeCashFlow").alias("fcf")).withColumn("event_type", F.lit(None).cast("string"))
    ratio = F.when(F.col("cash") > 0, F.col("debt") / F.col("cash"))
    lever = shape(books.where(ratio > DEBT_TO_CASH).withColumn("area", F.lit("debt")), "FIGURES", F.lit("BALANCE_SHEET"), F.lit("KNOWN"), F.when(ratio < 2 * DEBT_TO_CASH, "MEDIUM").otherwise("HIGH"), F.lit("HIGH"))
    short = shape(books.where("fcf < 0").withColumn("area", F.lit("cash_flow")), "FIGURES", F.lit("LIQUIDITY"), F.lit("KNOWN"), F.lit("HIGH"), F.lit("HIGH"))
    return told.unionByName(split).unionByName(lever).unionByName(short)


def grade(score: Column, evidence: Column) -> Column:
    case = F.when(~evidence, "INSUFFICIENT_EVIDENCE")
    for least, name in GRADES:
        case = case.when(score >= least, name)
    return case.otherwise("NEGATIVE")


def assess(checked: DataFrame, found: DataFrame) -> DataFrame:
    """Per company: score over narratives (with verdict) and risks, assessment and confidence. Sums of each side are
    joined, never the rows."""
    way = F.when(F.col("sentiment") == "POSITIVE", 1).when(F.col("sentiment") == "NEGATIVE", -1).otherwise(0)
    verdict = F.when(F.col("verdict") == "SUPPORTED", 1).when(F.col("verdict") == "CONTRADICTED", -2).otherwise(0)
    told = checked.groupBy("entity").agg(F.sum(way * _of(CONFIDENCE_WEIGHT, F.col("confidence"), 1) + verdict).alias("told"), F.count(F.lit(1)).alias("n_narratives"), F.least(F.lit(1.0), F.sum("independent_sources") / 10).alias("breadth"), F.avg(_of(CONFIDENCE_SHARE, F.col("confidence"), 0.3)).alias("share"))
    cost = found.groupBy("entity").agg(F.sum(_of(PENALTY, F.col("severity"), 0)).alias("cost"), F.count(F.lit(1)).alias("n_risks"))
    rows = told.join(cost, "entity", "full_outer").fillna(0, ["told", "cost", "n_narratives", "n_risks"])
    rows = rows.withColumn("score", (F.col("told") + F.col("cost")).cast("double"))
    rows = rows.withColumn("assessment", grade(F.col("score"), F.col("n_narratives") + F.col("n_risks") > 0))
    return rows.withColumn("confidence", rounded((F.col("breadth") + F.col("share")) / 2, 2)).drop("told", "cost", "breadth", "share")


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= SURE, "HIGH").when(confidence >= LIKELY, "MEDIUM").otherwise("LOW")


def modes(assessed: DataFrame, news: DataFrame) -> DataFrame:
    """Predictions of three modes per company: A from the assessment, B from its score and the news together, C from the
    news alone (entity, news: mean of the axes, news_confidence). Null impact: no signal."""
    rows = assessed.join(news, "entity", "full_outer").withColumn("score", F.coalesce("score", F.lit(0.0)))
    has = F.coalesce(F.col("n_narratives") + F.col("n_risks") > 0, F.lit(False))
    blended = F.col("score") + F.coalesce(F.col("news") * NEWS_WEIGHT, F.lit(0.0))
    a, b = grade(F.col("score"), has), grade(blended, has | F.col("news").isNotNull())
    c = F.when(F.col("news").isNull(), "NEWS_NO_SIGNAL").when(F.col("news") > 0, "NEWS_ONLY_UP").when(F.col("news") < 0, "NEWS_ONLY_DOWN").otherwise("NEWS_ONLY_FLAT")
    impact = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])
    pick = lambda mode, label, value, sure: F.struct(F.lit(mode).alias("mode"), label.alias("decision"), value.alias("predicted_impact"), F.when(value.isNotNull(), sure).alias("predicted_confidence"))
    each = F.array(pick("A", a, impact[a], F.col("confidence")), pick("B", b, impact[b], F.col("confidence")), pick("C", c, rounded(F.col("news"), 4), F.col("news_confidence")))
    return rows.select("entity", F.inline(each)).withColumn("confidence_bucket", bucket(F.col("predicted_confidence")))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """What differs between two sets of narratives: new ones, and those whose sentiment or trend turned."""
    old = before.select(*[F.col(k).alias(f"__{k}") for k in TOPIC], F.col("sentiment").alias("sentiment_before"), F.col("trend").alias("trend_before"))
    rows = now.join(old, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in TOPIC], "left")
    new = F.col("sentiment_before").isNull()
    kinds = F.array_compact(F.array(F.when(new, "NEW_NARRATIVE"), F.when(~new & (F.col("sentiment") != F.col("sentiment_before")), "SENTIMENT_CHANGE"), F.when(~new & (F.col("trend") != F.col("trend_before")), "TREND_CHANGE")))
    return rows.select(*TOPIC, F.explode(kinds).alias("change"), "sentiment_before", "sentiment", "trend_before", "trend")
