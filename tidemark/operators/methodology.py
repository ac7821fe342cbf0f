"""Which concepts written methodologies speak of: claims by phrases, links of one methodology, methodologies of a concept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import any_word

# Phrases of each concept, regular expressions over lower-case text, between word borders.
CONCEPT_PHRASES: dict[str, tuple[str, ...]] = {
    "TREND": ("trend[- ]?following", "uptrends?", "downtrends?", "moving averages?", "trend template"),
    "MOMENTUM": ("momentum", "rate of change", "accelerating"),
    "MEAN_REVERSION": ("mean reversion", "revert(?:s|ing)? to the average", "oversold", "overbought"),
    "BREAKOUT": ("breakouts?", "breaks? out", "clears? (?:the |a )?(?:prior )?high"),
    "PULLBACK": ("pullbacks?", "pulls? back", "retracements?", "dip buy(?:ing|s)?"),
    "PRICE_ACTION": ("engulfing", "inside bars?", "outside bars?", "candlestick", "price action"),
    "SUPPORT_RESISTANCE": ("support", "resistance", "prior highs?", "prior lows?"),
    "VOLATILITY_COMPRESSION_EXPANSION": ("volatility contraction", "volatility squeeze", "tight(?:ening)? range", "expanding range"),
    "VOLUME": ("volume surge", "heavy volume", "volume spike", "high volume"),
    "RELATIVE_VOLUME": ("relative volume", "volume relative to (?:its )?average"),
    "VWAP": ("vwap", "volume[- ]weighted average price"),
    "MOVING_AVERAGE_STRUCTURE": ("moving average stack", "20.?50.?200", "stage 2"),
    "MARKET_STRUCTURE": ("higher highs", "higher lows", "lower highs", "lower lows", "market structure"),
    "GAPS": ("gaps? up", "gaps? down", "gap and go"),
    "OPENING_RANGE": ("opening range", "first (?:five|5|fifteen|15|thirty|30) minutes", "orb"),
    "RELATIVE_STRENGTH": ("relative strength", "outperform(?:ing|s)? the market", "canslim"),
    "SECTOR_CONTEXT": ("sector rotation", "sector strength", "sector leadership", "industry group"),
    "MULTI_TIMEFRAME_CONFIRMATION": ("multiple time ?frames?", "weekly confirmation", "daily and weekly"),
    "CATALYST_EVENT_REACTION": ("earnings reaction", "catalyst", "news[- ]driven"),
    "RISK_MANAGEMENT": ("stop[- ]loss", "position siz(?:e|ing)", "risk (?:1|one) percent", "risk[:/]reward"),
}


def concept_claims(sources: DataFrame, phrases: Mapping[str, Sequence[str]] = CONCEPT_PHRASES, text_col: str = "body") -> DataFrame:
    """sources with concept and phrase (the concept's first phrase that the text holds): one row per concept a source
    claims, and one with nulls for a source that claims none, null and empty texts included. No shuffle: phrases are part
    of the plan, and a concept's phrases are told apart only where one of them is found."""
    def claim(concept: str, found: Sequence[str]):
        first = F.coalesce(*[F.when(any_word(F.col(f"`{text_col}`"), [p]), p) for p in found])
        return F.when(any_word(F.col(f"`{text_col}`"), found), F.struct(F.lit(concept).alias("concept"), first.alias("phrase")))

    names = [c for c in sources.columns if c not in ("concept", "phrase")]
    claims = F.array_compact(F.array(*[claim(c, p) for c, p in phrases.items()]))
    return sources.select(*[F.col(f"`{c}`") for c in names], F.inline_outer(claims))


def concept_links(claims: DataFrame, source_id: str = "source_id") -> DataFrame:
    """The links alone: source_id, concept, phrase. Sources without a claim have none."""
    return claims.where("concept is not null").select(source_id, "concept", "phrase")


def methodologies_for_concept(sources: DataFrame, links: DataFrame, concept: str, source_id: str = "source_id") -> DataFrame:
    """Each source linked to the concept, with the link's phrase. Filtered before the join, whose way is Spark's choice."""
    return sources.join(links.where(F.col("concept") == concept).select(source_id, "concept", "phrase"), source_id)


def concept_coverage(claims: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Sources per concept; those without a claim under null."""
    return claims.groupBy("concept").agg(F.countDistinct(source_id).alias("n_sources"))
