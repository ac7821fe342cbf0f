"""Categorical technical states of every daily bar, as windows over (entity, time): one shuffle for all of them.

A state needs its number of bars within the last 320 calendar days, today's included; with fewer it is UNKNOWN. All
thresholds are strict unless said. Bars with null volume count as bars; their volume is left out of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The history that states look back on, and the values that say nothing of note.
HISTORY_DAYS = 320
DEFAULT_VALUES = {
    "trend_direction": ("UNKNOWN", "FLAT"),
    "momentum_state": ("UNKNOWN", "FLAT"),
    "breakout_state": ("UNKNOWN", "NONE"),
    "mean_reversion_state": ("UNKNOWN", "NORMAL"),
    "pullback_state": ("UNKNOWN", "NONE"),
    "volatility_state": ("UNKNOWN", "NORMAL"),
    "relative_volume_state": ("UNKNOWN", "NORMAL_RVOL"),
    "relative_strength_state": ("UNKNOWN", "IN_LINE"),
    "ma_stack": ("UNKNOWN", "MIXED_STACK"),
    "market_structure": ("UNKNOWN", "MIXED"),
    "gap_state": ("UNKNOWN", "NO_GAP"),
    "vwap_state": ("UNKNOWN", "AT_VWAP_PROXY"),
    "support_resistance_state": ("UNKNOWN", "MID_RANGE"),
    "price_action_pattern": ("UNKNOWN", "NONE"),
    "mtf_confirmation": ("UNKNOWN",),
    "clv_state": ("UNKNOWN", "MID_RANGE"),
    "ma_slope_state": ("UNKNOWN", "FLAT"),
    "liquidity_regime": ("UNKNOWN", "NORMAL_LIQUIDITY"),
}


def state(value: Column, up: float, above: str, down: float, below: str, between: str) -> Column:
    """above where value > up, below where value < down, else between; UNKNOWN where value is null."""
    return F.when(value.isNull(), "UNKNOWN").when(value > up, above).when(value < down, below).otherwise(between)


def benchmark_returns(bench: DataFrame, lookback: int = 20) -> DataFrame:
    """(day, bench_return): on each calendar day, the last benchmark bar's return over `lookback` bars."""
    by = Window.orderBy("ts")  # one series, one row a day
    n = F.count(F.lit(1)).over(Window.orderBy(F.col("ts").cast("long")).rangeBetween(-HISTORY_DAYS * 86400, 0))
    back = F.lag("close", lookback).over(by)
    rows = bench.select("ts", F.when(n > lookback, (F.col("close") - back) / back).alias("bench_return"), F.lead("ts").over(by).alias("next"))
    days = F.sequence("ts", F.coalesce(F.col("next") - F.expr("interval 1 day"), F.col("ts")), F.expr("interval 1 day"))
    return rows.select(F.explode(days).alias("day"), "bench_return")


def technical_states(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """bars with the raw values and the eighteen states of each bar."""
    by = Window.partitionBy("entity").orderBy("ts")
    rows = lambda a, b: by.rowsBetween(a, b)
    have = lambda k, value: F.when(F.col("n") >= k, value)
    ratio = lambda a, b: F.when(b != 0, a / b)
    close, high, low, volume = F.col("close"), F.col("high"), F.col("low"), F.col("volume")
    df = bars.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("entity").orderBy(F.col("ts").cast("long")).rangeBetween(-HISTORY_DAYS * 86400, 0)))
    df = df.withColumn("rn", F.row_number().over(by)).withColumn("prev_close", F.lag("close").over(by))
    df = df.withColumns({
        "sma20": F.avg("close").over(rows(-19, 0)), "sma50": F.avg("close").over(rows(-49, 0)), "sma200": F.avg("close").over(rows(-199, 0)),
        "base20": F.lag("close", 20).over(by), "sd20": F.stddev_samp("close").over(rows(-19, 0)),
        "high20": F.max("high").over(rows(-20, -1)), "low20": F.min("low").over(rows(-20, -1)),
        "p_open": F.lag("open").over(by), "p_high": F.lag("high").over(by), "p_low": F.lag("low").over(by),
        "tr": F.greatest(high - low, F.abs(high - F.col("prev_close")), F.abs(low - F.col("prev_close"))),
        "vol20": F.avg("volume").over(rows(-20, -1)),
        "tv20": F.sum(F.when(volume != 0, (high + low + close) / 3 * volume)).over(rows(-19, 0)), "v20": F.sum(F.when(volume != 0, volume)).over(rows(-19, 0)),
        "h1": F.max("high").over(rows(-39, -20)), "l1": F.min("low").over(rows(-39, -20)), "h2": F.max("high").over(rows(-19, 0)), "l2": F.min("low").over(rows(-19, 0)),
        "clv": F.avg(F.when(high > low, ((close - low) - (high - close)) / (high - low))).over(rows(-9, 0)),
        "dv20": F.avg(close * volume).over(rows(-19, 0)), "dv60": F.avg(close * volume).over(rows(-59, 0)),
    })
    weekly = Window.partitionBy("entity", F.col("rn") % 5).orderBy("ts")
    df = df.withColumns({"sma20_then": F.lag("sma20", 10).over(by), "atr5": F.avg("tr").over(rows(-4, 0)), "atr20": F.avg("tr").over(rows(-19, 0)), "w20": F.avg("close").over(weekly.rowsBetween(-19, 0))})
    df = df.withColumn("w20_then", F.lag("w20", 10).over(weekly))

    def trend(enough: Column, average: str, then: str) -> Column:
        slope = F.col(average) - F.col(then)
        return F.when(~enough, "UNKNOWN").when((close > F.col(average)) & (slope > 0), "UP").when((close < F.col(average)) & (slope < 0), "DOWN").otherwise("FLAT")

    df = df.join(benchmark_returns(bench), F.col("ts") == F.col("day"), "left")
    df = df.withColumns({
        "trend_direction": trend(F.col("n") >= 30, "sma20", "sma20_then"), "weekly_trend": trend(F.ceil(F.col("n") / 5) >= 30, "w20", "w20_then"),
        "trend_ma20": have(20, F.col("sma20")), "ma_slope_pct": have(30, ratio(F.col("sma20") - F.col("sma20_then"), F.col("sma20_then"))),
        "momentum_roc_20d": have(21, ratio(close - F.col("base20"), F.col("base20"))), "mean_reversion_zscore": have(20, F.when(F.col("sd20") > 0, (close - F.col("sma20")) / F.col("sd20"))),
        "from_high": have(21, F.when(F.col("high20") > 0, (F.col("high20") - close) / F.col("high20"))), "from_low": have(21, F.when(F.col("low20") > 0, (close - F.col("low20")) / F.col("low20"))),
        "atr_ratio": have(21, F.when(F.col("atr20") > 0, F.col("atr5") / F.col("atr20"))), "relative_volume_raw": have(21, F.when(F.col("vol20") > 0, volume / F.col("vol20"))),
        "vwap_proxy_20d": have(20, F.when(F.col("v20") > 0, F.col("tv20") / F.col("v20"))), "gap_pct": have(2, F.when(F.col("prev_close") > 0, (F.col("open") - F.col("prev_close")) / F.col("prev_close"))),
        "relative_strength_20d": have(21, (close - F.col("base20")) / F.col("base20") - F.col("bench_return")), "clv_raw": have(10, F.col("clv")), "liquidity_ratio": have(60, F.when(F.col("dv60") > 0, F.col("dv20") / F.col("dv60"))),
    })
    c = F.col
    band = lambda x: x.between(0.02, 0.10)
    vwap = F.when(c("vwap_proxy_20d") > 0, (close - c("vwap_proxy_20d")) / c("vwap_proxy_20d"))
    states = {
        "ma_slope_state": state(c("ma_slope_pct"), 0.01, "RISING", -0.01, "FALLING", "FLAT"),
        "momentum_state": state(c("momentum_roc_20d"), 0.02, "POSITIVE", -0.02, "NEGATIVE", "FLAT"),
        "mean_reversion_state": state(c("mean_reversion_zscore"), 2.0, "OVEREXTENDED_HIGH", -2.0, "OVEREXTENDED_LOW", "NORMAL"),
        "breakout_state": F.when(c("n") < 21, "UNKNOWN").when(close > c("high20"), "BREAKOUT_UP").when(close < c("low20"), "BREAKOUT_DOWN").otherwise("NONE"),
        "support_resistance_state": F.when(c("n") < 21, "UNKNOWN").when(c("from_high") <= 0.02, "NEAR_RESISTANCE").when(c("from_low") <= 0.02, "NEAR_SUPPORT").otherwise("MID_RANGE"),
        "pullback_state": F.when((c("n") < 21) | (c("trend_direction") == "UNKNOWN"), "UNKNOWN").when((c("trend_direction") == "UP") & band(c("from_high")), "PULLBACK_IN_UPTREND").when((c("trend_direction") == "DOWN") & band(c("from_low")), "PULLBACK_IN_DOWNTREND").otherwise("NONE"),
        "price_action_pattern": F.when(c("n") < 2, "UNKNOWN").when((high <= c("p_high")) & (low >= c("p_low")), "INSIDE_BAR").when((high >= c("p_high")) & (low <= c("p_low")), "OUTSIDE_BAR").when((close > c("open")) & (c("prev_close") < c("p_open")) & (close >= c("p_open")) & (c("open") <= c("prev_close")), "BULLISH_ENGULFING").when((close < c("open")) & (c("prev_close") > c("p_open")) & (close <= c("p_open")) & (c("open") >= c("prev_close")), "BEARISH_ENGULFING").otherwise("NONE"),
        "volatility_state": state(c("atr_ratio"), 1.3, "EXPANSION", 0.7, "COMPRESSION", "NORMAL"),
        "relative_volume_state": state(c("relative_volume_raw"), 1.5, "HIGH_RVOL", 0.5, "LOW_RVOL", "NORMAL_RVOL"),
        "vwap_state": state(vwap, 0.005, "ABOVE_VWAP_PROXY", -0.005, "BELOW_VWAP_PROXY", "AT_VWAP_PROXY"),
        "ma_stack": F.when(c("n") < 200, "UNKNOWN").when((c("sma20") > c("sma50")) & (c("sma50") > c("sma200")), "BULLISH_STACK").when((c("sma20") < c("sma50")) & (c("sma50") < c("sma200")), "BEARISH_STACK").otherwise("MIXED_STACK"),
        "market_structure": F.when(c("n") < 40, "UNKNOWN").when((c("h2") > c("h1")) & (c("l2") > c("l1")), "HIGHER_HIGHS_HIGHER_LOWS").when((c("h2") < c("h1")) & (c("l2") < c("l1")), "LOWER_HIGHS_LOWER_LOWS").otherwise("MIXED"),
        "gap_state": state(c("gap_pct"), 0.02, "GAP_UP", -0.02, "GAP_DOWN", "NO_GAP"),
        "relative_strength_state": state(c("relative_strength_20d"), 0.02, "OUTPERFORMING", -0.02, "UNDERPERFORMING", "IN_LINE"),
        "clv_state": state(c("clv_raw"), 0.3, "UPPER_RANGE", -0.3, "LOWER_RANGE", "MID_RANGE"),
        "liquidity_regime": state(c("liquidity_ratio"), 1.3, "HIGH_LIQUIDITY", 0.7, "LOW_LIQUIDITY", "NORMAL_LIQUIDITY"),
        "mtf_confirmation": F.when(~c("trend_direction").isin("UP", "DOWN") | ~c("weekly_trend").isin("UP", "DOWN"), "UNKNOWN").when(c("trend_direction") == c("weekly_trend"), "CONFIRMED").otherwise("CONFLICTED"),
    }
    return df.withColumns(states)


def market_scan(states: DataFrame, every: int = 5) -> DataFrame:
    """Every n-th bar of each entity, from its first."""
    return states.where(F.pmod(F.col("rn") - 1, F.lit(every)) == 0)


def interesting_values(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dimension, value) of states that are neither null nor a default of their dimension."""
    long = states.unpivot(keys, list(DEFAULT_VALUES), "dimension", "value")
    defaults = states.sparkSession.createDataFrame([(d, v) for d, vs in DEFAULT_VALUES.items() for v in vs], "dimension string, value string")
    return long.where("value is not null").join(F.broadcast(defaults), ["dimension", "value"], "left_anti")
