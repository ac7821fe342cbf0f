"""Trades: decisions, the price paths that they meet, and how sure their results are."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cost of a round trip, and the multiple of it that an effect must reach.
COST, MARGIN = 0.001, 2.0
DAY = 86400


def trade_paths(trades: DataFrame, bars: DataFrame, id_cols: Sequence[str], entry: str = "published_at", horizon: str = "horizon_days", longest: int = 60) -> DataFrame:
    """Bars of each trade from its entry to entry + horizon. Both sides are placed in spans of `longest` days, so that
    the join is one of equal keys and a trade stands in as many spans as its horizon touches."""
    span = longest * DAY
    start, end = F.col(entry).cast("long"), F.col(entry).cast("long") + F.col(horizon) * DAY
    placed = trades.withColumn("__start", start).withColumn("__end", end).withColumn("__span", F.explode(F.sequence(F.floor(start / span), F.floor(end / span))))
    priced = bars.select(F.col("entity"), F.floor(F.col("ts").cast("long") / span).alias("__span"), "ts", "open", "high", "low", "close")
    inside = (F.col("ts").cast("long") >= F.col("__start")) & (F.col("ts").cast("long") <= F.col("__end"))
    return placed.join(priced, ["entity", "__span"]).where(inside).drop("__span", "__start", "__end")


def trade_outcomes(paths: DataFrame, id_cols: Sequence[str], action: str = "action", level: str = "invalidation_level") -> DataFrame:
    """Per trade of at least two bars: entry and exit price, returns, best and worst excursion, first bar beyond the
    invalidation level. A path is as long as its horizon at most, so it fits an array."""
    bar = F.struct("ts", "high", "low", "close")
    rows = paths.groupBy(*id_cols).agg(F.first(action).alias("action"), F.first(level).alias("level"), F.array_sort(F.collect_list(bar)).alias("path"))
    rows = rows.where(F.size("path") >= 2).withColumn("entry_price", F.col("path")[0]["close"]).withColumn("exit_price", F.element_at("path", -1)["close"]).where("entry_price > 0")
    long = F.col("action") == "LONG"
    worst = lambda b: F.when(long, b["low"] / F.col("entry_price") - 1).otherwise(1 - b["high"] / F.col("entry_price"))
    best = lambda b: F.when(long, b["high"] / F.col("entry_price") - 1).otherwise(1 - b["low"] / F.col("entry_price"))
    beyond = F.array_position(F.transform("path", lambda b: F.coalesce(worst(b) <= F.col("level"), F.lit(False))), True)
    raw = F.col("exit_price") / F.col("entry_price") - 1
    return rows.withColumns({"raw_return": raw, "realized_return": F.when(long, raw).otherwise(-raw), "mfe": F.array_max(F.transform("path", best)), "mae": F.array_min(F.transform("path", worst)), "invalidation_day": F.when(beyond > 0, beyond - 1), "holding_days": F.datediff(F.element_at("path", -1)["ts"], F.col("path")[0]["ts"])}).drop("path", "level")


def strategy_report(outcomes: DataFrame, keys: Sequence[str], cost: float = COST) -> DataFrame:
    """Per group of at least two trades: expectancy and win rate after costs, profit factor (trades that gain nothing are
    losses; null where nothing was lost), Sortino ratio over all trades, mean best and worst excursion."""
    net = F.col("realized_return") - cost
    out = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.avg(net).alias("expectancy"), F.avg((net > 0).cast("double")).alias("win_rate"), F.sum(F.when(net > 0, net)).alias("__won"), F.sum(F.when(net <= 0, net)).alias("__lost"), F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), F.lit(2.0)))).alias("__down"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))
    out = out.where("n_trades >= 2").withColumns({"profit_factor": F.when(F.col("__lost") < 0, F.col("__won") / F.abs("__lost")), "sortino_per_trade": F.when(F.col("__down") > 0, F.col("expectancy") / F.col("__down"))})
    return out.drop("__won", "__lost", "__down")


def decide(rows: DataFrame, effect: str, low: str, high: str, margin: Column | float = MARGIN, cost: float = COST) -> DataFrame:
    """rows with action and abstain_reason: no effect without evidence, none whose interval holds zero, none below the
    margin of costs; then by sign."""
    margin = F.lit(margin) if isinstance(margin, float) else margin
    spans = (F.col(low) <= 0) & (F.col(high) >= 0)
    reason = F.when(F.col("status") != "CONFIRMED", "HYPOTHESIS_ONLY").when(spans, "CI_SPANS_ZERO").when(F.col(effect).isNull() | (F.abs(effect) < margin * cost), "BELOW_COST_MARGIN")
    return rows.withColumn("abstain_reason", reason).withColumn("action", F.when(reason.isNotNull(), "ABSTAIN").when(F.col(effect) > 0, "LONG").otherwise("SHORT"))


def draw(*parts) -> Column:
    """32 bits of md5 over the parts: the same draws in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


#: Chances that a row is drawn at most 0, 1, 2 ... times in a resample: Poisson with mean 1.
_AT_MOST = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
#: Rows whose draws are made at once, and the most groups whose sums a task holds before it hands them on.
_ROWS, _GROUPS = 128, 512


def _draws(rows: np.ndarray, replicates: int) -> np.ndarray:
    """How many times each row (a 64-bit number of its own) is in each resample: the number and that of the replicate are
    mixed to 64 even bits, and counted against the chances."""
    x = rows.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    times = np.zeros(x.shape, np.uint8)
    for chance in _AT_MOST:
        if int(chance * 2.0**64) < 2**64:
            times += x >= np.uint64(int(chance * 2.0**64))
    return times


def _resampled(batches: Iterable[pa.RecordBatch], replicates: int, n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, value, number of the row) to a row per group: keys, sums of drawn values and of draws by replicate."""
    held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def handed(types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([g[i] for g in held], t) for i, t in enumerate(types)]
        sums, draws = (pa.array([x[i] for x in held.values()]) for i in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([*columns, sums, draws], [f"__k{i}" for i in range(n_keys)] + ["__sums", "__draws"])

    types = []
    for batch in batches:
        types = [batch.column(i).type for i in range(n_keys)]
        value, row = (batch.column(n_keys + i).to_numpy(zero_copy_only=False) for i in range(2))
        places: dict[tuple, list[int]] = {}
        for place, group in enumerate(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]) if n_keys else [()] * len(row)):
            places.setdefault(group, []).append(place)
        for group, part in places.items():
            if group not in held and len(held) >= _GROUPS:
                yield handed(types)
            sums, draws = held.setdefault(group, (np.zeros(replicates), np.zeros(replicates, np.int64)))
            for at in range(0, len(part), _ROWS):
                some = part[at : at + _ROWS]
                times = _draws(row[some], replicates)
                # No matrix product: its threads would compete with the other tasks.
                sums += np.einsum("i,ij->j", value[some], times)
                draws += times.sum(0, dtype=np.int64)
    if held:
        yield handed(types)


def bootstrap_means(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], replicates: int = 2000, seed: int = 20240601) -> DataFrame:
    """Means of each group's resamples with replacement: (keys, replicate, mean). Each row draws how many times it is in a
    resample, Poisson with mean 1, from the seed, its keys and `order` columns, and the replicate. Draws are made in blocks
    of rows and added up within each task, so that only a row per task and group goes on, with its sums by replicate,
    whatever a group's size. A resample without rows has no mean."""
    names = [f"__k{i}" for i in range(len(keys))]
    drawn = rows.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__value"), F.xxhash64(F.lit(seed), *keys, *order).alias("__row"))
    out = ", ".join([*[f"{n} {drawn.schema[n].dataType.simpleString()}" for n in names], "__sums array<double>, __draws array<bigint>"])
    # Spread evenly, as the draws are the work.
    spread = drawn.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__row")
    parts = spread.mapInArrow(lambda batches: _resampled(batches, replicates, len(names)), out)
    each = parts.select(*names, F.posexplode(F.arrays_zip("__sums", "__draws")).alias("replicate", "__x"))
    sums = each.groupBy(*names, "replicate").agg(F.sum("__x.__sums").alias("__sum"), F.sum("__x.__draws").alias("__n"))
    return sums.where("__n > 0").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "replicate", (F.col("__sum") / F.col("__n")).alias("mean"))


def bootstrap_interval(means: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    edge = (1 - level) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", edge).alias("ci_low"), F.percentile("mean", 1 - edge).alias("ci_high"), F.count(F.lit(1)).alias("replicates"))


def permutation_p(pool: DataFrame, keys: Sequence[str], value: str, picked: str, row_id: str, replicates: int = 2000, seed: int = 20240601) -> DataFrame:
    """Per group: the share of same-size draws from the group's pool, without replacement, whose mean is at least as far
    from the pool's mean as that of the picked rows. A draw is the rows of least hash in its replicate."""
    by = Window.partitionBy(*keys)
    rows = pool.where(F.col(value).isNotNull()).withColumn("__k", F.count(F.when(F.col(picked), 1)).over(by)).withColumn("__mean", F.avg(value).over(by)).withColumn("__n", F.count(F.lit(1)).over(by))
    real = rows.groupBy(*keys).agg(F.first("__k").alias("n"), F.first("__mean").alias("pool_mean"), F.abs(F.avg(F.when(F.col(picked), F.col(value))) - F.first("__mean")).alias("deviation"))
    many = rows.select(*keys, value, row_id, "__k", "__n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "replicate", row_id), 11) / 2.0**53)
    # Of the k least of n draws, those well below k / n are sure; only the few around it need ranks. The band is missed by
    # one replicate in 10^9.
    at, wide = F.col("__u") * F.col("__n"), 6 * F.sqrt(F.col("__k")) + 20
    sure = many.where(at <= F.col("__k") - wide).groupBy(*keys, "replicate").agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__sure"))
    near = many.where((at > F.col("__k") - wide) & (at <= F.col("__k") + wide))
    near = near.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "replicate").orderBy("__u", row_id))).join(sure, [*keys, "replicate"], "left")
    near = near.where(F.col("__r") <= F.col("__k") - F.coalesce("__sure", F.lit(0)))
    means = near.groupBy(*keys, "replicate").agg(((F.coalesce(F.first("__sum"), F.lit(0.0)) + F.sum(value)) / F.first("__k")).alias("mean"))
    return means.join(real, [*keys]).groupBy(*keys).agg(F.first("n").alias("n"), F.first("deviation").alias("deviation"), F.avg((F.abs(F.col("mean") - F.col("pool_mean")) >= F.col("deviation") - 1e-12).cast("double")).alias("p"))
