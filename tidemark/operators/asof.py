"""Point-in-time joins: the last close on or before a time, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_close(requests: DataFrame, bars: DataFrame, at: str, out: str = "price") -> DataFrame:
    """requests(entity, ...) with the entity's last close on or before column `at`; null if there is none.

    Each time asked for of an entity is looked up once, however many requests have it, and met by equality, no range join.
    Times and bars are put together by day: the last close is carried on within each day, and over one row per day from
    day to day, so no task holds an entity's requests. A null time or entity finds nothing.
    """
    asked = requests.select(F.col("entity").alias("__entity"), F.col(at).alias("__ts")).where("__entity is not null and __ts is not null").distinct()
    asked = asked.withColumns({"__kind": F.lit(1), "__close": F.lit(None).cast("double")})
    known = bars.select(F.col("entity").alias("__entity"), F.col("ts").alias("__ts"), F.lit(0).alias("__kind"), F.col("close").alias("__close"))
    day = Window.partitionBy("__entity", "__day").orderBy("__ts", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    points = asked.unionByName(known).withColumn("__day", F.to_date("__ts")).withColumn("__last", F.last("__close", ignorenulls=True).over(day))
    days = points.groupBy("__entity", "__day").agg(F.max_by("__last", F.struct("__ts", "__kind")).alias("__last"))
    earlier = Window.partitionBy("__entity").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("__entity", "__day", F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    found = points.where("__kind = 1").join(days, ["__entity", "__day"]).select("__entity", "__ts", F.coalesce("__last", "__before").alias(out))
    return requests.join(found, (requests["entity"] == found["__entity"]) & (requests[at] == found["__ts"]), "left").drop("__entity", "__ts")


def with_prices(requests: DataFrame, bars: DataFrame, offsets: Sequence[int], time_col: str, prefix: str) -> DataFrame:
    """requests with a column per offset of the as-of close so many days from their time, p for days after and m for days
    before: prefix_p5, prefix_m20. Each time of an entity is looked up once at all offsets, and met by equality."""
    name = lambda o: f"{prefix}_{'m' if o < 0 else 'p'}{abs(o)}"
    times = requests.select(F.col("entity"), F.col(time_col).alias("__time")).where("entity is not null and __time is not null").distinct()
    asked = times.withColumn("__offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("__at", F.col("__time") + F.make_interval(days=F.col("__offset")))
    wide = asof_close(asked, bars, "__at", "__price").groupBy(F.col("entity").alias("__of"), "__time").agg(*[F.max(F.when(F.col("__offset") == o, F.col("__price"))).alias(name(o)) for o in offsets])
    return requests.join(wide, (requests["entity"] == wide["__of"]) & (requests[time_col] == wide["__time"]), "left").drop("__of", "__time")


def with_market(events: DataFrame, bench: DataFrame, offsets: Sequence[int], time_col: str = "published_at") -> DataFrame:
    """events with a column per offset of the benchmark's as-of price. Prices are looked up once for each day that has
    events, a table as small as the calendar, and meet the events by equality of day: however many events there are, only
    days stand in the benchmark's window. The benchmark has daily bars."""
    day = F.date_trunc("day", F.col(time_col))
    days = events.select(day.alias("__day")).where("__day is not null").distinct().withColumn("entity", F.lit("ALL"))
    prices = with_prices(days, bench, offsets, "__day", "b").drop("entity")
    return events.join(prices, day == prices["__day"], "left").drop("__day")


def growth(start: Column, end: Column) -> Column:
    return F.when(start > 0, end / start - 1)


def abnormal_returns(events: DataFrame, bars: DataFrame, bench: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """events x horizons with entity_return, bench_return, realized (their difference) and outcome_status."""
    offsets = [0, *horizons]
    rows = with_market(with_prices(events, bars, offsets, "published_at", "e"), bench, offsets)
    each = F.array(*[F.struct(F.lit(h).alias("horizon_days"), growth(F.col("e_p0"), F.col(f"e_p{h}")).alias("entity_return"), growth(F.col("b_p0"), F.col(f"b_p{h}")).alias("bench_return")) for h in horizons])
    out = rows.withColumn("h", F.explode(each)).select(*events.columns, "h.*").withColumn("realized", F.col("entity_return") - F.col("bench_return"))
    return out.withColumn("outcome_status", F.when(F.col("realized").isNull(), "INSUFFICIENT_DATA").otherwise("OK"))


def regime(start: Column, end: Column) -> Column:
    """The market's state from its return over 60 days. Fixed values: -0.10 and 0.10."""
    r = growth(start, end)
    return F.when(r.isNull(), "UNKNOWN").when(r < -0.10, "RISK_OFF").when(r > 0.10, "RISK_ON").otherwise("NORMAL")


def bins(value: Column, edges: Sequence[tuple[float, float, str]]) -> Column:
    """The label of the half-open bin, or UNKNOWN."""
    out = F.lit("UNKNOWN")
    for low, high, label in edges:
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return F.when(value.isNull(), "UNKNOWN").otherwise(out)


# Bins of prior returns and of volatility.
PRIOR_RETURN_BINS = ((-1.0, -0.08, "LARGE_DECLINE"), (-0.08, -0.02, "MILD_DECLINE"), (-0.02, 0.02, "FLAT"), (0.02, 0.08, "MILD_GAIN"), (0.08, 1.0, "LARGE_GAIN"))
VOLATILITY_BINS = ((0.0, 0.015, "LOW_VOL"), (0.015, 0.035, "NORMAL_VOL"), (0.035, 10.0, "HIGH_VOL"))
