"""Ranks and running values over groups of any size.

Rows are cut into ranges of (keys, order), so that a group of any size lies in as many ranges as it needs; each range is
ranked or summed up on its own, and what stands before it is added from one row per group and range. The ranges are stored
in the shared folder before they are read again, so both steps see the same cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import stored

_RANGE, _AT = "__range", "__at"


def _cut(df: DataFrame, by: list[Column], label: str) -> DataFrame:
    # Cutting samples its input, so that is written first and not computed twice.
    rows = stored(df, label)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *by).withColumn(_RANGE, F.spark_partition_id()), f"{label}-ranges")


def ranked(df: DataFrame, order: list[Column], out: str = "rank", keys: list[str] = (), label: str = "ranked") -> DataFrame:
    """df with the place of each row, from 1, in the given order, within each group of equal keys. Rows of equal order
    stand together in one range: let the order end in an id. Null keys are a group."""
    rows = _cut(df, [*[F.col(f"`{k}`") for k in keys], *order], label)
    here = [F.col(f"`{k}`") for k in keys]
    sizes = rows.groupBy(_RANGE, *here).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*here).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(_RANGE).alias("of"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_AT))
    match = rows[_RANGE] == offsets["of"]
    for i, k in enumerate(keys):
        match = match & rows[k].eqNullSafe(offsets[f"__k{i}"])
    place = F.row_number().over(Window.partitionBy(_RANGE, *here).orderBy(*order))
    numbered = rows.withColumn("__place", place)
    return numbered.join(offsets, match).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__place") + F.col(_AT)).alias(out))


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    match = F.lit(True)
    for a, b in keys.items():
        match = match & left[a].eqNullSafe(right[b])
    return match


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], maxes: dict[str, Column] = {}, label: str = "running") -> DataFrame:
    """df with running sums of its rows in the given order within each group, and running maxima, whose expressions may
    name the sums. Nulls add nothing. Let the order end in an id, as rows of equal order stand together in one range."""
    here = [F.col(f"`{k}`") for k in keys]
    rows = _cut(df, [*here, *order], label)
    to = Window.partitionBy(_RANGE, *here).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*here).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    by = {_RANGE: "__of"} | {k: f"__k{i}" for i, k in enumerate(keys)}

    def carried(over: DataFrame, parts: dict[str, Column], gather: Callable[[Column], Column], start: float | None) -> DataFrame:
        """One row per range and group: what stands before it."""
        each = over.groupBy(_RANGE, *here).agg(*[gather(c).alias(n) for n, c in parts.items()])
        held = [F.coalesce(gather(F.col(n)).over(before), F.lit(start)).alias(f"__before_{n}") for n in parts]
        return each.select(F.col(_RANGE).alias("__of"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *held)

    if sums:
        held = carried(rows, sums, F.sum, 0.0)
        rows = rows.join(held, same(rows, held, by)).withColumns({n: F.coalesce(F.sum(c).over(to), F.lit(0.0)) + F.col(f"__before_{n}") for n, c in sums.items()}).drop(*held.columns)
    if maxes:
        held = carried(rows, maxes, F.max, None)
        rows = rows.join(held, same(rows, held, by)).withColumns({n: F.greatest(F.max(c).over(to), F.col(f"__before_{n}")) for n, c in maxes.items()}).drop(*held.columns)
    return rows.drop(_RANGE)


def value_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of its value within its group, from 1; equal values share the mean of their ranks, nulls have
    none. Values are counted first, so one that very many rows share is one row. df is read twice and met by value: store
    what could differ in the last digit when computed anew."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(counted, list(keys), [F.col(value)], {"__to": F.col("__n")}, label="ranks")
    placed = placed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), (F.col("__to") - (F.col("__n") - 1) / 2).alias(out))
    match = same(df, placed, {k: f"__k{i}" for i, k in enumerate(keys)}) & (df[value] == placed["__v"])
    return df.join(placed, match, "left").select(*[F.col(f"`{c}`") for c in df.columns], out)


def sums_at(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, __at, n, s, q): number, sum and sum of squares of the known values under the same keys at the same time."""
    v = F.col(value)
    return rows.groupBy(*keys, F.col(at).alias(_AT)).agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"))


def statistics(n: Column, s: Column, q: Column) -> list[Column]:
    """prior_n, prior_mean and prior_sd from such sums. Without spread the deviation is 0; with fewer than two values it is
    null."""
    spread = q - s * s / F.nullif(n, F.lit(0))
    sd = F.when(n > 1, F.sqrt(F.when(spread > 1e-12 * q, spread).otherwise(0.0) / F.nullif(n - 1, F.lit(0))))
    return [n.alias("prior_n"), F.when(n > 0, s / F.nullif(n, F.lit(0))).alias("prior_mean"), F.when(n > 0, sd).alias("prior_sd")]


def known_before(asked: DataFrame, seen: DataFrame, keys: list[str], at: str, value: str, seen_at: str | None = None) -> DataFrame:
    """asked with prior_n, prior_mean and prior_sd of the values of `seen` under the same keys strictly before each row's
    time. Sums by time come first; those of whole days are added up over days, those of a day within it, so no task holds
    a group's rows. The sums can be as many as the rows, and Spark takes them for small, so the joins ask for a merge and
    nothing is broadcast."""
    nothing = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")]
    parts = sums_at(seen, keys, seen_at or at, value)
    parts = parts.unionByName(asked.select(*keys, F.col(at).alias(_AT), *nothing).distinct())
    instants = parts.groupBy(*keys, _AT).agg(*[F.sum(c).alias(c) for c in "nsq"]).withColumn("__day", F.to_date(_AT))
    days = instants.groupBy(*keys, "__day").agg(*[F.sum(c).alias(f"__d{c}") for c in "nsq"])
    over_days = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({f"__d{c}": F.coalesce(F.sum(f"__d{c}").over(over_days), F.lit(0)) for c in "nsq"})
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    days = days.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("__day").alias("__of"), *[f"__d{c}" for c in "nsq"])
    within = Window.partitionBy(*keys, "__day").orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    summed = instants.withColumns({c: F.coalesce(F.sum(c).over(within), F.lit(0)) for c in "nsq"})
    days = days.hint("merge")
    summed = summed.join(days, same(summed, days, names | {"__day": "__of"}))
    known = summed.select(*[F.col(k).alias(m) for k, m in names.items()], F.col(_AT).alias("__of"), *statistics(*[F.col(c) + F.col(f"__d{c}") for c in "nsq"]))
    known = known.hint("merge")
    return asked.join(known, same(asked, known, names | {at: "__of"})).select(*[F.col(f"`{c}`") for c in asked.columns], "prior_n", "prior_mean", "prior_sd")
