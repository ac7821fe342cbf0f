"""Predictions resolved as their outcomes come due, and news states that decay, as streams.

A state is a pair of sums, which decay alike; a late event is added with the decay that it would have by now. So a state is
that of all events seen, in whatever order and batches they came, and equals the batch result over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import asof

# Fixed value: days in which a news event loses half its weight.
HALF_LIFE = 7.0
MONTH = "due_month"
_OUT = "entity string, as_of timestamp, mean double, weight double, n_events long, delta double"
_HELD = "as_of double, value double, weight double, n_events long, mean double"


def abnormal_outcomes(due: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """due (entity, published_at, horizon_days and whatever else) with due_at, realized (the entity's return less the
    benchmark's over the horizon) and outcome_status."""
    rows = due.withColumn("due_at", F.col("published_at") + F.make_interval(days=F.col("horizon_days")))
    rows = asof.asof_close(asof.asof_close(rows, bars, "published_at", "__p0"), bars, "due_at", "__p1")
    rows = asof.with_market(rows, bench, (0,)).withColumnRenamed("b_p0", "__m0")
    rows = asof.with_market(rows, bench, (0,), "due_at").withColumnRenamed("b_p0", "__m1")
    realized = asof.growth(F.col("__p0"), F.col("__p1")) - asof.growth(F.col("__m0"), F.col("__m1"))
    out = rows.withColumn("realized", realized).drop("__p0", "__p1", "__m0", "__m1")
    return out.withColumn("outcome_status", F.when(F.col("realized").isNull(), "INSUFFICIENT_DATA").otherwise("OK"))


def resolving_returns(due: DataFrame, path: str, keys: list[str], bars: DataFrame, bench: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the outcomes of matured predictions to a table by month, each key once. What the table has is
    taken off a batch first, so a batch that is run again adds nothing twice; only the months of the batch are read for
    it."""

    def outcomes(batch: DataFrame) -> DataFrame:
        return abnormal_outcomes(batch, bars, bench).withColumn(MONTH, F.date_format("due_at", "yyyy-MM"))

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys).withColumn(MONTH, F.date_format(F.col("published_at") + F.make_interval(days=F.col("horizon_days")), "yyyy-MM"))
        months = [r[0] for r in new.select(MONTH).distinct().collect()]  # a list of the calendar
        known = spark.read.schema(outcomes(batch.limit(0)).schema).parquet(path).where(F.col(MONTH).isin(months))
        fresh = new.join(known.select(*keys), keys, "left_anti").drop(MONTH)
        outcomes(fresh).write.mode("append").partitionBy(MONTH).parquet(path)

    spark = due.sparkSession
    outcomes(spark.createDataFrame([], due.schema)).write.mode("append").partitionBy(MONTH).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
    return due.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _decayed(half_life: float):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        as_of, value, weight, n, last = state.get if state.exists else (None, 0.0, 0.0, 0, None)
        for rows in batches:
            rows = rows[rows["value"].notna() & rows["at"].notna()]
            if not len(rows):
                continue
            newest = float(rows["at"].max())
            if as_of is None or newest > as_of:
                if as_of is not None:
                    keep = 0.5 ** ((newest - as_of) / 86400 / half_life)
                    value, weight = value * keep, weight * keep
                as_of = newest
            w = rows["weight"] * 0.5 ** ((as_of - rows["at"]) / 86400 / half_life)
            value, weight, n = value + float((w * rows["value"]).sum()), weight + float(w.sum()), n + len(rows)
        if as_of is not None:
            mean = value / weight if weight else None
            delta = None if last is None or mean is None else mean - last
            state.update((as_of, value, weight, n, mean))
            yield pd.DataFrame({"entity": [key[0]], "as_of": [pd.Timestamp(as_of, unit="s")], "mean": [mean], "weight": [weight], "n_events": [n], "delta": [delta]})

    return update


def decayed_states(events: DataFrame, value: str, weight: str, time_col: str = "published_at", half_life: float = HALF_LIFE) -> DataFrame:
    """A stream of states: for each entity with events in a batch, as of its latest event, the mean of all its events'
    values weighted by weight and age, the weight, the number of events, and the change of the mean since its last state.
    Null values, weights and times don't count; a null entity is one. Two numbers are held for each entity."""
    rows = events.select("entity", F.col(time_col).cast("double").alias("at"), F.col(value).cast("double").alias("value"), F.col(weight).cast("double").alias("weight")).where("weight is not null")
    return rows.groupBy("entity").applyInPandasWithState(_decayed(half_life), _OUT, _HELD, "update", GroupStateTimeout.NoTimeout)


def decayed_now(events: DataFrame, value: str, weight: str, time_col: str = "published_at", half_life: float = HALF_LIFE) -> DataFrame:
    """The same states of a table: one row per entity, as of its latest event."""
    rows = events.where(F.col(value).isNotNull() & F.col(weight).isNotNull() & F.col(time_col).isNotNull())
    last = rows.groupBy(F.col("entity").alias("of")).agg(F.max(time_col).alias("as_of"))
    aged = rows.join(last, rows["entity"].eqNullSafe(last["of"])).withColumn("__w", F.col(weight) * F.pow(F.lit(0.5), (F.col("as_of").cast("double") - F.col(time_col).cast("double")) / 86400 / half_life))
    out = aged.groupBy("entity", "as_of").agg(F.sum(F.col("__w") * F.col(value)).alias("v"), F.sum("__w").alias("weight"), F.count(F.lit(1)).alias("n_events"))
    return out.select("entity", "as_of", F.try_divide("v", "weight").alias("mean"), "weight", "n_events")
