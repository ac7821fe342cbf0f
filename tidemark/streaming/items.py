"""Streams of items, maturing predictions and decayed news states."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def deduped_items(items: DataFrame, keys: Sequence[str], time_col: str = "published_at", lateness: str = "2 days") -> DataFrame:
    """The first item of each key within the watermark; state older than it is dropped."""
    return items.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([*keys])


def resolving(due: DataFrame, path: str, keys: Sequence[str], resolve: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A writer that appends outcomes of matured predictions to a table, each key once: what the table has is taken off
    every batch first, so a batch that is run again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.format("parquet").schema(resolve(batch.limit(0)).schema).load(path)
        fresh = batch.dropDuplicates([*keys]).join(known.select(*keys), [*keys], "left_anti")
        resolve(fresh).write.mode("append").parquet(path)

    empty = resolve(due.sparkSession.createDataFrame([], due.schema))
    empty.write.mode("append").parquet(path)
    return due.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_state(events: DataFrame, value: str, weight: Column, keys: Sequence[str] = ("entity",), time_col: str = "published_at", window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Per key and window of event time: weighted mean of a value, total weight and events. Sums only, so that states of
    windows can be decayed and added up later."""
    rows = events.withWatermark(time_col, lateness).withColumn("__w", F.when(F.col(value).isNotNull(), weight))
    out = rows.groupBy(F.window(time_col, window).alias("span"), *keys).agg(F.sum(F.col(value) * F.col("__w")).alias("weighted"), F.sum("__w").alias("weight"), F.count(F.lit(1)).alias("n_events"))
    return out.select(F.col("span.start").alias("start"), *keys, "weighted", "weight", (F.col("weighted") / F.col("weight")).alias("mean"), "n_events")
