"""Append-only tables: predictions, their outcomes, observations, and whatever else is logged once.

A row's key is a hash of its natural key, so that the same row has the same key whoever writes it. A batch is a folder of
its table, written as a whole: a batch that is run again, after a failure or twice, replaces its own folder and nothing
else. Rows whose key another batch holds are left out, so no order of batches doubles a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import write

KEY, BATCH, _OF = "row_key", "batch", "__of"


def _parts(natural: Sequence[str]) -> Column:
    """What row_key is the hash of. Rows are met by this, as it is the same key and mostly far shorter."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in natural])


def keyed(rows: DataFrame, natural: Sequence[str]) -> DataFrame:
    """rows with row_key, a hash of the natural key; a null part is a value of its own."""
    return rows.withColumn(KEY, F.sha2(_parts(natural).cast("binary"), 256))


def read(spark, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows with the batch that each came in; no rows while nothing was appended."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(path)


def append(rows: DataFrame, path: str, natural: Sequence[str], batch: str, first: Sequence[str] = ()) -> DataFrame:
    """Appends to the table at `path` the rows whose key no other batch holds, one per key: the least by `first`, then by
    all columns. Returns the refused ones: those of other batches' keys, and repeats of a key that differ. Running a batch
    again gives the same table."""
    spark, columns = rows.sparkSession, rows.columns
    schema = keyed(rows, natural).schema
    held = read(spark, path, schema).where(F.col(BATCH) != batch).select(_parts(natural).alias(_OF))
    order = F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(first)], *sorted(columns))
    one = rows.groupBy(_parts(natural).alias(_OF)).agg(F.min(order).alias("__row"))
    # Tables of any length: their files are small beside their rows, so Spark would broadcast them through the driver.
    fresh = one.join(held.hint("merge"), _OF, "left_anti").select(*[F.col("__row")[c].alias(c) for c in columns])
    write(keyed(fresh, natural), f"{path}/{BATCH}={batch}", "overwrite")
    kept = spark.read.schema(schema).parquet(f"{path}/{BATCH}={batch}").select(_parts(natural).alias(_OF), F.struct(*columns).alias("__kept")).hint("merge")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col("__kept")[c])
    met = rows.withColumn(_OF, _parts(natural)).join(kept, _OF, "left")
    return met.where(F.col("__kept").isNull() | ~same).select(*columns)


def record_outcomes(outcomes: DataFrame, predictions: DataFrame, path: str, natural: Sequence[str], batch: str, observed: str = "observed_at") -> DataFrame:
    """Appends outcomes of logged predictions, each key once and for good. Returns what is refused, with `reason`:
    NO_PREDICTION for a key that was never logged, SECOND_OUTCOME for one that has its outcome already, in this batch from
    an earlier time or in another batch."""
    known = predictions.select(_parts(natural).alias(_OF)).hint("merge")
    marked = outcomes.withColumn(_OF, _parts(natural))
    logged = marked.join(known, _OF, "left_semi").drop(_OF)
    strangers = marked.join(known, _OF, "left_anti").drop(_OF)
    second = append(logged, path, natural, batch, [observed])
    return strangers.withColumn("reason", F.lit("NO_PREDICTION")).unionByName(second.withColumn("reason", F.lit("SECOND_OUTCOME")))


def ledger(predictions: DataFrame, outcomes: DataFrame, natural: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Logged predictions with the values of their outcomes and outcome_locked."""
    held = outcomes.select(_parts(natural).alias(_OF), *values, F.lit(True).alias("__held")).hint("merge")
    rows = keyed(predictions.drop(KEY), natural).withColumn(_OF, _parts(natural)).join(held, _OF, "left").drop(_OF)
    return rows.withColumn("outcome_locked", F.coalesce("__held", F.lit(False))).drop("__held")
