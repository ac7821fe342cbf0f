"""Domain tables over the given star schema: daily bars, a benchmark series, and dated market events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events' direction by order status.
DIRECTIONS = {"O": "positive", "F": "negative", "P": "unclear"}
HORIZONS = (1, 5, 20, 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(lines: DataFrame) -> DataFrame:
    # Days and prices are made after lines have met parts: where that join shuffles, prices needn't go along.
    rows = lines.withColumns({"ts": F.date_trunc("day", F.col("l_shipdate").cast("timestamp")), "price": 1000 + F.col("l_extendedprice") / 1000})
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.groupBy("entity", "ts").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"))


def bars(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    """Daily bars (entity, ts, open, high, low, close, volume) of each brand, or of each value of another part column."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(by).alias("entity"))
    return _daily(table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")))


def bench_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all lines together: the benchmark."""
    return _daily(table(spark, sf_dir, "lineitem").withColumn("entity", F.lit("ALL")))


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, entity, event_type, direction, source, published_at): orders that have lines, with the brand of their
    first line and the segment of their customer."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("line"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"))
    orders = table(spark, sf_dir, "orders")
    direction = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])[F.col("o_orderstatus")]
    joined = orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("line.l_partkey") == F.col("p_partkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("event_id"), "entity", F.col("o_orderpriority").alias("event_type"), direction.alias("direction"), "source", F.col("o_orderdate").cast("timestamp").alias("published_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents: publisher, entity, publishing day, title (the start of the first line), reliability."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = F.when(F.col("doc_id") % 10 == 0, "filing").otherwise("news")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(F.col("doc_id").alias("source_id"), F.col("source").alias("publisher"), F.concat(F.lit("E"), (F.col("doc_id") % 20).cast("string")).alias("entity"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 30 as int))").alias("published_at"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), F.col("text").alias("body"), F.col("lang"), kind.alias("source_type"), F.when(F.col("quality") == 1, "SECONDARY").otherwise("TERTIARY").alias("reliability"))
