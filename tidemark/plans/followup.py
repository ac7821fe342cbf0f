"""Queries on what became of relationships, trades and narratives, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators.ledger import sign
from tidemark.plans import reports, study
from tidemark.plans.market import Query, states, take
from tidemark.plans.sql import pick

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BARS_HELD = (1, 5, 10, 20, 40, 60)
NOW = "2001-08-01"
FRESH, DUE = 100, 200
TESTS_PER_BATCH = 20
#: What each dimension of a condition is evidence of. A stand-in.
CONCEPTS = {"regime": "market_regime", "prior_return_bucket": "prior_move", "vol_bucket": "volatility"}


def query(name: str, make: Query, columns: str, table: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES)


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.tested(study.resolved_ledger(spark, sf_dir))


def holding_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return had every trade been closed at its K-th bar. A trade's path is as long as its horizon at most."""
    by = Window.partitionBy("event_id", "horizon_days").orderBy("ts")
    rows = study.priced_trades(spark, sf_dir).withColumns({"bars_held": F.row_number().over(by) - 1, "entry_price": F.first("close").over(by)})
    result = F.when(F.col("action") == "LONG", 1).otherwise(-1) * (F.col("close") / F.col("entry_price") - 1)
    return rows.where(F.col("bars_held").isin(*BARS_HELD)).groupBy("bars_held").agg(F.count(F.lit(1)).alias("n"), F.avg(result).alias("mean_return"))


def decay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each condition was last confirmed."""
    last = F.max(F.when(F.col("status") == "CONFIRMED", F.col("checkpoint")))
    rows = tested(spark, sf_dir).groupBy(*study.KEYS).agg(F.datediff(F.lit(NOW).cast("date"), last).alias("days"))
    state = F.when(F.col("days").isNull(), "NEVER").when(F.col("days") <= FRESH, "FRESH").when(F.col("days") <= DUE, "DUE").otherwise("OVERDUE")
    return rows.withColumn("decay_state", state)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that each relationship's condition touches."""
    concept = F.create_map(*[F.lit(x) for kv in CONCEPTS.items() for x in kv])
    touched = F.transform(F.split("condition", "&"), lambda pair: concept[F.split(pair, "=")[0]])
    return study.known(study.resolved_ledger(spark, sf_dir)).withColumn("concepts", F.array_join(F.array_sort(F.array_distinct(touched)), ","))


def grid_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hypotheses of a batch a fixed number of tests reaches; those left out are told, not lost."""
    order = Window.partitionBy("quarter", "horizon_days").orderBy("n_keys", "event_id", "condition")
    return tested(spark, sf_dir).withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= TESTS_PER_BATCH)


def knowledge_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations known at each event. They come at starts of quarters, so that running sums over one row per quarter
    meet events by equality."""
    events = views.market_events(spark, sf_dir).select("event_id", F.date_trunc("quarter", "published_at").alias("quarter"))
    changes = tested(spark, sf_dir).where("status = 'CONFIRMED'").groupBy(F.col("checkpoint").alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
    every = changes.unionByName(events.select("quarter", F.lit(0).cast("long").alias("n")).distinct()).groupBy("quarter").agg(F.sum("n").alias("n"))
    known = every.select("quarter", F.sum("n").over(Window.orderBy("quarter")).alias("version"))
    return events.join(known, "quarter")


def incremental_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a relationship predicts: outcomes against the baseline model's prediction of the same case, and how much
    smaller the error became."""
    cases = study.resolved_ledger(spark, sf_dir).withColumn("static", F.col("predicted_impact"))
    rows = study.adaptive(cases).where("basis = 'validated_relationship'")
    gap = F.col("realized") - F.col("static")
    return rows.groupBy("horizon_days").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap) - F.abs(F.col("realized") - F.col("predicted_impact"))).alias("improvement"))


def market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's last close, the returns up to it over 30 and 90 days, and its last states."""
    rows = states(spark, sf_dir).select("entity", "ts", "close", "trend_direction", "volatility_state").withColumn("last", F.max("ts").over(Window.partitionBy("entity")))
    before = {n: F.max_by("close", F.when(F.col("ts") <= F.col("last") - F.expr(f"interval {n} days"), F.col("ts"))) for n in (30, 90)}
    out = rows.groupBy("entity").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("price"), before[30].alias("c30"), before[90].alias("c90"), F.max_by("trend_direction", "ts").alias("trend_direction"), F.max_by("volatility_state", "ts").alias("volatility_state"))
    return out.withColumns({"return_30d": F.col("price") / F.col("c30") - 1, "return_90d": F.col("price") / F.col("c90") - 1})


def sentiment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of each entity by polarity."""
    counts = [F.count(F.when(F.col("sentiment") == s, 1)).alias(s.lower()) for s in ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL")]
    topic = F.when(F.col("sentiment") == "POSITIVE", F.concat("event_type", F.lit(":"), F.coalesce("area", F.lit("-"))))
    return reports.narratives(spark, sf_dir).groupBy("entity").agg(*counts, F.array_join(F.array_sort(F.collect_list(topic)), ",").alias("positive_topics"))


def strongest_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's narrative of most confidence, then of most sources."""
    rank = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2)
    order = F.struct(rank.alias("a"), (-F.col("independent_sources")).alias("b"), F.col("event_type").alias("c"), F.coalesce("area", F.lit("")).alias("d"))
    return reports.narratives(spark, sf_dir).groupBy("entity").agg(F.min_by(F.struct("event_type", "area", "confidence", "independent_sources"), order).alias("x")).select("entity", "x.*")


def magnitude_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs("signed_score")
    rows = reports.sized(spark, sf_dir).withColumn("bin", F.when(size.isNull(), "NONE").when(size < 0.4, "LOW").when(size < 0.7, "MEDIUM").otherwise("HIGH"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("signed_score").alias("mean_score"), F.count(F.when(sign(F.col("signed_score")) > 0, 1)).alias("positive"))


_ON = ", ".join(study.KEYS)
_CONCEPT = " ".join(f"when '{d}' then '{c}'" for d, c in CONCEPTS.items())

TABLES = reports.TABLES | study.TABLES | {
    "holding_q": f"select i as bars_held, count(*) as n, avg((case action when 'LONG' then 1 else -1 end) * (close / entry_price - 1)) as mean_return from paths where i in {BARS_HELD} group by 1",
    "decay_q": f"""select *, case when days is null then 'NEVER' when days <= {FRESH} then 'FRESH' when days <= {DUE} then 'DUE' else 'OVERDUE' end as decay_state from (
      select {_ON}, date_diff('day', max(checkpoint) filter (verdict = 'CONFIRMED'), timestamp '{NOW}') as days from judged group by all)""",
    "provenance_q": f"select *, array_to_string(list_sort(list_distinct(list_transform(string_split(condition, '&'), lambda c: case string_split(c, '=')[1] {_CONCEPT} end))), ',') as concepts from relations",
    "guard_q": f"select *, place <= {TESTS_PER_BATCH} as kept from (select *, row_number() over (partition by quarter, horizon_days order by n_keys, event_id, condition) as place from judged)",
    "version_q": "select event_id, count(checkpoint) as version from ev left join (select checkpoint from judged where verdict = 'CONFIRMED') c on checkpoint <= published_at group by 1",
    "increment_q": """select horizon_days, count(*) as n, avg(d.realized - d.predicted_impact) as mean_gap, avg(abs(d.realized - d.predicted_impact) - abs(d.realized - b.effect_estimate)) as improvement
      from deduped d join best b using (event_id, horizon_days) where outcome_status = 'OK' group by 1""",
    "market_q": """select *, price / c30 - 1 as return_30d, price / c90 - 1 as return_90d from (select entity, max(ts) as ts, arg_max(close, ts) as price, arg_max(close, ts) filter (ts <= last - interval 30 days) as c30,
      arg_max(close, ts) filter (ts <= last - interval 90 days) as c90, arg_max(trend_direction, ts) as trend_direction, arg_max(volatility_state, ts) as volatility_state from (select *, max(ts) over (partition by entity) as last from tech) group by 1)""",
    "profile_q": "select entity, " + ", ".join(f"count(*) filter (sentiment = '{s}') as {s.lower()}" for s in ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL")) + """, coalesce(string_agg(event_type || ':' || coalesce(area, '-'), ',' order by event_type || ':' || coalesce(area, '-')) filter (sentiment = 'POSITIVE'), '') as positive_topics
      from narratives_q group by 1""",
    "strongest_q": "select * from (select *, row_number() over (partition by entity order by case confidence when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, independent_sources desc, event_type, coalesce(area, '')) as k from narratives_q) where k = 1",
    "bins_q": "select case when signed_score is null then 'NONE' when abs(signed_score) < 0.4 then 'LOW' when abs(signed_score) < 0.7 then 'MEDIUM' else 'HIGH' end as bin, count(*) as n, avg(signed_score) as mean_score, count(*) filter (signed_score > 0) as positive from magnitude_q group by 1",
}

query("holding_period", holding_period, "bars_held n ~mean_return", "holding_q")
query("decay_state", decay_state, f"{' '.join(study.KEYS)} decay_state", "decay_q")
query("provenance", provenance, f"{' '.join(study.KEYS)} concepts", "provenance_q")
query("parameter_grid_guard", grid_guard, f"quarter {' '.join(study.KEYS)} place kept", "guard_q")
query("knowledge_version", knowledge_version, "event_id version", "version_q")
query("incremental_value", incremental_value, "horizon_days n ~mean_gap ~improvement", "increment_q")
query("market_context", market_context, "entity ts ~price ~return_30d ~return_90d trend_direction volatility_state", "market_q")
query("text_sentiment_profile", sentiment_profile, "entity positive negative mixed neutral positive_topics", "profile_q")
query("strongest_narrative", strongest_narrative, "entity event_type area confidence independent_sources", "strongest_q")
query("magnitude_breakdown", magnitude_breakdown, "bin n ~mean_score positive", "bins_q")

__all__ = ["ORACLE_SQL", "QUERIES"]
