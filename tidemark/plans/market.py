"""Queries over bars, events and the ledger, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import asof, ledger as led, technical
from tidemark.operators.scan import known_before
from tidemark.plans.sql import pick, sql
from tidemark.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
OFFSETS = (0, -1, -5, -10, -15, -20, -60)


def take(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*[(F.round(F.col(c[1:]), 6) + F.lit(0.0)).alias(c[1:]) if c.startswith("~") else F.col(c) for c in columns.split()])


def query(name: str, make: Query, columns: str, table: str, extra: dict[str, str] | None = None, where: str = "") -> None:
    """Registers a query of some columns, and the same columns of a table expression as its SQL."""
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, extra, where)


# Tables that queries share.


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.technical_states(views.bars(spark, sf_dir), views.bench_bars(spark, sf_dir))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.market_scan(states(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars and the benchmark. Written once, one row per entity and day, as what follows reads them several times
    and would aggregate all lines each time."""
    return stored(views.bars(spark, sf_dir), "bars"), stored(views.bench_bars(spark, sf_dir), "bench")


def ledger_of(events: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return asof.abnormal_returns(events, bars, bench, views.HORIZONS)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_of(views.market_events(spark, sf_dir), views.bars(spark, sf_dir), views.bench_bars(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    # Written once: the baseline and the rows that it is joined to both come from it.
    rows = stored(ledger(spark, sf_dir).select(*columns), "outcomes")
    return led.static_predict(rows, led.baseline_magnitude(led.outcome_known(rows)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.classify_error(predicted(spark, sf_dir))


def real_events(events: DataFrame) -> DataFrame:
    """One event per real event. Each event has a row at every horizon, so this picks what `dedupe_real_event` picks among
    those rows, before they are made."""
    return stored(led.dedupe_real_event(events, [k for k in led.REAL_EVENT if k != "horizon_days"]), "real")


def _real_scored(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Real events, and their scored outcomes. The baseline is that of `scored`: all outcomes count."""
    events = stored(views.market_events(spark, sf_dir), "events")
    baseline = led.baseline_magnitude(led.outcome_known(ledger_of(events, bars, bench)))
    real = real_events(events)
    return real, led.classify_error(led.static_predict(ledger_of(real, bars, bench), baseline))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _real_scored(spark, sf_dir, *series(spark, sf_dir))[1]


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.outcome_known(deduped(spark, sf_dir))


def context_of(events: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Each event with regime, trailing returns, volatility and their bins, as of its time."""
    own = asof.with_prices(events, bars, OFFSETS, "published_at", "e")
    rows = asof.with_market(own, bench, (0, -20, -60))
    c = F.col
    returns = [asof.growth(c("e_m20"), c("e_m15")), asof.growth(c("e_m15"), c("e_m10")), asof.growth(c("e_m10"), c("e_m5")), asof.growth(c("e_m5"), c("e_p0"))]
    mean = sum(returns) / 4
    rows = rows.withColumns({"regime": asof.regime(c("b_m60"), c("b_p0")), "r1": asof.growth(c("e_m1"), c("e_p0")), "r5": asof.growth(c("e_m5"), c("e_p0")), "r20": asof.growth(c("e_m20"), c("e_p0")), "r60": asof.growth(c("e_m60"), c("e_p0")), "bench_r20": asof.growth(c("b_m20"), c("b_p0")), "realized_vol": F.sqrt(sum(F.pow(r - mean, 2) for r in returns) / 3)})
    return rows.withColumns({"prior_return_bucket": asof.bins(c("r5"), asof.PRIOR_RETURN_BINS), "vol_bucket": asof.bins(c("realized_vol"), asof.VOLATILITY_BINS)})


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_of(views.market_events(spark, sf_dir), views.bars(spark, sf_dir), views.bench_bars(spark, sf_dir))


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, bench = series(spark, sf_dir)
    real, rows = _real_scored(spark, sf_dir, bars, bench)
    return rows.join(context_of(real, bars, bench).select("event_id", "regime", "prior_return_bucket", "vol_bucket"), "event_id")


# Bars.
query("scan_bars", views.bars, "entity ts ~open ~high ~low ~close volume", "bars")
query("clean_bars", lambda s, d: views.bars(s, d).where("open is not null and high is not null and low is not null and close is not null and not (isnan(open) or isnan(high) or isnan(low) or isnan(close))"), "entity ts ~close volume", "bars", where="open is not null and close is not null")

# Technical states, all from one table.
for _name, _columns in {
    "sma": "~trend_ma20 n", "ma_slope": "~ma_slope_pct ma_slope_state", "trend": "trend_direction", "momentum": "~momentum_roc_20d momentum_state",
    "mean_reversion": "~mean_reversion_zscore mean_reversion_state", "breakout": "breakout_state ~high20 ~low20", "support_resistance": "~from_high ~from_low support_resistance_state",
    "pullback": "pullback_state", "price_action": "price_action_pattern", "atr_ratio": "~atr_ratio volatility_state", "relative_volume": "~relative_volume_raw relative_volume_state",
    "vwap_proxy": "~vwap_proxy_20d vwap_state", "ma_stack": "ma_stack", "market_structure": "market_structure", "gap": "~gap_pct gap_state", "relative_strength": "~relative_strength_20d relative_strength_state",
    "clv": "~clv_raw clv_state", "liquidity_regime": "~liquidity_ratio liquidity_regime", "mtf_confirmation": "mtf_confirmation weekly_trend",
}.items():
    query(_name, states, f"entity ts {_columns}", "tech")
query("technical_context", states, "entity ts " + " ".join(technical.DEFAULT_VALUES), "tech")
query("market_scan", scan, "entity ts rn " + " ".join(technical.DEFAULT_VALUES), "scan")

# As-of joins.
query("asof_close", lambda s, d: asof.asof_close(views.market_events(s, d), views.bars(s, d), "published_at"), "event_id entity published_at ~price", "asof_q", {"asof_q": "select event_id, ev.entity, published_at, close as price from ev asof left join bars b on ev.entity = b.entity and ev.published_at >= b.ts"})


def interval_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the 30 days up to each bar: how many, their mean close and range."""
    by = Window.partitionBy("entity").orderBy(F.col("ts").cast("long")).rangeBetween(-30 * 86400, 0)
    return views.bars(spark, sf_dir).select("entity", "ts", F.count(F.lit(1)).over(by).alias("n_bars"), F.avg("close").over(by).alias("mean_close"), F.max("high").over(by).alias("highest"), F.min("low").over(by).alias("lowest"))


query("interval_bars", interval_bars, "entity ts n_bars ~mean_close ~highest ~lowest", "interval_q", {"interval_q": "select a.entity, a.ts, count(*) as n_bars, avg(b.close) as mean_close, max(b.high) as highest, min(b.low) as lowest from bars a join bars b on a.entity = b.entity and b.ts between a.ts - interval 30 days and a.ts group by 1, 2"})
query("abnormal_return", ledger, "event_id horizon_days ~entity_return ~bench_return ~realized outcome_status", "ledger")
query("regime", context, "event_id regime", "contexts")
query("trailing_returns", context, "event_id ~r1 ~r5 ~r20 ~r60 ~bench_r20", "contexts")
query("realized_vol", context, "event_id ~realized_vol", "contexts")
query("buckets", context, "event_id prior_return_bucket vol_bucket", "contexts")
query("days_since_last", lambda s, d: views.market_events(s, d).withColumn("days", (F.col("published_at").cast("long") - F.max("published_at").over(Window.partitionBy("entity", "event_type").orderBy(F.col("published_at").cast("long")).rangeBetween(Window.unboundedPreceding, -1)).cast("long")) / 86400), "event_id ~days", "since_q", {"since_q": "select event_id, epoch(published_at - max(published_at) over (partition by entity, event_type order by published_at range between unbounded preceding and interval 1 second preceding)) / 86400 as days from ev"})


def competing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other entities with an event on the same day, per event: distinct entities per day, less its own."""
    events = views.market_events(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    days = events.groupBy("day").agg(F.countDistinct("entity").alias("entities"))
    return events.join(days, "day").withColumn("competing", F.col("entities") - 1)


query("competing_same_day", competing, "event_id competing", "competing_q", {"competing_q": "select event_id, n - 1 as competing from ev join (select published_at::date as day, count(distinct entity) as n from ev group by 1) on day = published_at::date"})

# Event and ledger scans.
query("query_events", lambda s, d: views.market_events(s, d).where("event_type = '1-URGENT' and published_at < timestamp'1998-01-01'"), "event_id entity event_type direction published_at", "ev", where="event_type = '1-URGENT' and published_at < timestamp '1998-01-01'")
query("outcome_known", lambda s, d: led.outcome_known(ledger(s, d)), "event_id horizon_days ~realized", "known")
query("dedupe_real_event", deduped, "event_id entity horizon_days event_type direction published_at", "deduped")
query("event_pool", lambda s, d: resolved(s, d).where("event_type = '2-HIGH' and direction = 'positive' and horizon_days = 20"), "event_id entity published_at ~realized", "deduped", where="outcome_status = 'OK' and event_type = '2-HIGH' and direction = 'positive' and horizon_days = 20")
query("topk_recent", lambda s, d: views.market_events(s, d).withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("published_at").desc(), "event_id"))).where("k <= 10"), "entity k event_id published_at", "recent_q", {"recent_q": "select * from (select *, row_number() over (partition by entity order by published_at desc, event_id) as k from ev) where k <= 10"})
query("latest_report", lambda s, d: views.market_events(s, d).groupBy("entity").agg(F.max_by(F.struct("event_id", "published_at"), F.struct("published_at", "event_id")).alias("x")).select("entity", "x.*"), "entity event_id published_at", "latest_q", {"latest_q": "select * from (select *, row_number() over (partition by entity order by published_at desc, event_id desc) as k from ev) where k = 1"})
query("embargo_resolve", lambda s, d: ledger(s, d).withColumn("resolve_at", F.col("published_at") + F.make_interval(days=F.col("horizon_days") + 2)).withColumn("due", F.col("resolve_at") <= F.expr("timestamp'1999-01-01'")), "event_id horizon_days resolve_at due", "embargo_q", {"embargo_q": "select event_id, horizon_days, published_at + to_days(horizon_days + 2) as resolve_at, published_at + to_days(horizon_days + 2) <= timestamp '1999-01-01' as due from ledger"})
query("leakage_audit", lambda s, d: views.market_events(s, d).where("published_at > timestamp'2000-06-01'"), "event_id published_at", "ev", where="published_at > timestamp '2000-06-01'")
query("any_interesting_value", lambda s, d: technical.interesting_values(scan(s, d), ["entity", "ts"]), "entity ts dimension value", "interesting")
query("top_values", lambda s, d: technical.interesting_values(scan(s, d), ["entity", "ts"]).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("n").desc(), "value"))).where("k <= 4"), "dimension value n k", "top_q", {"top_q": "select * from (select *, row_number() over (partition by dimension order by n desc, value) as k from (select dimension, value, count(*) as n from interesting group by 1, 2)) where k <= 4"})
query("similar_cases", lambda s, d: similar_cases(s, d), "event_id horizon_days n_cases ~mean_realized", "similar_q", {"similar_q": """select a.event_id, a.horizon_days, count(b.event_id) as n_cases, avg(b.realized) as mean_realized from full_ledger a
    left join (select * from full_ledger where outcome_status = 'OK') b on a.event_type = b.event_type and a.horizon_days = b.horizon_days and a.regime = b.regime and a.prior_return_bucket = b.prior_return_bucket
      and b.published_at + to_days(b.horizon_days) < a.published_at group by 1, 2"""})


def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved cases of the same type, horizon, regime and prior-return bin before each case: counts and means from sums
    by time, so that no pairs are made. The ledger is written once, as it is both what is asked and what is known."""
    rows = stored(full_ledger(spark, sf_dir), "ledger")
    known = F.when(F.col("outcome_status") == "OK", F.col("realized"))
    keys = ["event_type", "horizon_days", "regime", "prior_return_bucket"]
    seen = rows.select(*keys, (F.col("published_at") + F.make_interval(days=F.col("horizon_days"))).alias("at"), known.alias("outcome"))
    return known_before(rows, seen, keys, "published_at", "outcome", "at").withColumnsRenamed({"prior_n": "n_cases", "prior_mean": "mean_realized"})


# Segments.
query("chrono_segments", lambda s, d: led.chrono_segments(views.market_events(s, d), "published_at", "event_id"), "event_id segment", "segment_q", {"segment_q": """select event_id, case when rn <= floor(n * 0.4) then 'TRAIN' when rn <= floor(n * 0.4) + floor(n * 0.3) then 'VALIDATE'
    when rn <= floor(n * 0.4) + floor(n * 0.3) + floor(n * 0.15) then 'SHADOW' else 'TEST' end as segment from (select event_id, row_number() over (order by published_at, event_id) as rn, count(*) over () as n from ev)"""})
query("walkforward_segments", lambda s, d: led.chrono_rank(views.market_events(s, d), "published_at", "event_id").withColumn("segment", F.when(F.col("rn") <= F.floor(F.col("total") * 0.2), "BURN_IN").when(F.col("rn") > F.col("total") - F.floor(F.col("total") * 0.25), "HOLDOUT").otherwise("DEVELOPMENT")), "event_id segment", "walk_q", {"walk_q": "select event_id, case when rn <= floor(n * 0.2) then 'BURN_IN' when rn > n - floor(n * 0.25) then 'HOLDOUT' else 'DEVELOPMENT' end as segment from (select event_id, row_number() over (order by published_at, event_id) as rn, count(*) over () as n from ev)"})
query("quarter_checkpoint", lambda s, d: views.market_events(s, d).groupBy(F.date_trunc("quarter", "published_at").alias("quarter")).agg(F.min(F.struct("published_at", "event_id")).alias("x")).select("quarter", "x.event_id"), "quarter event_id", "quarter_q", {"quarter_q": "select date_trunc('quarter', published_at)::timestamp as quarter, arg_min(event_id, row(published_at, event_id)) as event_id from ev group by 1"})

# Scores and statistics.
query("baseline_magnitude", lambda s, d: led.baseline_magnitude(led.outcome_known(ledger(s, d))), "horizon_days ~baseline", "base")
query("static_predict", predicted, "event_id horizon_days ~predicted_impact predicted_confidence", "pred")
query("classify_error", scored, "event_id horizon_days error_type ~error_value may_learn", "scored")
query("score_ledger", deduped, "event_id horizon_days direction ~predicted_impact ~realized error_type", "deduped")
query("operational_counts", lambda s, d: scored(s, d).groupBy("horizon_days", "error_type").agg(F.count(F.lit(1)).alias("n")), "horizon_days error_type n", "counts_q", {"counts_q": "select horizon_days, error_type, count(*) as n from scored group by 1, 2"})
query("source_reliability", lambda s, d: scored(s, d).groupBy("source").agg(F.count(F.when(F.col("outcome_status") == "OK", 1)).alias("resolved_n"), F.count(F.when(F.col("may_learn"), 1)).alias("learnable"), F.avg(F.when(F.col("outcome_status") == "OK", (F.col("error_type") == "OK").cast("double"))).alias("hit_rate")), "source resolved_n learnable ~hit_rate", "reliability_q", {"reliability_q": "select source, count(*) filter (outcome_status = 'OK') as resolved_n, count(*) filter (may_learn) as learnable, avg((error_type = 'OK')::int) filter (outcome_status = 'OK') as hit_rate from scored group by 1"})


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.one_sample_t(resolved(spark, sf_dir), ["event_type", "direction", "horizon_days"], "realized")


query("one_sample_t", tested, "event_type direction horizon_days n ~mean_effect ~t ~p status", "tested")
query("holm", lambda s, d: led.holm_wide(tested(s, d), ["horizon_days"], "p", ["event_type", "direction"]), "event_type direction horizon_days ~p ~p_holm", "corrected")
query("accuracy_metrics", lambda s, d: led.accuracy_metrics(resolved(s, d), ["event_type", "horizon_days"]), "event_type horizon_days n ~direction_accuracy ~mae ~rmse ~spearman ~brier", "accuracy_q", {"accuracy_q": """select event_type, horizon_days, count(*) as n, case when count(*) filter (ps <> 0 and rs <> 0) >= 2 then avg((ps = rs)::int) filter (ps <> 0 and rs <> 0) end as direction_accuracy,
    avg(abs(predicted_impact - realized)) as mae, sqrt(avg(pow(predicted_impact - realized, 2))) as rmse, corr(rank_p, rank_r) as spearman, avg(pow(0.65 - (ps = rs)::int, 2)) as brier from ranked group by 1, 2"""})
query("calibration_by_horizon", lambda s, d: led.accuracy_metrics(resolved(s, d), ["horizon_days"]), "horizon_days n ~direction_accuracy ~mae ~rmse", "calibration_q", {"calibration_q": "select horizon_days, count(*) as n, avg((ps = rs)::int) filter (ps <> 0 and rs <> 0) as direction_accuracy, avg(abs(predicted_impact - realized)) as mae, sqrt(avg(pow(predicted_impact - realized, 2))) as rmse from ranked group by 1"})
query("equity_curve", lambda s, d: led.equity_curve(resolved(s, d), ["horizon_days"], ["published_at", "event_id"]), "event_id horizon_days ~after_cost ~equity ~drawdown", "curve_q", {"curve_q": "select event_id, horizon_days, after_cost, equity, equity - greatest(0.0, max(equity) over (partition by horizon_days order by published_at, event_id rows unbounded preceding)) as drawdown from curve"})
query("portfolio_metrics", lambda s, d: led.portfolio_metrics(resolved(s, d), ["horizon_days"], ["published_at", "event_id"]), "horizon_days n_trades ~expected_value ~total_return_after_costs ~max_drawdown ~window_days ~sharpe_per_trade ~sharpe_annualized ~sortino_per_trade", "portfolio_q", {"portfolio_q": """select *, sharpe_per_trade * sqrt(n_trades / (window_days / 365.25)) as sharpe_annualized from (
    select horizon_days, count(*) as n_trades, avg(raw_return) as expected_value, sum(after_cost) as total_return_after_costs, least(0.0, min(drawdown)) as max_drawdown,
    greatest(1.0, epoch(max(published_at) - min(published_at)) / 86400) as window_days, avg(after_cost) / stddev_samp(after_cost) as sharpe_per_trade,
    avg(after_cost) / sqrt(avg(pow(after_cost, 2)) filter (after_cost < 0)) as sortino_per_trade from curve group by 1)"""})
query("temporal_stability", lambda s, d: led.temporal_stability(resolved(s, d), ["event_type", "direction", "horizon_days"], ["published_at", "event_id"], "realized"), "event_type direction horizon_days n ~first_mean ~second_mean stable", "stability_q", {"stability_q": """select event_type, direction, horizon_days, count(*) as n, avg(realized) filter (rn <= total // 2) as first_mean, avg(realized) filter (rn > total // 2) as second_mean,
    (avg(realized) filter (rn <= total // 2) > 0) = (avg(realized) filter (rn > total // 2) > 0) as stable from (select *, row_number() over (partition by event_type, direction, horizon_days order by published_at, event_id) as rn,
    count(*) over (partition by event_type, direction, horizon_days) as total from deduped where outcome_status = 'OK') group by 1, 2, 3"""})
query("rolling_last_n", lambda s, d: led.latest_n(resolved(s, d), ["horizon_days"], [F.col("published_at").desc(), F.col("event_id").desc()], (50, 100, 250, 500)).groupBy("horizon_days", F.col("window").alias("last_n")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted_impact") - F.col("realized"))).alias("mae")), "horizon_days last_n n ~mae", "rolling_q", {"rolling_q": """select horizon_days, w as last_n, count(*) as n, avg(abs(predicted_impact - realized)) as mae from (select *, row_number() over (partition by horizon_days order by published_at desc, event_id desc) as rn from deduped where outcome_status = 'OK'),
    (values (50), (100), (250), (500)) ws(w) where rn <= w group by 1, 2"""})
query("historical_reaction", lambda s, d: resolved(s, d).groupBy("event_type", "direction", "horizon_days").agg(F.count(F.lit(1)).alias("n"), F.median("realized").alias("median_reaction"), F.avg((F.col("realized") > 0).cast("double")).alias("positive_share")).where("n >= 10"), "event_type direction horizon_days n ~median_reaction ~positive_share", "reaction_q", {"reaction_q": "select event_type, direction, horizon_days, count(*) as n, median(realized) as median_reaction, avg((realized > 0)::int) as positive_share from deduped where outcome_status = 'OK' group by 1, 2, 3 having count(*) >= 10"})
query("regime_stability", lambda s, d: full_ledger(s, d).where("outcome_status = 'OK'").groupBy("regime", "horizon_days").agg(F.count(F.lit(1)).alias("n"), F.avg(led.sign(F.col("predicted_impact")) * F.col("realized")).alias("expectancy")), "regime horizon_days n ~expectancy", "regime_q", {"regime_q": "select regime, horizon_days, count(*) as n, avg(ps * realized) as expectancy from full_ledger where outcome_status = 'OK' group by 1, 2"})
query("cost_sensitivity", lambda s, d: resolved(s, d).withColumn("cost", F.explode(F.array(*[F.lit(c) for c in (0.0, 0.001, 0.002, 0.005)]))).groupBy("horizon_days", "cost").agg(F.avg(led.sign(F.col("predicted_impact")) * F.col("realized") - F.col("cost")).alias("expectancy"), F.avg((led.sign(F.col("predicted_impact")) * F.col("realized") > F.col("cost")).cast("double")).alias("win_rate")), "horizon_days ~cost ~expectancy ~win_rate", "cost_q", {"cost_q": "select horizon_days, c::double as cost, avg(ps * realized - c) as expectancy, avg((ps * realized > c)::int) as win_rate from deduped, (values (0.0), (0.001), (0.002), (0.005)) cs(c) where outcome_status = 'OK' group by 1, 2"})
query("level1_screen", lambda s, d: led.holm_wide(led.one_sample_t(screen(s, d), ["dimension"], "change", min_n=15), [], "p", ["dimension"]), "dimension n ~mean_effect", "level1_q", {"level1_q": "select dimension, count(*) as n, avg(close / prev_close - 1) as mean_effect from interesting join (select entity, ts, close, prev_close from scan) using (entity, ts) where prev_close is not null group by 1"})


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scanned bar's day change, for every dimension that shows something there."""
    rows = scan(spark, sf_dir)
    change = rows.where("prev_close is not null").select("entity", "ts", (F.col("close") / F.col("prev_close") - 1).alias("change"))
    return technical.interesting_values(rows, ["entity", "ts"]).join(change, ["entity", "ts"])


# Set operations.
query("setop_union", lambda s, d: views.bars(s, d).select("entity", "ts").unionByName(views.bars(s, d, "p_type").select("entity", "ts")), "entity ts", "union_q", {"union_q": "select entity, ts from bars union all select entity, ts from bars_type"})
query("setop_except", lambda s, d: views.bench_bars(s, d).select("ts").exceptAll(views.bars(s, d).where("entity = 'Brand#11'").select("ts")), "ts", "except_q", {"except_q": "select ts from bench except select ts from bars where entity = 'Brand#11'"})
query("setop_distinct", lambda s, d: views.market_events(s, d).select("entity", "event_type", "direction").distinct(), "entity event_type direction", "distinct_q", {"distinct_q": "select distinct entity, event_type, direction from ev"})

__all__ = ["ORACLE_SQL", "QUERIES", "sql"]
