"""Queries over the walk forward. What is learnt checkpoint by checkpoint has no SQL: a replay case by case checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import hypotheses as hyp, ledger as led, walkforward as walk
from tidemark.plans import knowledge, market, study
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick
from tidemark.shared import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events at all horizons with their segment of the walk."""
    segments = walk.walk_segments(views.market_events(spark, sf_dir)).select("event_id", "segment")
    return stored(market.ledger(spark, sf_dir).join(segments, "event_id"), "walk")


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walkforward_static(outcomes(spark, sf_dir))


def learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What checkpoints make of relationships, the scored static predictions, and cases under their conditions."""
    events = stored(walk.walk_segments(views.market_events(spark, sf_dir)), "events")
    # Burn-in outcomes give baselines, all of them; of what is scored, one event per real event is looked up.
    real = market.real_events(events.where("segment <> 'BURN_IN'"))
    bars, bench = market.series(spark, sf_dir)
    rows = stored(market.ledger_of(events.where("segment = 'BURN_IN'").unionByName(real), bars, bench), "walk")
    walked = stored(walk.walkforward_static(rows), "walked")
    context = market.context_of(real, bars, bench).select("event_id", *hyp.CONTEXT)
    cases = stored(led.outcome_known(walked).join(context, "event_id"), "cases")
    return walk.governed_checkpoints(cases, hyp.known_values(hyp.CONTEXT), walk.burn_in_baseline(rows)), walked, study.listed(cases)


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.governance_log(learnt(spark, sf_dir)[0])


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the static agent, and of the one that uses what was active after the last checkpoint before each case."""
    known, walked, listed = learnt(spark, sf_dir)
    cases = led.outcome_known(walked)
    found = walk.active_at(known, listed).drop("version")
    adaptive = led.classify_error(hyp.adaptive_predict(cases.drop("error_type", "error_value", "may_learn"), found)).withColumn("agent", F.lit("ADAPTIVE"))
    return walk.scores(cases.unionByName(adaptive.select(*cases.columns)))


def moded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved predictions of three rules: one size, sizes by priority, and the latter for urgent events alone."""
    way = F.when(F.col("direction") == "positive", 1.0).when(F.col("direction") == "negative", -1.0).otherwise(0.0)
    urgent = F.col("event_type").isin("1-URGENT", "2-HIGH")
    sized = way * F.when(urgent, 0.04).otherwise(0.01)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), x.alias("predicted_impact")) for m, x in (("A", way * 0.02), ("B", sized), ("C", F.when(urgent, sized)))])
    rows = knowledge.resolved_log(spark, sf_dir).select("event_id", "published_at", "horizon_days", "realized", F.inline(modes))
    return stored(rows.withColumn("predicted_confidence", F.lit("MEDIUM")), "modes")


TABLES = knowledge.TABLES | {
    "mode_rows": """select l.event_id, l.published_at, l.horizon_days, l.realized, m.mode, case m.mode when 'A' then way * 0.02 when 'B' then way * size when 'C' then case when size = 0.04 then way * size end end as predicted_impact
      from (select *, case direction when 'positive' then 1.0 when 'negative' then -1.0 else 0.0 end as way, case when event_type in ('1-URGENT', '2-HIGH') then 0.04 else 0.01 end as size from log_q) l, (values ('A'), ('B'), ('C')) m(mode)""",
    "mode_known": "select *, sign(predicted_impact)::int as ps, case when realized > 0.005 then 1 when realized < -0.005 then -1 else 0 end as rs, sign(predicted_impact) * realized - 0.001 as net from mode_rows where predicted_impact is not null",
    "mode_ranked": """select *, rank() over (partition by mode, horizon_days order by predicted_impact) + (count(*) over (partition by mode, horizon_days, predicted_impact) - 1) / 2 as rank_p,
      rank() over (partition by mode, horizon_days order by realized) + (count(*) over (partition by mode, horizon_days, realized) - 1) / 2 as rank_r, sum(net) over (partition by mode, horizon_days order by published_at, event_id rows unbounded preceding) as equity from mode_known""",
    "mode_drawn": "select *, equity - greatest(0.0, max(equity) over (partition by mode, horizon_days order by published_at, event_id rows unbounded preceding)) as drawdown from mode_ranked",
    "mode_q": """select mode, horizon_days, count(*) as n, (select count(*) from mode_rows x where x.mode = d.mode and x.horizon_days = d.horizon_days and x.predicted_impact is null) as excluded, avg((ps = rs)::int) filter (ps <> 0 and rs <> 0) as direction_accuracy,
      avg(abs(predicted_impact - realized)) as mae, corr(rank_p, rank_r) as spearman, avg(pow(0.65 - (ps = rs)::int, 2)) as brier, count(*) as n_trades, avg(ps * realized) as expected_value, sum(net) as total_return_after_costs,
      least(0.0, min(drawdown)) as max_drawdown, avg(net) / stddev_samp(net) as sharpe_per_trade from mode_drawn d group by 1, 2""",
    "walk_events": "select event_id, case when rn <= floor(m * 0.2) then 'BURN_IN' when rn > m - floor(m * 0.2) then 'FINAL_HOLDOUT' else 'DEVELOPMENT' end as segment from (select event_id, row_number() over (order by published_at, event_id) as rn, count(*) over () as m from ev)",
    "walk_base": "select horizon_days, coalesce(avg(abs(realized)) filter (segment = 'BURN_IN' and outcome_status = 'OK'), 0.02) as baseline from ledger join walk_events using (event_id) group by 1",
    "walk_rows": """select l.*, segment, case direction when 'positive' then 1.0 when 'negative' then -1.0 else 0.0 end * baseline as predicted_impact, published_at + to_days(horizon_days + 2) as resolve_at
      from ledger l join walk_events using (event_id) join walk_base using (horizon_days) where segment <> 'BURN_IN'""",
    "walk_known": "select *, sign(predicted_impact)::int as ps, case when realized > 0.005 then 1 when realized < -0.005 then -1 else 0 end as rs from walk_rows where outcome_status = 'OK' and realized is not null",
    "walk_ranked": """select *, rank() over (partition by segment, horizon_days order by predicted_impact) + (count(*) over (partition by segment, horizon_days, predicted_impact) - 1) / 2 as rank_p,
      rank() over (partition by segment, horizon_days order by realized) + (count(*) over (partition by segment, horizon_days, realized) - 1) / 2 as rank_r from walk_known""",
    "walk_q": """select 'STATIC' as agent, segment, horizon_days, count(*) as n, case when count(*) filter (ps <> 0 and rs <> 0) >= 2 then avg((ps = rs)::int) filter (ps <> 0 and rs <> 0) end as direction_accuracy,
      avg(abs(predicted_impact - realized)) as mae, sqrt(avg(pow(predicted_impact - realized, 2))) as rmse, corr(rank_p, rank_r) as spearman, avg(pow(0.65 - (ps = rs)::int, 2)) as brier from walk_ranked group by 2, 3""",
    "walk_due": "select event_id, horizon_days, segment, resolve_at, predicted_impact from walk_rows",
}


def query(name: str, make: Query, columns: str, table: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    if table:
        ORACLE_SQL[name] = pick(table, columns, TABLES)


query("walkforward_static", lambda s, d: walk.scores(static(s, d)), "agent segment horizon_days n ~direction_accuracy ~mae ~rmse ~spearman ~brier", "walk_q")
query("walkforward_resolve", static, "event_id horizon_days segment resolve_at ~predicted_impact", "walk_due")
query("mode_report", lambda s, d: led.mode_report(moded(s, d)), "mode horizon_days n excluded ~direction_accuracy ~mae ~spearman ~brier n_trades ~expected_value ~total_return_after_costs ~max_drawdown ~sharpe_per_trade", "mode_q")
query("governed_checkpoints", governed, "checkpoint event_type direction horizon_days condition action new_status promotion_status ~effect n")
query("walkforward_agents", agents, "agent segment horizon_days n ~direction_accuracy ~mae ~rmse ~spearman ~brier")

__all__ = ["ORACLE_SQL", "QUERIES"]
