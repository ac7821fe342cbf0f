"""Queries over hypotheses, relationships, predictions from them, and trades, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import hypotheses as hyp, ledger as led, strategy
from tidemark.plans.market import Query, full_ledger, resolved, take
from tidemark.plans.sql import pick
from tidemark.shared import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = (*hyp.GROUP, "condition")
REPLICATES = 2000
SHADOW_UNTIL = "1998-06-01"
MARGINS = (1.0, 2.0, 5.0, 10.0)


def query(name: str, make: Query, columns: str, table: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES)


def resolved_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved cases with their contexts. Written once, as what follows reads them two or three times."""
    return stored(full_ledger(spark, sf_dir).where("outcome_status = 'OK'"), "ledger")


def listed(cases: DataFrame) -> DataFrame:
    """Resolved cases under each condition that they meet."""
    return hyp.listed_by_context(cases)


def prior(cases: DataFrame) -> DataFrame:
    return hyp.prior_statistics(listed(cases))


def checkpoints(cases: DataFrame) -> DataFrame:
    """Of each condition's learnable errors in a quarter the last, with the statistics before it."""
    quarter = F.date_trunc("quarter", "published_at")
    rows = hyp.last_errors(cases, quarter).withColumn("quarter", quarter)
    return rows.withColumn("checkpoint", F.col("quarter") + F.expr("interval 3 months"))


def tested(cases: DataFrame) -> DataFrame:
    return hyp.hypothesis_tests(checkpoints(cases), F.col("predicted_impact"), ["quarter", "horizon_days"])


def known(cases: DataFrame) -> DataFrame:
    return hyp.relationships(tested(cases), time_col="checkpoint")


def matches(cases: DataFrame) -> DataFrame:
    return hyp.applicable(listed(cases).select("event_id", "published_at", *KEYS, "n_keys"), known(cases))


def adaptive(cases: DataFrame) -> DataFrame:
    return hyp.adaptive_predict(cases, matches(cases))


def agents(cases: DataFrame) -> DataFrame:
    """Mean absolute errors of the baseline model, of relationships of one key only, and of all."""
    found = stored(matches(cases), "matches")
    models = {"static": cases, "one_key": hyp.adaptive_predict(cases, found.where("n_keys = 1")), "adaptive": hyp.adaptive_predict(cases, found)}
    rows = [m.select("horizon_days", "predicted_impact", "realized", F.lit(name).alias("agent")) for name, m in models.items()]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.groupBy("agent", "horizon_days").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted_impact") - F.col("realized"))).alias("mae"))


def support(cases: DataFrame) -> DataFrame:
    rows = adaptive(cases).where("condition is not null")
    right, moved = led.sign(F.col("predicted_impact")) == led.sign(F.col("realized"), led.MOVE), led.sign(F.col("realized"), led.MOVE) != 0
    out = rows.groupBy(*KEYS).agg(F.count(F.when(right, 1)).alias("supported"), F.count(F.when(moved & ~right, 1)).alias("contradicted"))
    n = F.col("supported") + F.col("contradicted")
    return out.withColumn("is_decaying", (n >= 5) & (F.col("contradicted") / F.greatest(n, F.lit(1)) > 0.5))


def shadow_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships on the cases since they were confirmed."""
    cases = resolved_ledger(spark, sf_dir)
    return hyp.shadow_evaluation(listed(cases), stored(known(cases), "known"), F.lit(0.0), F.lit(SHADOW_UNTIL).cast("timestamp"))


def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = resolved_ledger(spark, sf_dir)
    return hyp.revalidated(listed(cases), known(cases), F.lit(0.0))


def priced_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolved(spark, sf_dir).where("predicted_impact <> 0").withColumn("action", F.when(F.col("predicted_impact") > 0, "LONG").otherwise("SHORT")).withColumn("invalidation_level", -2 * F.col("predicted_impact"))
    return strategy.trade_paths(rows.select("event_id", "horizon_days", "entity", "published_at", "action", "invalidation_level"), views.bars(spark, sf_dir), ["event_id", "horizon_days"])


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.trade_outcomes(priced_trades(spark, sf_dir), ["event_id", "horizon_days"])


def decided(cases: DataFrame) -> DataFrame:
    """Every checkpoint's test as a decision, at each margin of costs."""
    half = 1.96 * F.col("prior_sd") / F.sqrt("prior_n")
    rows = tested(cases).withColumn("low", F.col("prior_mean") - half).withColumn("high", F.col("prior_mean") + half)
    rows = rows.withColumn("margin", F.explode(F.array(*[F.lit(m) for m in MARGINS])))
    return strategy.decide(rows, "prior_mean", "low", "high", F.col("margin"))


_ON = "event_type, direction, horizon_days, condition"
_BEFORE = f"(partition by {_ON} order by published_at range between unbounded preceding and interval 1 second preceding)"
_P = """case when prior_n < 15 then null when prior_sd > 0 then greatest(0.0, 1 - case when (prior_n - 1) % 2 = 1 then 2 / pi() * (theta + sin(theta) * list_sum(list_transform(range(0, (prior_n - 2) // 2), lambda k:
            exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos(theta), 2 * k + 1))))
          else sin(theta) * list_sum(list_transform(range(0, (prior_n - 1) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * pow(cos(theta), 2 * k))) end)
        when gap = 0 then 1.0 else 0.0 end"""
_DRAW = "('0x' || substr(md5({}), 1, 8))::bigint"

TABLES = {
    "listed": """select * exclude (vals, idx), array_to_string(list_transform(idx, lambda i: vals[i]), '&') as condition, len(idx) as n_keys from (
      select *, unnest([[1], [2], [3], [1, 2], [1, 3], [2, 3], [1, 2, 3]]) as idx from (select *, list_filter([case when regime <> 'UNKNOWN' then 'regime=' || regime end,
        case when prior_return_bucket <> 'UNKNOWN' then 'prior_return_bucket=' || prior_return_bucket end, case when vol_bucket <> 'UNKNOWN' then 'vol_bucket=' || vol_bucket end], lambda x: x is not null) as vals
        from full_ledger where outcome_status = 'OK')) where list_max(idx) <= len(vals)""",
    "prior": f"select *, count(realized) over {_BEFORE} as prior_n, avg(realized) over {_BEFORE} as prior_mean, stddev_samp(realized) over {_BEFORE} as prior_sd from listed",
    "checks": f"""select *, quarter + interval 3 months as checkpoint from (select *, date_trunc('quarter', published_at)::timestamp as quarter,
      row_number() over (partition by {_ON}, date_trunc('quarter', published_at) order by published_at desc, event_id desc) as k from prior where may_learn) where k = 1""",
    "probed": f"""select *, {_P} as p from (select *, prior_mean - predicted_impact as gap, atan(abs((prior_mean - predicted_impact) / (nullif(prior_sd, 0) / sqrt(prior_n))) / sqrt(prior_n - 1)) as theta
      from checks)""",
    "judged": """select *, case when prior_n < 15 then 'INSUFFICIENT_N' when abs(gap) < 0.003 then 'REJECTED_ECONOMICALLY_TRIVIAL' when p_holm < 0.05 then 'CONFIRMED' else 'REJECTED_NOT_SIGNIFICANT' end as verdict from (
      select *, case when p is not null then least(1.0, max(raw) over (partition by quarter, horizon_days, p is null order by p, event_id, condition)) end as p_holm from (
      select *, (count(p) over (partition by quarter, horizon_days) - row_number() over (partition by quarter, horizon_days, p is null order by p, event_id, condition) + 1) * p as raw from probed))""",
    "judged_q": "select * exclude (verdict), verdict as status from judged",
    "relations": f"""select {_ON}, n_keys, arg_max(prior_mean, row(checkpoint, event_id)) as effect_estimate, arg_max(prior_n, row(checkpoint, event_id)) as n_supporting, min(checkpoint) as active_from, count(*) as confirmations
      from judged where verdict = 'CONFIRMED' group by all""",
    "matched": f"select l.event_id, l.published_at, {', '.join('l.' + c for c in (*hyp.GROUP, 'condition', 'n_keys'))}, r.effect_estimate, r.n_supporting from listed l join relations r using ({_ON}) where r.active_from < l.published_at",
    "best": "select * from (select *, row_number() over (partition by event_id, horizon_days order by n_keys desc, n_supporting desc, condition) as best_k from matched) where best_k = 1",
    "adapted": """select d.* exclude (predicted_impact, predicted_confidence), b.condition, coalesce(b.effect_estimate, d.predicted_impact) as predicted_impact,
      case when b.event_id is null then d.predicted_confidence when b.n_supporting >= 50 then 'HIGH' when b.n_supporting >= 15 then 'MEDIUM' else 'LOW' end as predicted_confidence,
      case when b.event_id is null then 'unconditional_baseline' else 'validated_relationship' end as basis
      from (select * from deduped where outcome_status = 'OK') d left join best b using (event_id, horizon_days)""",
    "single": "select * from (select *, row_number() over (partition by event_id, horizon_days order by n_supporting desc, condition) as k from matched where n_keys = 1) where k = 1",
    "agents_q": """select agent, horizon_days, count(*) as n, avg(abs(predicted_impact - realized)) as mae from (
      select 'static' as agent, horizon_days, predicted_impact, realized from deduped where outcome_status = 'OK' union all select 'adaptive', horizon_days, predicted_impact, realized from adapted
      union all select 'one_key', d.horizon_days, coalesce(s.effect_estimate, d.predicted_impact), d.realized from deduped d left join single s using (event_id, horizon_days) where outcome_status = 'OK') group by 1, 2""",
    "support_q": f"""select *, supported + contradicted >= 5 and contradicted / greatest(supported + contradicted, 1) > 0.5 as is_decaying from (select {_ON},
      count(*) filter (aps = ars) as supported, count(*) filter (ars <> 0 and aps <> ars) as contradicted from (select *, case when predicted_impact > 0 then 1 when predicted_impact < 0 then -1 else 0 end as aps,
        case when realized > 0.005 then 1 when realized < -0.005 then -1 else 0 end as ars from adapted where condition is not null) group by all)""",
    "again": f"""select *, mean_effect as prior_mean, n as prior_n, sd as prior_sd, mean_effect as gap, atan(abs(mean_effect / (nullif(sd, 0) / sqrt(n))) / sqrt(n - 1)) as theta from (
      select {_ON}, count(realized) as n, avg(realized) as mean_effect, stddev_samp(realized) as sd from listed join (select {_ON} from relations) r using ({_ON}) group by all)""",
    "again_q": f"select {_ON}, n, mean_effect, case when n >= 15 and abs(gap) >= 0.003 and {_P} < 0.05 then 'ACTIVE' else 'RETIRED' end as status from again",
    "fresh": f"""select *, mean_effect as prior_mean, n as prior_n, sd as prior_sd, mean_effect as gap, atan(abs(mean_effect / (nullif(sd, 0) / sqrt(n))) / sqrt(n - 1)) as theta from (
      select {_ON}, count(realized) as n, avg(realized) as mean_effect, stddev_samp(realized) as sd from listed join (select {_ON}, active_from from relations) r using ({_ON})
      where published_at >= active_from and published_at < timestamp '{SHADOW_UNTIL}' group by all)""",
    "shadow_q": f"""select {_ON}, active_from, coalesce(n, 0) as n, mean_effect, case when coalesce(n, 0) < 10 then 'STILL_IN_SHADOW' when n >= 15 and abs(gap) >= 0.003 and {_P} < 0.05 then 'ACTIVE' else 'RETIRED' end as outcome
      from (select {_ON}, active_from from relations) r left join fresh using ({_ON})""",
    "paths": """select d.event_id, d.horizon_days, case when predicted_impact > 0 then 'LONG' else 'SHORT' end as action, -2 * predicted_impact as level, b.ts, b.high, b.low, b.close,
      row_number() over (partition by d.event_id, d.horizon_days order by b.ts) - 1 as i, first_value(b.close) over (partition by d.event_id, d.horizon_days order by b.ts) as entry_price
      from deduped d join bars b on d.entity = b.entity and b.ts between d.published_at and d.published_at + to_days(d.horizon_days) where outcome_status = 'OK' and predicted_impact <> 0""",
    "moves": """select *, case action when 'LONG' then high / entry_price - 1 else 1 - low / entry_price end as gain, case action when 'LONG' then low / entry_price - 1 else 1 - high / entry_price end as loss from paths""",
    "outcomes_q": """select event_id, horizon_days, first(action) as action, first(entry_price) as entry_price, arg_max(close, i) as exit_price, (case first(action) when 'LONG' then 1 else -1 end) * (arg_max(close, i) / first(entry_price) - 1) as realized_return,
      max(gain) as mfe, min(loss) as mae, min(i) filter (loss <= level) as invalidation_day, date_diff('day', min(ts), max(ts)) as holding_days from moves group by 1, 2 having count(*) >= 2""",
    "path_q": "select event_id, horizon_days, count(*) as n_bars, min(close) as lowest, max(close) as highest from paths group by 1, 2",
    "decided_q": """select m::double as margin, case when verdict <> 'CONFIRMED' then 'ABSTAIN' when prior_mean - 1.96 * prior_sd / sqrt(prior_n) <= 0 and prior_mean + 1.96 * prior_sd / sqrt(prior_n) >= 0 then 'ABSTAIN'
      when prior_mean is null or abs(prior_mean) < m * 0.001 then 'ABSTAIN' when prior_mean > 0 then 'LONG' else 'SHORT' end as action,
      case when verdict <> 'CONFIRMED' then 'HYPOTHESIS_ONLY' when prior_mean - 1.96 * prior_sd / sqrt(prior_n) <= 0 and prior_mean + 1.96 * prior_sd / sqrt(prior_n) >= 0 then 'CI_SPANS_ZERO'
      when prior_mean is null or abs(prior_mean) < m * 0.001 then 'BELOW_COST_MARGIN' end as abstain_reason from judged, (values (1.0), (2.0), (5.0), (10.0)) ms(m)""",
    "threshold_q": "select margin, action, count(*) as n from decided_q group by 1, 2",
    "reasons_q": "select * from (select margin, abstain_reason, count(*) as n, row_number() over (partition by margin order by count(*) desc, abstain_reason) as k from decided_q where abstain_reason is not null group by 1, 2) where k <= 3",
}

query("hypothesis_generation", lambda s, d: listed(resolved_ledger(s, d)).where("may_learn"), "event_id event_type direction horizon_days condition n_keys", "listed where may_learn")
query("matching_prior_rows", lambda s, d: prior(resolved_ledger(s, d)), "event_id horizon_days condition prior_n ~prior_mean", "prior")
query("hypothesis_batch", lambda s, d: tested(resolved_ledger(s, d)), "event_type direction horizon_days condition quarter prior_n ~gap ~p_holm status", "judged_q")
query("relationships", lambda s, d: known(resolved_ledger(s, d)), "event_type direction horizon_days condition n_keys ~effect_estimate n_supporting active_from confirmations", "relations")
query("applicable_relationships", lambda s, d: matches(resolved_ledger(s, d)), "event_id horizon_days condition n_keys ~effect_estimate n_supporting", "matched")
query("adaptive_predict", lambda s, d: adaptive(resolved_ledger(s, d)), "event_id horizon_days condition ~predicted_impact predicted_confidence basis", "adapted")
query("agent_variants", lambda s, d: agents(resolved_ledger(s, d)), "agent horizon_days n ~mae", "agents_q")
query("support_counts", lambda s, d: support(resolved_ledger(s, d)), "event_type direction horizon_days condition supported contradicted is_decaying", "support_q")
query("shadow_evaluation", shadow_evaluation, "event_type direction horizon_days condition active_from n ~mean_effect outcome", "shadow_q")
query("revalidation", revalidation, "event_type direction horizon_days condition n ~mean_effect status", "again_q")
query("trade_path", lambda s, d: priced_trades(s, d).groupBy("event_id", "horizon_days").agg(F.count(F.lit(1)).alias("n_bars"), F.min("close").alias("lowest"), F.max("close").alias("highest")), "event_id horizon_days n_bars ~lowest ~highest", "path_q")
query("trade_outcome", outcomes, "event_id horizon_days action ~entry_price ~exit_price ~realized_return ~mfe ~mae invalidation_day holding_days", "outcomes_q")
query("decide", lambda s, d: decided(resolved_ledger(s, d)), "~margin action abstain_reason", "decided_q")
query("threshold_sensitivity", lambda s, d: decided(resolved_ledger(s, d)).groupBy("margin", "action").agg(F.count(F.lit(1)).alias("n")), "~margin action n", "threshold_q")
query("abstain_reasons", lambda s, d: decided(resolved_ledger(s, d)).where("abstain_reason is not null").groupBy("margin", "abstain_reason").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("margin").orderBy(F.col("n").desc(), "abstain_reason"))).where("k <= 3"), "~margin abstain_reason n k", "reasons_q")
query("bootstrap_ci", lambda s, d: strategy.bootstrap_interval(strategy.bootstrap_means(resolved(s, d), list(hyp.GROUP), "realized", ["published_at", "event_id"], REPLICATES), list(hyp.GROUP)), "event_type direction horizon_days ~ci_low ~ci_high replicates", "bootstrap_q")
query("permutation_test", lambda s, d: strategy.permutation_p(full_ledger(s, d).where("outcome_status = 'OK'").withColumn("picked", F.expr("regime = 'NORMAL' and vol_bucket = 'HIGH_VOL'")), ["event_type", "horizon_days"], "realized", "picked", "event_id", REPLICATES), "event_type horizon_days n ~deviation ~p", "permutation_q")

# 2000 draws of every row are too slow in other engines: tests hold these two against numpy on small tables.
for name in ("bootstrap_ci", "permutation_test"):
    del ORACLE_SQL[name]

__all__ = ["ORACLE_SQL", "QUERIES"]
