"""Queries over what is known: observations, relationships and their governance, strategy reports, growing tables, each
with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import asof, hypotheses as hyp, ledger as led, methodology, strategy, technical
from tidemark.plans import followup, market, news, study
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick, sql
from tidemark.shared import stored
from tidemark.sources import filings

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
OBSERVED, LOGGED = (5, 20), (1, 7, 29, 88)
FROM, UNTIL, CUT = "1995-01-01", "1997-01-01", "1998-01-01"
SIMILAR, RISK, PLACEBOS, SEED, MOST_SETUPS = 1, 0.01, 40, 20240601, 40
CONCEPTS = (*followup.CONCEPTS.values(), "momentum", "liquidity")
#: Phrases for the invented prose of the tables, which holds none of the real ones.
PHRASES = {"TREND": ("and the", "of the"), "VOLUME": ("with by", "on the", "by this"), "GAPS": ("is (?:a|an)", "and threea?"), "VWAP": ("vwap",)}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned bars with what came after them: entity, as_of, horizon_days, realized, outcome_status."""
    rows = market.scan(spark, sf_dir).select("entity", F.col("ts").alias("published_at")).withColumn("event_id", F.concat_ws("|", "entity", F.col("published_at").cast("long").cast("string")))
    return asof.abnormal_returns(rows, views.bars(spark, sf_dir), views.bench_bars(spark, sf_dir), OBSERVED).withColumnRenamed("published_at", "as_of")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension tested over all bars where it shows something: outcome after five days against none, with Holm."""
    rows = technical.interesting_values(market.scan(spark, sf_dir), ["entity", "ts"]).withColumnRenamed("ts", "as_of")
    known = observations(spark, sf_dir).where("horizon_days = 5 and outcome_status = 'OK'").select("entity", "as_of", "realized")
    tests = led.one_sample_t(rows.join(known, ["entity", "as_of"]), ["dimension"], "realized")
    tests = led.holm(tests.withColumn("p", F.when(F.col("status") != "INSUFFICIENT_N", F.col("p"))), [], "p", ["dimension"])
    return tests.withColumn("status", F.when((F.col("status") == "CONFIRMED") & (F.col("p_holm") >= 0.05), "REJECTED_NOT_SIGNIFICANT").otherwise(F.col("status")))


def setup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups of the tested dimensions at their most frequent values: single ones, then pairs, up to a fixed number. The
    dimensions are those of the library, so this is a small table."""
    tops = technical.interesting_values(market.scan(spark, sf_dir), ["entity", "ts"]).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    tops = tops.groupBy("dimension").agg(F.max_by("value", F.struct(F.col("n"), F.col("value"))).alias("value"))
    one = stored(tops.join(families(spark, sf_dir).where("n >= 15").select("dimension"), "dimension"), "dimensions")
    single = one.select(F.concat_ws("=", "dimension", "value").alias("condition"), F.lit(1).alias("arity"))
    pairs = one.join(one.select(F.col("dimension").alias("d"), F.col("value").alias("v")), F.col("dimension") < F.col("d")).select(F.concat(F.col("dimension"), F.lit("="), F.col("value"), F.lit("&"), F.col("d"), F.lit("="), F.col("v")).alias("condition"), F.lit(2).alias("arity"))
    return single.unionByName(pairs).withColumn("place", F.row_number().over(Window.orderBy("arity", "condition"))).where(F.col("place") <= MOST_SETUPS)


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = study.resolved_ledger(spark, sf_dir)
    known = stored(study.known(cases), "known")
    held = hyp.revalidated(study.listed(cases), known, F.lit(0.0)).where("status = 'ACTIVE'")
    return known.join(held, [*study.KEYS], "left_semi").where("horizon_days = 20 and event_type = '2-HIGH'")


def concept_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methodology.concept_claims(views.documents(spark, sf_dir), PHRASES)


def concept_methodologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked to one concept."""
    return methodology.methodologies_for_concept(views.documents(spark, sf_dir), methodology.concept_links(concept_claims(spark, sf_dir)), "VOLUME")


def concept_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of agents that may use the relationships of one concept only."""
    cases = study.resolved_ledger(spark, sf_dir)
    found = stored(study.matches(cases), "matches")
    out = None
    for dimension, concept in followup.CONCEPTS.items():
        rows = hyp.adaptive_predict(cases, found.where(F.contains("condition", F.lit(f"{dimension}="))))
        rows = rows.select("horizon_days", "predicted_impact", "realized", "basis", F.lit(concept).alias("agent"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("agent", "horizon_days").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("basis") == "validated_relationship", 1)).alias("informed"), F.avg(F.abs(F.col("predicted_impact") - F.col("realized"))).alias("mae"))


def generalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use of a relationship, and whether its case is of another entity than the event that first confirmed it."""
    cases = study.resolved_ledger(spark, sf_dir)
    tests = stored(study.tested(cases), "tests").where("status = 'CONFIRMED'")
    first = tests.groupBy(*study.KEYS).agg(F.min_by("entity", F.struct("checkpoint", "event_id")).alias("source_entity"), F.min("checkpoint").alias("active_from"))
    used = study.listed(cases).select("event_id", "entity", "published_at", *study.KEYS).join(first, [*study.KEYS])
    return used.where("active_from < published_at").withColumn("generalizes", F.col("entity") != F.col("source_entity"))


def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each test does to the relationship of the same condition: strengthen it where one was confirmed before, else
    create it in shadow; reject what isn't confirmed."""
    tests = stored(study.tested(study.resolved_ledger(spark, sf_dir)), "tests")
    earlier = F.min(F.when(F.col("status") == "CONFIRMED", F.col("checkpoint"))).over(Window.partitionBy(*study.KEYS))
    ok = F.col("status") == "CONFIRMED"
    action = F.when(~ok, "REJECT").when(F.col("checkpoint") > earlier, "STRENGTHEN").otherwise("CREATE")
    return tests.withColumn("action", action).withColumn("new_status", F.when(ok, "SHADOW").otherwise("REJECTED"))


def portfolio_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's prediction means for portfolios that hold its entity. Holdings are shares of a segment's events."""
    counts = views.market_events(spark, sf_dir).groupBy("source", "entity").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("source").agg(F.sum("n").alias("total"))
    held = counts.join(whole, "source").select(F.col("source").alias("portfolio"), "entity", (F.col("n") / F.col("total")).alias("weight"))
    rows = market.deduped(spark, sf_dir).where("horizon_days = 20 and predicted_impact is not null").select("event_id", "entity", "predicted_impact")
    return rows.join(held, "entity").withColumn("impact", F.col("weight") * F.col("predicted_impact"))


def update_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by the span between confirmations in which they were made. Confirmations come at starts of quarters, so
    each quarter's window is found once and cases meet it by equality."""
    cases = study.resolved_ledger(spark, sf_dir)
    cases = cases.withColumn("quarter", F.date_trunc("quarter", "published_at"))
    went = study.known(cases.drop("quarter")).select(F.col("active_from").alias("quarter"), F.col("active_from").alias("start")).distinct()
    every = cases.select("quarter", F.lit(None).cast("timestamp").alias("start")).distinct().unionByName(went).groupBy("quarter").agg(F.max("start").alias("start"))
    every = every.withColumn("window_start", F.last("start", True).over(Window.orderBy("quarter"))).drop("start")
    p, r = led.sign(F.col("predicted_impact")), led.sign(F.col("realized"), led.MOVE)
    return cases.join(every, "quarter").groupBy("window_start", "horizon_days").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted_impact") - F.col("realized"))).alias("mae"), F.avg(F.when((p != 0) & (r != 0), (p == r).cast("double"))).alias("direction_accuracy"))


def incremental_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where relationships predict: do outcomes differ from the baseline model's prediction of the same case?"""
    cases = study.resolved_ledger(spark, sf_dir).withColumn("static", F.col("predicted_impact"))
    rows = study.adaptive(cases).where("basis = 'validated_relationship'").withColumn("gap", F.col("realized") - F.col("static"))
    return led.one_sample_t(rows, ["horizon_days"], "gap")


def graded(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    """Reports of trades by horizon, regime or chronological segment."""
    trades = study.outcomes(spark, sf_dir)
    if "regime" in keys:
        trades = trades.join(market.context(spark, sf_dir).select("event_id", "regime"), "event_id")
    if "segment" in keys:
        trades = trades.join(led.chrono_segments(views.market_events(spark, sf_dir), "published_at", "event_id").select("event_id", "segment"), "event_id")
    return strategy.strategy_report(trades, keys)


def placebos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades at random bars of each entity, on random sides: outcomes without any evidence behind them."""
    bars = views.bars(spark, sf_dir)
    roll = strategy.draw(F.lit(SEED), F.col("entity"), (F.col("ts").cast("long") / 86400).cast("long"))
    rows = bars.select("entity", "ts", roll.alias("roll")).withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("roll", "ts"))).where(F.col("k") <= PLACEBOS)
    trades = rows.select("entity", F.col("ts").alias("published_at"), "k", F.lit(20).alias("horizon_days"), F.when(F.col("roll") % 2 == 0, "LONG").otherwise("SHORT").alias("action"), F.lit(None).cast("double").alias("invalidation_level"))
    found = strategy.trade_outcomes(strategy.trade_paths(trades, bars, ["entity", "k"]), ["entity", "k"])
    return strategy.strategy_report(found, ["action"])


def security_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event and horizon: the adaptive prediction, similar earlier cases, novelty, half the width of the
    relationship's interval, and whether there is precedent."""
    cases = study.resolved_ledger(spark, sf_dir)
    known = stored(study.known(cases), "known")
    found = hyp.applicable(study.listed(cases).select("event_id", "published_at", *study.KEYS, "n_keys"), known)
    rows = hyp.adaptive_predict(cases, found)
    spread = known.select(*study.KEYS, (1.96 * F.col("effect_sd") / F.sqrt("n_supporting")).alias("uncertainty"))
    rows = rows.join(spread, [*study.KEYS], "left").join(market.similar_cases(spark, sf_dir).select("event_id", "horizon_days", "n_cases"), ["event_id", "horizon_days"])
    validated = F.col("basis") == "validated_relationship"
    status = F.when(validated, "OK").when(F.col("predicted_impact").isNull() | (F.col("n_cases") < SIMILAR), "INSUFFICIENT_PRECEDENT").otherwise("OK")
    return rows.withColumns({"status": status, "novelty": 1 / (1 + F.col("n_cases"))})


def decision_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships as rules of decision: setup, regime, stop at twice the baseline, exit at the horizon tested, risk. One
    whose condition names only the regime is no setup."""
    cases = study.resolved_ledger(spark, sf_dir)
    known = study.known(cases).withColumn("pairs", F.split("condition", "&"))
    setup = F.element_at(F.filter("pairs", lambda x: ~x.startswith("regime=")), -1)
    regime = F.get(F.filter("pairs", lambda x: x.startswith("regime=")), 0)
    base = led.baseline_magnitude(led.outcome_known(cases))
    rows = known.where(F.exists("pairs", lambda x: ~x.startswith("regime="))).withColumns({"setup": setup, "regime": regime}).join(base, "horizon_days", "left")
    return rows.withColumns({"invalidation": 2 * F.col("baseline"), "risk": F.lit(RISK)})


def resolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of logged predictions at each horizon that has passed by a fixed day and whose prices are known."""
    rows = asof.abnormal_returns(views.market_events(spark, sf_dir), views.bars(spark, sf_dir), views.bench_bars(spark, sf_dir), LOGGED)
    due = F.col("published_at") + F.make_interval(days=F.col("horizon_days"))
    return rows.where((due <= F.lit(CUT).cast("timestamp")) & F.col("realized").isNotNull())


def concept_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests by concept and status, with zeros for concepts that nothing was tested on."""
    concept = F.create_map(*[F.lit(x) for kv in followup.CONCEPTS.items() for x in kv])
    rows = followup.tested(spark, sf_dir).withColumn("concept", F.explode(F.transform(F.split("condition", "&"), lambda p: concept[F.split(p, "=")[0]])))
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    counts = rows.groupBy("concept").agg(count("CONFIRMED"), count("INSUFFICIENT_N"), F.count(F.when(F.col("status").startswith("REJECTED"), 1)).alias("rejected"))
    every = spark.createDataFrame([(c,) for c in CONCEPTS], "concept string")
    return every.join(counts, "concept", "left").fillna(0)


def rolling_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = led.latest_n(study.resolved_ledger(spark, sf_dir), ["regime", "horizon_days"], [F.col("published_at").desc(), F.col("event_id").desc()], (50, 100, 250, 500))
    return rows.groupBy("regime", "horizon_days", F.col("window").alias("last_n")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted_impact") - F.col("realized"))).alias("mae"))


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as news items: the address as title and link, the page as description, the host as publisher."""
    pages = views.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return filings.news_documents(pages.select(F.col("url").alias("title"), F.col("url").alias("link"), F.col("html").alias("description"), host.alias("publisher"), F.lit(FROM).cast("timestamp").alias("published_at"), host.alias("entity")))


def outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes to write, and the table of those written before."""
    rows = led.outcome_known(market.ledger(spark, sf_dir)).select("event_id", "horizon_days", "published_at", "realized")
    return rows, rows.where(F.col("published_at") < F.lit(CUT).cast("timestamp"))


def latest_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return filings.latest_state(rows, ["user_id"], ["ts", "event_id"], ["value"])


_ON = ", ".join(study.KEYS)
_HASH = f"{study._DRAW.format(f"'{SEED}|' || entity || '|' || (epoch(ts) / 86400)::bigint")}"
_TEST = f"""select *, case when p is not null then least(1.0, max(raw) over (order by p, name)) end as p_holm from (select *, (count(p) over () - row_number() over (order by p, name) + 1) * p as raw from (
  select *, {study._P} as p from (select *, prior_mean as gap, atan(abs(prior_mean / (nullif(prior_sd, 0) / sqrt(prior_n))) / sqrt(prior_n - 1)) as theta from {{}})))"""


def _report(of: str, by: str) -> str:
    return f"""select {by}, n_trades, expectancy, win_rate, case when lost < 0 then won / abs(lost) end as profit_factor, case when down > 0 then expectancy / down end as sortino_per_trade, mean_mfe, mean_mae from (select {by}, count(*) as n_trades, avg(net) as expectancy,
      avg((net > 0)::int) as win_rate, sum(net) filter (net > 0) as won, sum(net) filter (net <= 0) as lost, sqrt(avg(pow(least(net, 0), 2))) as down, avg(mfe) as mean_mfe, avg(mae) as mean_mae from (select *, realized_return - 0.001 as net from {of}) group by {by}) where n_trades >= 2"""


def _later(of: str, at: str, horizons: tuple[int, ...]) -> str:
    return f"""select s.*, (p1.close / p0.close - 1) - (m1.close / m0.close - 1) as realized from (select *, {at} + to_days(horizon_days) as due from {of}, (values {', '.join(f'({h})' for h in horizons)}) h(horizon_days)) s
      asof left join bars p0 on s.entity = p0.entity and s.{at} >= p0.ts asof left join bars p1 on s.entity = p1.entity and s.due >= p1.ts asof left join bench m0 on s.{at} >= m0.ts asof left join bench m1 on s.due >= m1.ts"""


TABLES = followup.TABLES | {
    "observed": _later("(select entity, ts as as_of from scan)", "as_of", OBSERVED),
    "observed_q": f"select * from observed where realized is not null and horizon_days = 20 and as_of >= timestamp '{FROM}' and as_of < timestamp '{UNTIL}'",
    "family_v": "select dimension as name, count(*) as prior_n, avg(realized) as prior_mean, stddev_samp(realized) as prior_sd from interesting i join observed o on i.entity = o.entity and i.ts = o.as_of where horizon_days = 5 and realized is not null group by 1",
    "family_t": _TEST.format("family_v"),
    "family_q": "select name as dimension, prior_n as n, prior_mean as mean_effect, p, p_holm, case when prior_n < 15 then 'INSUFFICIENT_N' when abs(prior_mean) < 0.003 then 'REJECTED_ECONOMICALLY_TRIVIAL' when p_holm < 0.05 then 'CONFIRMED' else 'REJECTED_NOT_SIGNIFICANT' end as status from family_t",
    "topped": "select dimension, value, dimension || '=' || value as c from (select dimension, value, row_number() over (partition by dimension order by count(*) desc, value desc) as k from interesting group by 1, 2) where k = 1 and dimension in (select name from family_v where prior_n >= 15)",
    "setups_q": f"select * from (select *, row_number() over (order by arity, condition) as place from (select c as condition, 1 as arity from topped union all select a.c || '&' || b.c, 2 from topped a join topped b on a.dimension < b.dimension)) where place <= {MOST_SETUPS}",
    "active_q": f"select r.* from relations r join again_q a using ({_ON}) where a.status = 'ACTIVE' and horizon_days = 20 and event_type = '2-HIGH'",
    "concept_q": "select d.agent, d.horizon_days, count(*) as n, count(b.event_id) as informed, avg(abs(coalesce(b.effect_estimate, d.predicted_impact) - d.realized)) as mae from (select *, unnest(['market_regime', 'prior_move', 'volatility']) as agent from deduped where outcome_status = 'OK') d "
    "left join (select * from (select *, row_number() over (partition by agent, event_id, horizon_days order by n_keys desc, n_supporting desc, condition) as k from (select *, unnest(list_filter([case when contains(condition, 'regime=') then 'market_regime' end, case when contains(condition, 'prior_return_bucket=') then 'prior_move' end, case when contains(condition, 'vol_bucket=') then 'volatility' end], lambda a: a is not null)) as agent from matched)) where k = 1) b "
    "on d.agent = b.agent and d.event_id = b.event_id and d.horizon_days = b.horizon_days group by 1, 2",
    "general_q": f"select l.event_id, {', '.join('l.' + k for k in study.KEYS)}, source_entity, l.entity <> source_entity as generalizes from listed l join (select {_ON}, arg_min(entity, row(checkpoint, event_id)) as source_entity, min(checkpoint) as active_from from judged where verdict = 'CONFIRMED' group by all) r using ({_ON}) where active_from < l.published_at",
    "governed_q": f"select *, verdict as status, case when verdict <> 'CONFIRMED' then 'REJECT' when checkpoint > min(checkpoint) filter (verdict = 'CONFIRMED') over (partition by {_ON}) then 'STRENGTHEN' else 'CREATE' end as action, case when verdict = 'CONFIRMED' then 'SHADOW' else 'REJECTED' end as new_status from judged",
    "held": "select source as portfolio, entity, count(*) / sum(count(*)) over (partition by source) as weight from ev group by 1, 2",
    "impact_q": "select event_id, portfolio, weight, weight * predicted_impact as impact from deduped join held using (entity) where horizon_days = 20 and predicted_impact is not null",
    "spans_q": """select window_start, horizon_days, count(*) as n, avg(abs(predicted_impact - realized)) as mae, avg((ps = rs)::int) filter (ps <> 0 and rs <> 0) as direction_accuracy from (select d.*, r.active_from as window_start from full_ledger d
      asof left join (select distinct active_from from relations) r on d.published_at >= r.active_from where outcome_status = 'OK') group by 1, 2""",
    "gain_v": "select horizon_days as name, count(*) as prior_n, avg(d.realized - d.predicted_impact) as prior_mean, stddev_samp(d.realized - d.predicted_impact) as prior_sd from deduped d join best b using (event_id, horizon_days) where outcome_status = 'OK' group by 1",
    "gain_q": f"select name as horizon_days, prior_n as n, prior_mean as mean_effect, p, case when prior_n < 15 then 'INSUFFICIENT_N' when abs(prior_mean) < 0.003 then 'REJECTED_ECONOMICALLY_TRIVIAL' when p < 0.05 then 'CONFIRMED' else 'REJECTED_NOT_SIGNIFICANT' end as status from ({_TEST.format('gain_v')})",
    "report_q": _report("outcomes_q", "horizon_days"),
    "by_regime_q": _report("(select o.*, c.regime from outcomes_q o join contexts c using (event_id))", "regime"),
    "segments_v": "select event_id, case when rn <= floor(n * 0.4) then 'TRAIN' when rn <= floor(n * 0.4) + floor(n * 0.3) then 'VALIDATE' when rn <= floor(n * 0.4) + floor(n * 0.3) + floor(n * 0.15) then 'SHADOW' else 'TEST' end as segment from (select event_id, row_number() over (order by published_at, event_id) as rn, count(*) over () as n from ev)",
    "by_segment_q": _report("(select o.*, c.segment from outcomes_q o join segments_v c using (event_id))", "segment"),
    "rolled": f"select *, case when roll % 2 = 0 then 'LONG' else 'SHORT' end as action from (select *, row_number() over (partition by entity order by roll, ts) as k from (select entity, ts, {_HASH} as roll from bars)) where k <= {PLACEBOS}",
    "rolled_p": "select r.entity, r.k, r.action, b.ts, b.high, b.low, b.close, first_value(b.close) over (partition by r.entity, r.k order by b.ts) as entry_price from rolled r join bars b on r.entity = b.entity and b.ts between r.ts and r.ts + interval 20 days",
    "rolled_o": """select entity, k, first(action) as action, (case first(action) when 'LONG' then 1 else -1 end) * (arg_max(close, ts) / first(entry_price) - 1) as realized_return, max(case action when 'LONG' then high / entry_price - 1 else 1 - low / entry_price end) as mfe,
      min(case action when 'LONG' then low / entry_price - 1 else 1 - high / entry_price end) as mae from rolled_p group by 1, 2 having count(*) >= 2""",
    "placebo_q": _report("rolled_o", "action"),
    "counted": "select a.event_id, a.horizon_days, count(b.event_id) as n_cases from full_ledger a left join (select * from full_ledger where outcome_status = 'OK') b on a.event_type = b.event_type and a.horizon_days = b.horizon_days and a.regime = b.regime and a.prior_return_bucket = b.prior_return_bucket and b.published_at + to_days(b.horizon_days) < a.published_at group by 1, 2",
    "spread": f"select {_ON}, 1.96 * arg_max(prior_sd, row(checkpoint, event_id)) / sqrt(arg_max(prior_n, row(checkpoint, event_id))) as uncertainty from judged where verdict = 'CONFIRMED' group by all",
    "security_q": f"select a.event_id, a.horizon_days, a.predicted_impact, a.predicted_confidence, s.uncertainty, n_cases, 1 / (1 + n_cases) as novelty, case when basis = 'validated_relationship' then 'OK' when predicted_impact is null or n_cases < {SIMILAR} then 'INSUFFICIENT_PRECEDENT' else 'OK' end as status from adapted a join counted c using (event_id, horizon_days) left join spread s using ({_ON})",
    "process_q": f"select *, list_filter(pairs, lambda x: x not like 'regime=%')[-1] as setup, list_filter(pairs, lambda x: x like 'regime=%')[1] as regime, 2 * baseline as invalidation, {RISK} as risk from (select *, string_split(condition, '&') as pairs from relations) left join (select horizon_days, coalesce(avg(abs(realized)), 0.02) as baseline from full_ledger where outcome_status = 'OK' group by 1) using (horizon_days) where len(list_filter(pairs, lambda x: x not like 'regime=%')) > 0",
    "log_v": _later("ev", "published_at", LOGGED),
    "log_q": f"select * from log_v where due <= timestamp '{CUT}' and realized is not null",
    "summed_q": f"""select concept, count(*) filter (verdict = 'CONFIRMED') as confirmed, count(*) filter (verdict = 'INSUFFICIENT_N') as insufficient_n, count(*) filter (verdict like 'REJECTED%') as rejected from (select unnest({list(CONCEPTS)}) as concept)
      left join (select verdict, unnest(list_transform(string_split(condition, '&'), lambda c: case string_split(c, '=')[1] {followup._CONCEPT} end)) as concept from judged) using (concept) group by 1""",
    "regimes_q": """select regime, horizon_days, w as last_n, count(*) as n, avg(abs(predicted_impact - realized)) as mae from (select *, row_number() over (partition by regime, horizon_days order by published_at desc, event_id desc) as rn from full_ledger where outcome_status = 'OK'),
      (values (50), (100), (250), (500)) ws(w) where rn <= w group by 1, 2, 3""",
    "paged": r"select trim(url) as title, url, coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ''), trim(url)) as body, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as publisher from pages where trim(url) <> ''",
    "paged_q": f"select 'news:' || substr(sha256({news._SQUEEZE.format('title')} || '|' || substr({news._SQUEEZE.format('url')}, 1, 400)), 1, 24) as source_id, publisher, body, case when lower(trim(publisher)) in {filings.WIRES} then 'SECONDARY' else 'TERTIARY' end as reliability from paged",
    "users_q": "select user_id, max(ts) as ts, arg_max(event_type, row(ts, event_id)) as event_type, arg_max(value, row(ts, event_id)) filter (value is not null) as value from events group by 1",
    "before_q": f"select * from (select *, row_number() over (partition by entity order by published_at desc, event_id desc) as k from ev where published_at < timestamp '{CUT}') where k = 1",
}


def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.market_events(spark, sf_dir).where(F.col("published_at") < F.lit(CUT).cast("timestamp"))
    return rows.groupBy("entity").agg(F.max_by(F.struct("event_id", "published_at"), F.struct("published_at", "event_id")).alias("x")).select("entity", "x.*")


def query(name: str, make: Query, columns: str, table: str, where: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES, where)


_KEYS = " ".join(study.KEYS)
_REPORT = "n_trades ~expectancy ~win_rate ~profit_factor ~sortino_per_trade ~mean_mfe ~mean_mae"
query("query_observations", lambda s, d: observations(s, d).where(f"outcome_status = 'OK' and horizon_days = 20 and as_of >= timestamp'{FROM}' and as_of < timestamp'{UNTIL}'"), "entity as_of ~realized", "observed_q")
query("family_screen", families, "dimension n ~mean_effect ~p ~p_holm status", "family_q")
query("setup_candidates", setup_candidates, "condition arity place", "setups_q")
query("active_relationships", active, f"{_KEYS} ~effect_estimate n_supporting active_from", "active_q")
query("by_status", lambda s, d: followup.tested(s, d).where("status = 'CONFIRMED'"), f"{_KEYS} event_id checkpoint", "judged", "verdict = 'CONFIRMED'")
query("unresolved_by_horizon", lambda s, d: market.ledger(s, d).where("outcome_status <> 'OK'"), "event_id horizon_days", "ledger", "outcome_status <> 'OK'")
query("lookup_by_id", lambda s, d: views.market_events(s, d).where("event_id = 7"), "event_id entity event_type direction published_at", "ev", "event_id = 7")
query("concept_filter", concept_agents, "agent horizon_days n informed ~mae", "concept_q")
query("generalization_case", generalizations, f"event_id {_KEYS} source_entity generalizes", "general_q")
query("governance_apply", governance, f"{_KEYS} event_id checkpoint status action new_status", "governed_q")
query("portfolio_impact", portfolio_impact, "event_id portfolio ~weight ~impact", "impact_q")
query("update_windows", update_windows, "window_start horizon_days n ~mae ~direction_accuracy", "spans_q")
query("incremental_test", incremental_test, "horizon_days n ~mean_effect ~p status", "gain_q")
query("strategy_report", lambda s, d: graded(s, d, ("horizon_days",)), f"horizon_days {_REPORT}", "report_q")
query("regime_report", lambda s, d: graded(s, d, ("regime",)), f"regime {_REPORT}", "by_regime_q")
query("segment_degradation", lambda s, d: graded(s, d, ("segment",)), f"segment {_REPORT}", "by_segment_q")
query("placebo_pool", placebos, f"action {_REPORT}", "placebo_q")
query("predict_for_security", security_predictions, "event_id horizon_days status ~predicted_impact predicted_confidence ~uncertainty n_cases ~novelty", "security_q")
query("decision_process", decision_process, f"{_KEYS} setup regime ~invalidation ~risk ~effect_estimate", "process_q")
query("resolve_horizons", resolved_log, "event_id horizon_days ~realized", "log_q")
query("concept_summary", concept_summary, "concept confirmed insufficient_n rejected", "summed_q")
query("rolling_by_dimension", rolling_by_regime, "regime horizon_days last_n n ~mae", "regimes_q")
query("scan_news_items", news_items, "source_id publisher body reliability", "paged_q")
query("insert_if_absent", lambda s, d: filings.insert_if_absent(*outcomes(s, d), ["event_id", "horizon_days"]), "event_id horizon_days ~realized", "known", f"published_at >= timestamp '{CUT}'")
query("rejected_outcomes", lambda s, d: filings.rejected_outcomes(*outcomes(s, d), ["event_id", "horizon_days"]), "event_id horizon_days", "known", f"published_at < timestamp '{CUT}'")
query("latest_state", latest_by_user, "user_id ts event_type ~value", "users_q")
query("latest_before", latest_before, "entity event_id published_at", "before_q")

_FINDS = "regexp_matches(lower(coalesce(body, '')), '(^|[^a-z0-9_])({})($|[^a-z0-9_])')"
_CLAIMS = " union all ".join(f"select source_id, '{c}' as concept, case {' '.join(f'when {_FINDS.format(p)} then {chr(39)}{p}{chr(39)}' for p in found)} end as phrase from docs_v" for c, found in PHRASES.items())
ORACLE_SQL |= {name: sql(final, news.TABLES | {"linked": f"select * from ({_CLAIMS}) where phrase is not null"}) for name, final in {
    "concept_tagging": "select source_id, concept, phrase from docs_v left join linked using (source_id)",
    "concept_links": "select source_id, concept, phrase from linked",
    "methodologies_for_concept": "select source_id, publisher, phrase from docs_v join linked using (source_id) where concept = 'VOLUME'",
    "concept_coverage": "select concept, count(distinct source_id) as n_sources from docs_v left join linked using (source_id) group by 1",
}.items()}
QUERIES |= {
    "concept_tagging": lambda s, d: concept_claims(s, d).select("source_id", "concept", "phrase"),
    "concept_links": lambda s, d: methodology.concept_links(concept_claims(s, d)),
    "methodologies_for_concept": lambda s, d: concept_methodologies(s, d).select("source_id", "publisher", "phrase"),
    "concept_coverage": lambda s, d: methodology.concept_coverage(concept_claims(s, d)),
}

__all__ = ["ORACLE_SQL", "QUERIES"]
