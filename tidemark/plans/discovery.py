"""Queries over the search for setups and conditions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import asof, discovery as dis, ladder, technical
from tidemark.operators import ledger as led
from tidemark.plans import knowledge, market, study
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick
from tidemark.shared import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HORIZON = 5
#: Setups are searched among bullish states: prices here are noise about a mean, so pooled with bearish ones they cancel.
BEARISH = ("DOWN", "NEGATIVE", "BREAKOUT_DOWN", "OVEREXTENDED_LOW", "PULLBACK_IN_DOWNTREND", "UNDERPERFORMING", "BEARISH_STACK", "LOWER_HIGHS_LOWER_LOWS", "GAP_DOWN", "BELOW_VWAP_PROXY", "NEAR_SUPPORT", "LOWER_RANGE", "FALLING")
DIMS = {"regime": ("NORMAL",), **{d: (*skip, *BEARISH) for d, skip in technical.DEFAULT_VALUES.items()}}
BOUNDARY = "1999-01-01"
CONTEXTS = ("regime", "prior_return_bucket", "vol_bucket")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned bars with their states, the market's regime and the abnormal return after HORIZON days."""
    bars, bench = views.bars(spark, sf_dir), views.bench_bars(spark, sf_dir)
    rows = stored(market.scan(spark, sf_dir).select("entity", F.col("ts").alias("as_of"), F.concat_ws("|", "entity", F.col("ts").cast("long").cast("string")).alias("observation_id"), *technical.DEFAULT_VALUES), "scan")
    placed = asof.with_market(rows, bench, (0, -60), "as_of").withColumn("regime", asof.regime(F.col("b_m60"), F.col("b_p0")))
    asked = rows.select(F.col("observation_id").alias("event_id"), "entity", F.col("as_of").alias("published_at"))
    known = asof.abnormal_returns(asked, bars, bench, (HORIZON,)).select(F.col("event_id").alias("observation_id"), "realized")
    return placed.join(known, "observation_id")


def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dis.setup_escalation(observed(spark, sf_dir), DIMS)


def stated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved cases of the ledger with the states of the last bar on or before their time."""
    cases = study.resolved_ledger(spark, sf_dir)
    states = stored(market.states(spark, sf_dir).select("entity", "ts", *technical.DEFAULT_VALUES), "states")
    # The last bar's time is found as its close would be.
    bars = states.select("entity", "ts", F.col("ts").cast("double").alias("close"))
    asked = cases.select("event_id", "entity", "published_at").distinct()
    last = asof.asof_close(asked, bars, "published_at", "bar").select("event_id", F.col("bar").cast("timestamp").alias("ts"))
    return cases.join(last, "event_id").join(states, ["entity", "ts"])


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dis.research_tree(stored(stated_cases(spark, sf_dir), "stated"), technical.DEFAULT_VALUES, CONTEXTS, F.lit(0.0))


def climbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of the ledger's contexts, judged before BOUNDARY and, where they pay, from then on."""
    return ladder.evidence_ladder(stored(study.listed(study.resolved_ledger(spark, sf_dir)), "listed"), study.KEYS, F.lit(BOUNDARY).cast("timestamp"))


def _of_note(table: str, dims: dict, keys: str) -> str:
    """Rows (keys, dimension, value) of what is no default."""
    skip = " or ".join(f"(dimension = '{d}' and value in ({', '.join(repr(v) for v in ('UNKNOWN', *vs))}))" for d, vs in dims.items())
    return f"select {keys}, dimension, value from (unpivot {table} on {', '.join(dims)} into name dimension value value) where not ({skip})"


def _tests(of: str, base: str, few: str, keys: str = "") -> dict[str, str]:
    """From {of} with prior_n, prior_mean, prior_sd: {of}_p with p and status, and where keys are given Holm within them."""
    half = "(" + " + ".join([repr(led.Z), *(f"{term!r} / pow(prior_n - 1, {i})" for i, term in enumerate(led.QUANTILE, 1))]) + ") * prior_sd / sqrt(prior_n)"
    rows = f"select *, {study._P} as p from (select *, prior_mean - ({base}) as gap, atan(abs((prior_mean - ({base})) / (nullif(prior_sd, 0) / sqrt(prior_n))) / sqrt(prior_n - 1)) as theta from {of})"
    status = f"case when prior_n < 15 then '{few}' when abs(gap) < 0.003 then 'REJECTED_ECONOMICALLY_TRIVIAL' when p < 0.05 then 'CONFIRMED' else 'REJECTED_NOT_SIGNIFICANT' end"
    mean = "case when prior_n >= 15 then prior_mean end as mean_effect"
    return {f"{of}_p": f"select * exclude (gap, theta), prior_n as n, {mean}, case when prior_n >= 15 then prior_mean - {half} end as ci_low, case when prior_n >= 15 then prior_mean + {half} end as ci_high, {status} as status from ({rows})"}


def _holm(of: str, family: str, tie: str) -> dict[str, str]:
    by = f"partition by {family}, p is null" if family else "partition by p is null"
    of_all = f"partition by {family}" if family else ""
    steps = f"select *, (count(p) over ({of_all}) - row_number() over ({by} order by p, {tie}) + 1) * p as raw from {of}_p"
    return {f"{of}_h": f"select * exclude (status), case when status = 'CONFIRMED' and p_holm >= 0.05 then 'REJECTED_NOT_SIGNIFICANT' else status end as status from (select *, case when p is not null then least(1.0, max(raw) over ({by} order by p, {tie})) end as p_holm from ({steps}))"}


_STATS = "count(realized) as prior_n, avg(realized) as prior_mean, stddev_samp(realized) as prior_sd"
_DIMS = ", ".join(technical.DEFAULT_VALUES)
_POS = f"list_position({list(DIMS)}, {{}})"
_G = "event_type, direction, horizon_days"


def _ladder() -> str:
    parts, reached = [], "true"
    gates = []
    for s in dis.SEGMENTS:
        low = s.lower()
        parts += [f"case when {reached} then coalesce({low}.n, 0) end as {low}_n", f"case when {reached} then {low}.mean_effect end as {low}_effect", f"case when {reached} then {low}.p end as {low}_p", f"case when {reached} then coalesce({low}.status, 'INSUFFICIENT_N') end as {low}_status"]
        side = "true" if s == "TRAIN" else f"(train.mean_effect - b) * ({low}.mean_effect - b) > 0"
        reached = f"{reached} and coalesce({low}.status = 'CONFIRMED' and {side}, false)"
        gates.append(reached)
    cleared = "case " + " ".join(f"when {g} then '{c}'" for g, c in reversed(list(zip(gates, dis.CLEARED)))) + " end as cleared"
    joins = " ".join(f"left join esc_all {s.lower()} on c.cand = {s.lower()}.cand and {s.lower()}.segment = '{s}'" for s in dis.SEGMENTS)
    return f"select condition, arity, b as train_baseline, 2 * abs(b) as invalidation_pct, {', '.join(parts)}, {cleared}, case when {reached} then 'TEST_VALIDATED' else 'REJECTED' end as status from esc_c c {joins}, esc_base"


_LKEYS = ", ".join(study.KEYS)
_HALF = "(" + " + ".join([repr(led.Z), *(f"{term!r} / pow(n - 1, {i})" for i, term in enumerate(led.QUANTILE, 1))]) + ") * sd / sqrt(n)"


def _money(of: str, prefix: str) -> str:
    return f"""select {_LKEYS}, n as {prefix}_n, mean as {prefix}_expectancy, case when n >= 2 then mean - {_HALF} end as {prefix}_low, case when lost > 0 then coalesce(won, 0) / lost end as {prefix}_profit_factor from (
      select {_LKEYS}, count(net) as n, avg(net) as mean, stddev_samp(net) as sd, sum(net) filter (net > 0) as won, -sum(net) filter (net <= 0) as lost from {of} group by all)"""


def _ladders() -> dict[str, str]:
    early = f"select * from listed where published_at < timestamp '{BOUNDARY}' and realized is not null"
    out = {"lad_e": early, "lad_t": f"select {_LKEYS}, {_STATS} from lad_e group by all"} | _tests("lad_t", "0.0", "INSUFFICIENT_N")
    out["lad_h"] = f"select {_LKEYS}, (avg(realized) filter (rn <= m // 2) > 0) = (avg(realized) filter (rn > m // 2) > 0) as stable from (select *, row_number() over (partition by {_LKEYS} order by published_at, event_id) as rn, count(*) over (partition by {_LKEYS}) as m from lad_e) group by all"
    out["lad_1"] = "select *, sign(mean_effect) as side from lad_t_p"
    out["lad_m"] = f"select {_LKEYS}, side * realized - 0.001 as net from lad_e join lad_1 using ({_LKEYS}) where side <> 0"
    out["lad_v"] = _money("lad_m", "validate")
    pays = "coalesce({0}_n >= 15 and {0}_expectancy > 0 and {0}_low > 0{1}, false)"
    ok = ["status = 'CONFIRMED'", "coalesce(stable, false)", pays.format("validate", " and coalesce(validate_profit_factor > 1, true)")]
    out["lad_f"] = f"""select *, case when {ok[0]} and {ok[1]} and {ok[2]} then 'ECONOMICALLY_SUPPORTED' when {ok[0]} and {ok[1]} then 'SHADOW' when {ok[0]} then 'STATISTICALLY_SUPPORTED' else 'DISCOVERED' end as state,
      case when not {ok[0]} then 'significance: ' || status when not {ok[1]} then 'temporal stability' when not {ok[2]} then case when coalesce(validate_n, 0) < 15 then 'too few trades before the boundary' else 'economics before the boundary' end end as why
      from lad_1 join lad_h using ({_LKEYS}) left join lad_v using ({_LKEYS})"""
    out["lad_l"] = f"select {_LKEYS}, side * realized - 0.001 as net from listed join lad_f using ({_LKEYS}) where state = 'ECONOMICALLY_SUPPORTED' and published_at >= timestamp '{BOUNDARY}' and realized is not null"
    out["lad_x"] = _money("lad_l", "test")
    test = pays.format("test", "")
    out["lad_q"] = f"""select *, case when state = 'ECONOMICALLY_SUPPORTED' and {test} then 'TEST_VALIDATED' else state end as reached_state,
      case when state = 'ECONOMICALLY_SUPPORTED' and not {test} then case when coalesce(test_n, 0) < 15 then 'too few trades from the boundary on' else 'economics from the boundary on' end else why end as rejection_reason from lad_f left join lad_x using ({_LKEYS})"""
    out["lad_s"] = f"select s as reached_state, (select count(*) from lad_q where reached_state = s) as n from (select unnest({list(ladder.STATES)}) as s)"
    return out


_LADDER = _ladders()
TABLES = knowledge.TABLES | {
    "esc_obs": f"""select *, case when rn <= floor(m * 0.4) then 'TRAIN' when rn <= floor(m * 0.4) + floor(m * 0.3) then 'VALIDATE' when rn <= floor(m * 0.4) + floor(m * 0.3) + floor(m * 0.15) then 'SHADOW' else 'TEST' end as segment
      from (select *, row_number() over (order by as_of, id) as rn, count(*) over () as m from (select o.entity || '|' || epoch(o.as_of)::bigint as id, o.as_of, o.realized, {', '.join(f's.{d}' for d in technical.DEFAULT_VALUES)},
      case when m0.close / m60.close - 1 is null then 'UNKNOWN' when m0.close / m60.close - 1 < -0.10 then 'RISK_OFF' when m0.close / m60.close - 1 > 0.10 then 'RISK_ON' else 'NORMAL' end as regime
      from observed o join scan s on o.entity = s.entity and o.as_of = s.ts asof left join bench m0 on o.as_of >= m0.ts asof left join bench m60 on o.as_of - to_days(60) >= m60.ts where o.horizon_days = {HORIZON} and o.realized is not null))""",
    "esc_has": _of_note("esc_obs", DIMS, "id, segment, realized"),
    "esc_base": "select avg(realized) as b from esc_obs where segment = 'TRAIN'",
    "esc_one": f"select dimension, {_STATS} from esc_has where segment = 'TRAIN' group by 1",
} | _tests("esc_one", "(select b from esc_base)", "INSUFFICIENT_N") | _holm("esc_one", "", "dimension") | {
    "esc_top": f"select dimension, value, {_POS.format('dimension')} as i from (select dimension, value, row_number() over (partition by dimension order by count(*) desc, value) as k from esc_has where segment = 'TRAIN' group by 1, 2) where k = 1 and dimension in (select dimension from esc_one_h where status = 'CONFIRMED')",
    "esc_c": """select * from (select *, row_number() over (order by arity, i, j) as cand from (select dimension || '=' || value as condition, 1 as arity, i, 0 as j, [dimension || '=' || value] as parts from esc_top
      union all select a.dimension || '=' || a.value || '&' || b.dimension || '=' || b.value, 2, a.i, b.i, [a.dimension || '=' || a.value, b.dimension || '=' || b.value] from esc_top a join esc_top b on a.i < b.i)) where cand <= 40""",
    "esc_hit": "select cand, id, segment, any_value(realized) as realized from esc_has h join (select cand, arity, unnest(parts) as part from esc_c) c on h.dimension || '=' || h.value = c.part group by 1, 2, 3 having count(*) = any_value(arity)",
    "esc_sum": f"select cand, segment, {_STATS} from esc_hit group by 1, 2",
    "esc_train": "select * from esc_sum where segment = 'TRAIN'",
} | _tests("esc_sum", "(select b from esc_base)", "INSUFFICIENT_N") | _tests("esc_train", "(select b from esc_base)", "INSUFFICIENT_N") | _holm("esc_train", "", "cand") | {
    "esc_all": "select cand, segment, n, mean_effect, p_holm as p, status from esc_train_h union all select cand, segment, n, mean_effect, p, status from esc_sum_p where segment <> 'TRAIN'",
    "esc_q": _ladder(),
    "case_states": f"select l.*, {', '.join(f't.{d}' for d in technical.DEFAULT_VALUES)} from (select * from full_ledger where outcome_status = 'OK') l asof join tech t on l.entity = t.entity and l.published_at >= t.ts",
    "tree_long": _of_note("case_states", dict(technical.DEFAULT_VALUES), f"{_G}, published_at, realized, {', '.join(CONTEXTS)}"),
    "tree_one": f"select {_G}, dimension, {_STATS} from tree_long group by all",
} | _tests("tree_one", "0.0", "REJECTED_INSUFFICIENT_N") | _holm("tree_one", _G, "dimension") | {
    "tree_in": f"select * from tree_long semi join (select * from tree_one_h where status = 'CONFIRMED') using ({_G}, dimension)",
    "tree_two": f"""select * from (select *, row_number() over (partition by {_G}, dimension order by n_all desc, value) as k from (select {_G}, dimension, value, count(*) as n_all, count(realized) filter (published_at < last_at) as prior_n, avg(realized) filter (published_at < last_at) as prior_mean,
      stddev_samp(realized) filter (published_at < last_at) as prior_sd from (select *, max(published_at) over (partition by {_G}, dimension, value) as last_at from tree_in) group by all)) where k <= 4""",
} | _tests("tree_two", "0.0", "REJECTED_INSUFFICIENT_N") | {
    "tree_deep": f"select {_G}, dimension, value, published_at, realized, context, context_value from (unpivot (select * from tree_in semi join (select * from tree_two_p where status = 'CONFIRMED') using ({_G}, dimension, value)) on {', '.join(CONTEXTS)} into name context value context_value)",
    "tree_three": f"""select * from (select *, row_number() over (partition by {_G}, dimension, value, context order by n_all desc, context_value) as k from (select {_G}, dimension, value, context, context_value, count(*) as n_all, count(realized) filter (published_at < last_at) as prior_n,
      avg(realized) filter (published_at < last_at) as prior_mean, stddev_samp(realized) filter (published_at < last_at) as prior_sd from (select *, max(published_at) over (partition by {_G}, dimension, value, context, context_value) as last_at from tree_deep) group by all)) where k <= 1""",
} | _tests("tree_three", "0.0", "REJECTED_INSUFFICIENT_N") | {
    **_LADDER,
    "tree_q": f"""select {_G}, 1 as level, dimension, null as value, null as context, null as context_value, n, mean_effect, ci_low, ci_high, p, p_holm, status from tree_one_h
      union all select {_G}, 2, dimension, value, null, null, n, mean_effect, ci_low, ci_high, p, null, status from tree_two_p
      union all select {_G}, 3, dimension, value, context, context_value, n, mean_effect, ci_low, ci_high, p, null, status from tree_three_p""",
}


def query(name: str, make: Query, columns: str, table: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES)


query("evidence_ladder", climbing, f"{' '.join(study.KEYS)} n ~mean_effect ~p validate_n ~validate_expectancy ~validate_low ~validate_profit_factor test_n ~test_expectancy ~test_low reached_state rejection_reason", "lad_q")
query("evidence_states", lambda s, d: ladder.state_counts(climbing(s, d)), "reached_state n", "lad_s")
query("setup_escalation", escalated, "condition arity ~train_baseline ~invalidation_pct " + " ".join(f"{s.lower()}_n ~{s.lower()}_effect ~{s.lower()}_p {s.lower()}_status" for s in dis.SEGMENTS) + " cleared status", "esc_q")
query("research_tree", tree, "event_type direction horizon_days level dimension value context context_value n ~mean_effect ~ci_low ~ci_high ~p ~p_holm status", "tree_q")

__all__ = ["ORACLE_SQL", "QUERIES"]
