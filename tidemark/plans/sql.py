"""SQL for DuckDB over the given tables: named table expressions, and what each needs."""

from __future__ import annotations

import re

from tidemark.operators.technical import DEFAULT_VALUES

_E = "partition by entity order by ts"


def _rows(frame: str, by: str = _E) -> str:
    return f"over ({by} rows between {frame})"


def _last(n: int) -> str:
    return _rows(f"{n - 1} preceding and current row")


def _prior(n: int) -> str:
    return _rows(f"{n} preceding and 1 preceding")


def _bars(of: str, entity: str) -> str:
    order = "order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    return f"""select {entity} as entity, date_trunc('day', l_shipdate)::timestamp as ts, first(price {order}) as open, max(price) as high,
      min(price) as low, last(price {order}) as close, sum(l_quantity) as volume
    from (select *, 1000 + l_extendedprice / 1000 as price from lineitem) l {of} group by 1, 2"""


def _state(x: str, up: float, above: str, down: float, below: str, between: str) -> str:
    return f"case when {x} is null then 'UNKNOWN' when {x} > {up} then '{above}' when {x} < {down} then '{below}' else '{between}' end"


def _trend(enough: str, average: str, then: str) -> str:
    return f"case when not ({enough}) then 'UNKNOWN' when close > {average} and {average} > {then} then 'UP' when close < {average} and {average} < {then} then 'DOWN' else 'FLAT' end"


def _bins(x: str, edges: tuple[tuple[float, float, str], ...]) -> str:
    return "case " + " ".join(f"when {x} >= {a} and {x} < {b} then '{label}'" for a, b, label in edges) + " else 'UNKNOWN' end"


_HIST = "range between interval 320 days preceding and current row"
_PRIOR = ((-1.0, -0.08, "LARGE_DECLINE"), (-0.08, -0.02, "MILD_DECLINE"), (-0.02, 0.02, "FLAT"), (0.02, 0.08, "MILD_GAIN"), (0.08, 1.0, "LARGE_GAIN"))
_VOL = ((0.0, 0.015, "LOW_VOL"), (0.015, 0.035, "NORMAL_VOL"), (0.035, 10.0, "HIGH_VOL"))

TABLES: dict[str, str] = {
    "bars": _bars("join part on l_partkey = p_partkey", "p_brand"),
    "bars_type": _bars("join part on l_partkey = p_partkey", "p_type"),
    "bench": _bars("", "'ALL'"),
    "bench_r": f"""select ts as bench_ts, case when count(*) over (order by ts {_HIST}) > 20
      then (close - lag(close, 20) over (order by ts)) / lag(close, 20) over (order by ts) end as bench_return from bench""",
    "t1": f"""select *, count(*) over ({_E} {_HIST}) as n, row_number() over ({_E}) as rn, lag(close) over ({_E}) as prev_close from bars""",
    "t2": f"""select *, avg(close) {_last(20)} as sma20, avg(close) {_last(50)} as sma50, avg(close) {_last(200)} as sma200,
      lag(close, 20) over ({_E}) as base20, stddev_samp(close) {_last(20)} as sd20, max(high) {_prior(20)} as high20,
      min(low) {_prior(20)} as low20, lag(open) over ({_E}) as p_open, lag(high) over ({_E}) as p_high, lag(low) over ({_E}) as p_low,
      greatest(high - low, abs(high - prev_close), abs(low - prev_close)) as tr, avg(volume) {_prior(20)} as vol20,
      sum(case when volume <> 0 then (high + low + close) / 3 * volume end) {_last(20)} as tv20,
      sum(case when volume <> 0 then volume end) {_last(20)} as v20,
      max(high) {_rows("39 preceding and 20 preceding")} as h1, min(low) {_rows("39 preceding and 20 preceding")} as l1,
      max(high) {_last(20)} as h2, min(low) {_last(20)} as l2,
      avg(case when high > low then ((close - low) - (high - close)) / (high - low) end) {_last(10)} as clv,
      avg(close * volume) {_last(20)} as dv20, avg(close * volume) {_last(60)} as dv60,
      avg(close) {_rows("19 preceding and current row", "partition by entity, rn % 5 order by ts")} as w20 from t1""",
    "t3": f"""select *, lag(sma20, 10) over ({_E}) as sma20_then, avg(tr) {_last(5)} as atr5, avg(tr) {_last(20)} as atr20,
      lag(w20, 10) over (partition by entity, rn % 5 order by ts) as w20_then from t2""",
    "t4": f"""select t3.*, bench_return, {_trend("n >= 30", "sma20", "sma20_then")} as trend_direction,
      {_trend("ceil(n / 5.0) >= 30", "w20", "w20_then")} as weekly_trend, case when n >= 20 then sma20 end as trend_ma20,
      case when n >= 30 then (sma20 - sma20_then) / sma20_then end as ma_slope_pct,
      case when n >= 21 then (close - base20) / base20 end as momentum_roc_20d,
      case when n >= 20 and sd20 > 0 then (close - sma20) / sd20 end as mean_reversion_zscore,
      case when n >= 21 then (high20 - close) / high20 end as from_high, case when n >= 21 then (close - low20) / low20 end as from_low,
      case when n >= 21 and atr20 > 0 then atr5 / atr20 end as atr_ratio,
      case when n >= 21 and vol20 > 0 then volume / vol20 end as relative_volume_raw,
      case when n >= 20 and v20 > 0 then tv20 / v20 end as vwap_proxy_20d,
      case when n >= 2 then (open - prev_close) / prev_close end as gap_pct,
      case when n >= 21 then (close - base20) / base20 - bench_return end as relative_strength_20d,
      case when n >= 10 then clv end as clv_raw, case when n >= 60 and dv60 > 0 then dv20 / dv60 end as liquidity_ratio
      from t3 asof left join bench_r on t3.ts >= bench_r.bench_ts""",
    "tech": f"""select *, {_state("ma_slope_pct", 0.01, "RISING", -0.01, "FALLING", "FLAT")} as ma_slope_state,
      {_state("momentum_roc_20d", 0.02, "POSITIVE", -0.02, "NEGATIVE", "FLAT")} as momentum_state,
      {_state("mean_reversion_zscore", 2, "OVEREXTENDED_HIGH", -2, "OVEREXTENDED_LOW", "NORMAL")} as mean_reversion_state,
      case when n < 21 then 'UNKNOWN' when close > high20 then 'BREAKOUT_UP' when close < low20 then 'BREAKOUT_DOWN' else 'NONE' end as breakout_state,
      case when n < 21 then 'UNKNOWN' when from_high <= 0.02 then 'NEAR_RESISTANCE' when from_low <= 0.02 then 'NEAR_SUPPORT' else 'MID_RANGE' end as support_resistance_state,
      case when n < 21 or trend_direction = 'UNKNOWN' then 'UNKNOWN' when trend_direction = 'UP' and from_high between 0.02 and 0.10 then 'PULLBACK_IN_UPTREND'
        when trend_direction = 'DOWN' and from_low between 0.02 and 0.10 then 'PULLBACK_IN_DOWNTREND' else 'NONE' end as pullback_state,
      case when n < 2 then 'UNKNOWN' when high <= p_high and low >= p_low then 'INSIDE_BAR' when high >= p_high and low <= p_low then 'OUTSIDE_BAR'
        when close > open and prev_close < p_open and close >= p_open and open <= prev_close then 'BULLISH_ENGULFING'
        when close < open and prev_close > p_open and close <= p_open and open >= prev_close then 'BEARISH_ENGULFING' else 'NONE' end as price_action_pattern,
      {_state("atr_ratio", 1.3, "EXPANSION", 0.7, "COMPRESSION", "NORMAL")} as volatility_state,
      {_state("relative_volume_raw", 1.5, "HIGH_RVOL", 0.5, "LOW_RVOL", "NORMAL_RVOL")} as relative_volume_state,
      {_state("((close - vwap_proxy_20d) / vwap_proxy_20d)", 0.005, "ABOVE_VWAP_PROXY", -0.005, "BELOW_VWAP_PROXY", "AT_VWAP_PROXY")} as vwap_state,
      case when n < 200 then 'UNKNOWN' when sma20 > sma50 and sma50 > sma200 then 'BULLISH_STACK' when sma20 < sma50 and sma50 < sma200 then 'BEARISH_STACK' else 'MIXED_STACK' end as ma_stack,
      case when n < 40 then 'UNKNOWN' when h2 > h1 and l2 > l1 then 'HIGHER_HIGHS_HIGHER_LOWS' when h2 < h1 and l2 < l1 then 'LOWER_HIGHS_LOWER_LOWS' else 'MIXED' end as market_structure,
      {_state("gap_pct", 0.02, "GAP_UP", -0.02, "GAP_DOWN", "NO_GAP")} as gap_state,
      {_state("relative_strength_20d", 0.02, "OUTPERFORMING", -0.02, "UNDERPERFORMING", "IN_LINE")} as relative_strength_state,
      {_state("clv_raw", 0.3, "UPPER_RANGE", -0.3, "LOWER_RANGE", "MID_RANGE")} as clv_state,
      {_state("liquidity_ratio", 1.3, "HIGH_LIQUIDITY", 0.7, "LOW_LIQUIDITY", "NORMAL_LIQUIDITY")} as liquidity_regime,
      case when trend_direction not in ('UP', 'DOWN') or weekly_trend not in ('UP', 'DOWN') then 'UNKNOWN' when trend_direction = weekly_trend then 'CONFIRMED' else 'CONFLICTED' end as mtf_confirmation
      from t4""",
    "scan": "select * from tech where (rn - 1) % 5 = 0",
    "scan_long": "select entity, ts, dimension, value from (unpivot scan on " + ", ".join(DEFAULT_VALUES) + " into name dimension value value)",
    "interesting": "select * from scan_long where " + " and ".join(f"not (dimension = '{d}' and value in ({', '.join(repr(v) for v in vs)}))" for d, vs in DEFAULT_VALUES.items()),
    "ev": """select o_orderkey as event_id, p_brand as entity, o_orderpriority as event_type,
      case o_orderstatus when 'O' then 'positive' when 'F' then 'negative' when 'P' then 'unclear' end as direction,
      c_mktsegment as source, o_orderdate as published_at
      from orders join (select l_orderkey, min(row(l_linenumber, l_partkey, l_suppkey)) as k from lineitem group by 1) f on o_orderkey = l_orderkey
      join part on p_partkey = k[2] join customer on c_custkey = o_custkey""",
    "asked": "select ev.*, h as horizon_days, published_at + to_days(h) as until from ev, (values (1), (5), (20), (60)) hs(h)",
    "priced": """select a.*, b0.close as p0, b1.close as p1, m0.close as m0, m1.close as m1 from asked a
      asof left join bars b0 on a.entity = b0.entity and a.published_at >= b0.ts
      asof left join bars b1 on a.entity = b1.entity and a.until >= b1.ts
      asof left join bench m0 on a.published_at >= m0.ts asof left join bench m1 on a.until >= m1.ts""",
    "ledger": """select * exclude (p0, p1, m0, m1, until), p1 / p0 - 1 as entity_return, m1 / m0 - 1 as bench_return,
      (p1 / p0 - 1) - (m1 / m0 - 1) as realized,
      case when (p1 / p0 - 1) - (m1 / m0 - 1) is null then 'INSUFFICIENT_DATA' else 'OK' end as outcome_status from priced""",
    "known": "select * from ledger where outcome_status = 'OK' and realized is not null",
    "base": "select horizon_days, coalesce(avg(abs(realized)), 0.02) as baseline from known group by 1",
    "pred": """select ledger.*, case direction when 'positive' then 1.0 when 'negative' then -1.0 else 0.0 end * baseline as predicted_impact,
      case when baseline is null then 'INSUFFICIENT_PRECEDENT' else 'MEDIUM' end as predicted_confidence
      from ledger left join base using (horizon_days)""",
    "signs": """select *, case when predicted_impact > 0 then 1 when predicted_impact < 0 then -1 else 0 end as ps,
      case when realized > 0.005 then 1 when realized < -0.005 then -1 else 0 end as rs from pred""",
    "scored": """select * exclude (error_type), error_type, case when error_type not in ('DATA_ERROR', 'INSUFFICIENT_DATA') then realized - predicted_impact end as error_value,
      error_type in ('WRONG_DIRECTION', 'WRONG_MAGNITUDE') as may_learn from (select *,
      case when outcome_status <> 'OK' or realized is null then 'DATA_ERROR'
        when predicted_confidence = 'INSUFFICIENT_PRECEDENT' or predicted_impact is null then 'INSUFFICIENT_DATA'
        when ps <> 0 and rs <> 0 and ps <> rs then 'WRONG_DIRECTION'
        when abs(realized - predicted_impact) / greatest(abs(realized), 0.005) > 0.5 then 'WRONG_MAGNITUDE' else 'OK' end as error_type from signs)""",
    "deduped": """select * exclude (k) from (select *, row_number() over (partition by entity, published_at, horizon_days, event_type, direction order by event_id) as k from scored) where k = 1""",
    "groups": """select event_type, direction, horizon_days, count(realized) as n, avg(realized) as mean_effect, stddev_samp(realized) as sd, 0.0::double as baseline
      from deduped where outcome_status = 'OK' group by all""",
    "tested": """select * exclude (gap, theta, inside), case when n < 15 then 'INSUFFICIENT_N' when abs(gap) < 0.003 then 'REJECTED_ECONOMICALLY_TRIVIAL'
        when p < 0.05 then 'CONFIRMED' else 'REJECTED_NOT_SIGNIFICANT' end as status from (
      select *, case when n < 2 then null when sd > 0 then greatest(0.0, 1 - inside) when gap = 0 then 1.0 else 0.0 end as p from (
      select *, case when (n - 1) % 2 = 1 then 2 / pi() * (theta + sin(theta) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k:
            exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos(theta), 2 * k + 1))))
          else sin(theta) * list_sum(list_transform(range(0, (n - 1) // 2), lambda k:
            exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * pow(cos(theta), 2 * k))) end as inside from (
      select *, mean_effect - baseline as gap, case when sd > 0 then (mean_effect - baseline) / (sd / sqrt(n)) end as t,
        atan(abs((mean_effect - baseline) / (sd / sqrt(n))) / sqrt(n - 1)) as theta from groups where n > 3)))""",
    "corrected": """select *, least(1.0, max(raw) over (partition by horizon_days order by p, event_type, direction)) as p_holm from (
      select *, (count(*) over (partition by horizon_days) - row_number() over (partition by horizon_days order by p, event_type, direction) + 1) * p as raw from tested)""",
    "ranked": """select *, rank() over (partition by event_type, horizon_days order by predicted_impact) + (count(*) over (partition by event_type, horizon_days, predicted_impact) - 1) / 2 as rank_p,
      rank() over (partition by event_type, horizon_days order by realized) + (count(*) over (partition by event_type, horizon_days, realized) - 1) / 2 as rank_r
      from deduped where outcome_status = 'OK'""",
    "trades": "select *, ps * realized as raw_return, ps * realized - 0.001 as after_cost from deduped where outcome_status = 'OK'",
    "curve": """select *, least(0.0, equity - greatest(0.0, max(equity) over (partition by horizon_days order by published_at, event_id rows unbounded preceding))) as drawdown from (
      select *, sum(after_cost) over (partition by horizon_days order by published_at, event_id rows unbounded preceding) as equity from trades)""",
    "ctx": f"""select e.event_id, e.entity, e.published_at, {", ".join(f"p{o}.close as p{o}" for o in (0, 1, 5, 10, 15, 20, 60))}, m0.close as m0, m20.close as m20, m60.close as m60 from ev e
      {" ".join(f"asof left join bars p{o} on e.entity = p{o}.entity and e.published_at - to_days({o}) >= p{o}.ts" for o in (0, 1, 5, 10, 15, 20, 60))}
      {" ".join(f"asof left join bench m{o} on e.published_at - to_days({o}) >= m{o}.ts" for o in (0, 20, 60))}""",
    "context": f"""select *, case when m0 / m60 - 1 is null then 'UNKNOWN' when m0 / m60 - 1 < -0.10 then 'RISK_OFF' when m0 / m60 - 1 > 0.10 then 'RISK_ON' else 'NORMAL' end as regime,
      p0 / p1 - 1 as r1, p0 / p5 - 1 as r5, p0 / p20 - 1 as r20, p0 / p60 - 1 as r60, m0 / m20 - 1 as bench_r20,
      case when p0 is not null and p5 is not null and p10 is not null and p15 is not null and p20 is not null then
        list_aggregate([p15 / p20 - 1, p10 / p15 - 1, p5 / p10 - 1, p0 / p5 - 1], 'stddev_samp') end as realized_vol from ctx""",
    "contexts": f"select *, {_bins('r5', _PRIOR)} as prior_return_bucket, {_bins('realized_vol', _VOL)} as vol_bucket from context",
    "full_ledger": "select d.*, c.regime, c.prior_return_bucket, c.vol_bucket from deduped d join contexts c using (event_id)",
}


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """The final query with all table expressions that it needs, in order."""
    known = TABLES | (extra or {})
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(known[name])
                if name not in order:
                    order.append(name)

    need(final)
    ctes = ",\n".join(f"{n} as ({known[n]})" for n in order)
    return f"with {ctes}\n{final}" if ctes else final


def pick(table: str, columns: str, extra: dict[str, str] | None = None, where: str = "") -> str:
    """Columns of a table; ~ marks floating-point ones, which are rounded to 6 places."""
    parts = [f"round({c[1:]}, 6) + 0.0 as {c[1:]}" if c.startswith("~") else c for c in columns.split()]
    return sql(f"select {', '.join(parts)} from {table}{where and ' where ' + where}", extra)
