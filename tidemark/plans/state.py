"""Queries over the news state of companies and its assessment, each with its SQL. As in the other news queries, areas and
polarity come from stand-in words, and figures are those of the brand with a company's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import assessment as assess, fundamentals as fun, identity, news_state as ns, research
from tidemark.plans import news, reports
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick
from tidemark.shared import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
EARLIER = "2024-01-20"
#: Headlines given to orders by their number, as the tables' prose has none of this kind.
HEADLINES = ("raises full-year guidance", "cuts outlook", "declares a special dividend", "suspends its quarterly dividend", "opens a plant", "slashes full year forecast", "lifts forecast")
SUFFIXES = ("", " Corp", " Holdings", " Inc", " LLC", " CORPORATION")


def now(day: str = reports.NOW):
    return F.lit(day).cast("timestamp")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline's events with what later steps need of their clause, in place of its text."""
    return ns.clause_facts(reports.timeline(spark, sf_dir, "words"), news.AREAS, F.array("publisher"), F.col("words")).drop("clause", "words")


def clustered(rows: DataFrame, days: int = 4) -> DataFrame:
    """Events about their own company, with the number of their occurrence. rows is read several times: store it."""
    found = F.col("__found")
    return stored(identity.event_instances(rows.where("__own"), unit=found["unit"], value=found["value"], days=days), "clustered")


def built(spark: SparkSession, sf_dir: str, days: int = 4, timeline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of events and their axes. A query that needs the timeline elsewhere too writes what is read of it once and
    gives it."""
    rows = clustered(stored(read(spark, sf_dir).where("__own"), "own") if timeline is None else timeline, days)
    return ns.event_vectors(rows, news.AREAS), ns.event_axes(ns.implications(rows, news.AREAS))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.get(F.array(*[F.lit(h) for h in HEADLINES]), (F.col("event_id") % len(HEADLINES)).cast("int"))
    rows = views.market_events(spark, sf_dir).select("event_id", "entity", "published_at", F.concat("entity", F.lit(" "), told).alias("text"))
    return ns.interpret_items(rows)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("s_suppkey") % len(SUFFIXES)).cast("int"))
    rows = views.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", suffix).alias("name"))
    return rows.withColumn("aliases", F.array_join(ns.name_aliases(F.col("name")), "|"))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ns.attribution(F.col("clause"), F.col("entity"), F.array("publisher"))
    return news.clauses(spark, sf_dir).select("source_id", "clause_index", found.alias("found")).select("source_id", "clause_index", "found.*")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.clauses(spark, sf_dir).withColumn("status", ns.epistemic(F.col("clause"), F.col("source_type")))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the document behind each event."""
    docs = views.documents(spark, sf_dir).select("source_id", "publisher", "reliability", "source_type")
    return reports.timeline(spark, sf_dir).select("event_id", "source_id").join(docs, "source_id")


def implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.implications(reports.timeline(spark, sf_dir), news.AREAS)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.clauses(spark, sf_dir).withColumn("areas", F.array_join(ns.all_areas(F.col("clause"), news.AREAS), ","))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's axes on every day with events, from that day's events."""
    vectors, axes = built(spark, sf_dir, 0)
    return ns.company_axes(vectors, axes, F.col("as_of"), ("entity", "as_of"))


def company_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.company_axes(*built(spark, sf_dir), now())


def company_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.company_state(built(spark, sf_dir)[0], now())


def numbered(rows: DataFrame) -> DataFrame:
    """Brands as companies: Brand#1 is E1, Brand#2 is E2, and so on."""
    return rows.withColumn("entity", F.concat(F.lit("E"), F.substring_index("entity", "#", -1)))


def told(spark: SparkSession, sf_dir: str, timeline: DataFrame | None = None) -> DataFrame:
    """Narratives, with whether all of their events are speculative."""
    rows = stored(reports.timeline(spark, sf_dir).drop("clause"), "timeline") if timeline is None else timeline
    guesses = rows.groupBy(*assess.TOPIC).agg(F.min(F.col("evidence_type") == "SPECULATION").alias("speculative"))
    return ns.same_keys(research.narratives(rows, now()), guesses, assess.TOPIC)


def checked(spark: SparkSession, sf_dir: str, timeline: DataFrame | None = None) -> DataFrame:
    return assess.consistency(told(spark, sf_dir, timeline), numbered(fun.direction(fun.yoy_growth(reports.figures(spark, sf_dir)))))


def found_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.risks(told(spark, sf_dir), numbered(fun.latest(reports.figures(spark, sf_dir))))


def assessed(spark: SparkSession, sf_dir: str, timeline: DataFrame | None = None) -> DataFrame:
    rows = stored(checked(spark, sf_dir, timeline), "checked")
    return assess.assess(rows, assess.risks(rows, numbered(fun.latest(reports.figures(spark, sf_dir)))))


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(read(spark, sf_dir), "timeline")
    vectors, axes = built(spark, sf_dir, timeline=rows)
    mean = ns.company_axes(vectors, axes, now()).groupBy("entity").agg(F.avg("mean").alias("news"))
    sure = ns.company_state(vectors, now()).select("entity", F.col("confidence").alias("news_confidence"))
    return assess.modes(assessed(spark, sf_dir, rows), sure.join(mean, "entity", "left"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(reports.timeline(spark, sf_dir).drop("clause"), "timeline")
    before = research.narratives(rows.where(F.col("published_at") <= now(EARLIER)), now(EARLIER))
    return assess.changes(research.narratives(rows, now()), before)


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's weakly told narrative that comes first, and how many can't be checked or are disputed."""
    weak = (F.col("confidence") == "LOW") | (F.col("independent_sources") <= 1)
    topic = F.concat_ws(":", "event_type", "area")
    return checked(spark, sf_dir).groupBy("entity").agg(F.min(F.when(weak, topic)).alias("weakest"), F.count(F.when(F.col("verdict") == "INSUFFICIENT_EVIDENCE", 1)).alias("unchecked"), F.count(F.when(F.col("trend") == "DISPUTED", 1)).alias("disputed"))


def _r(x: str, places: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e{places} + 0.5e0 + 1e-9) / 1e{places} + 0e0)"


def _has(cues: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower(clause), '{c}')" for c in cues) + ")"


def _case(x: str, labels: dict, default: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v}{'' if isinstance(v, str) else '::double'}" for k, v in labels.items()) + f" else {default} end"


_K = ("entity", "event_type", "area", "cluster")
_ON = " and ".join(f"a.{k} is not distinct from b.{k}" for k in _K)
_KIND = f"case when source_type = 'filing' then 'OBSERVED_FACT' when {_has(ns.SPECULATION_CUES)} then 'SPECULATION' when {_has(ns.MANAGEMENT_CUES)} then 'MANAGEMENT_CLAIM' when {_has(ns.INTERPRETATION_CUES)} then 'ANALYST_INTERPRETATION' else 'THIRD_PARTY_REPORTING' end"
_TERM = "case " + " ".join(f"when {_has(c)} then {i}" for i, c in enumerate(ns.TERMS.values(), 1)) + " else 4 end"
_AREAS = "list_filter([" + ", ".join(f"case when {news._any(w)} then '{a}' end" for a, w in news.AREAS.items()) + "], lambda a: a is not null)"
_RULES = ", ".join(f"({list(n)}, '{axis}', {1 if kind == 'DIRECT' else -1}e0, '{'STATED' if kind == 'DIRECT' else 'INFERRED'}')" for n, axis, kind in ns.RULES)
_TRIGGERS = sorted({a for n, _, _ in ns.RULES for a in n})
_MEAN = "sum(value * weight) / sum(weight)"
_AXES = "[" + ", ".join(f"max(mean) filter (axis = '{a}')" for a in ns.AXES) + "]"
_W = "sum(w * mean) / sum(w)"
_BRAND = "'E' || split_part(entity, '#', 2)"
_GRADE = "case when not {1} then 'INSUFFICIENT_EVIDENCE' " + " ".join(f"when {{0}} >= {least} then '{name}'" for least, name in assess.GRADES) + " else 'NEGATIVE' end"


def _chain(s: str, days: int) -> dict[str, str]:
    """Events to vectors, with clusters of at most `days` between events."""
    weigh = "pow(0.5, greatest(epoch({} - as_of) / 86400, 0) / 7e0) * materiality * (0.3 + 0.7e0 * confirmation)"
    return {
        **reports.occurrences(s, "measured_q", days),
        f"clustered{s}": f"select * exclude (unit, value, pct, bps, usd) from occ{s}",
        f"read{s}": reports.TABLES["found"].replace("(said", "(clause").replace("from figured", f"from clustered{s}"),
        f"weighed{s}": f"""select *, coalesce(case when value < 0 then -1e0 else way end * score, way * 0.5e0) as cs, {_AREAS} as areas, {_case('evidence_type', ns.MODALITY, '1e0')} as weight from (select *,
          case sentiment when 'POSITIVE' then 1e0 when 'NEGATIVE' then -1e0 end as way, coalesce(pct, bps, usd) as value, round(case when pct is not null then {reports._anchored('abs(pct)', 'PERCENT')} when bps is not null then {reports._anchored('abs(bps)', 'BPS')} end, 2)::double as score from read{s})""",
        f"implied{s}": f"""select e.* exclude (value), r.axis, r.factor * cs as value, r.basis from weighed{s} e join (values {_RULES}) r(names, axis, factor, basis) on list_has_any(e.areas, r.names) where cs is not null
          union all select * exclude (value), 'profitability', 1e0, 'INFERRED' from weighed{s} where list_contains(areas, 'workforce') and {_has(ns.SAVING_CUES)}""",
        f"axes{s}": f"""select {', '.join(_K)}, axis, {_r(_MEAN, 2)} as mean, {_r(f'greatest(sum(value * value * weight) / sum(weight) - pow({_MEAN}, 2), 0)', 4)} as dispersion,
          case when min(basis) = max(basis) then min(basis) else 'MIXED' end as basis from implied{s} group by all""",
        f"sources{s}": f"select {', '.join(_K)}, avg(trust) as trust from (select distinct {', '.join(_K)}, source_id, {_case('reliability', ns.TRUST, '0.3e0')} as trust from clustered{s}) group by all",
        f"vectors{s}": f"""select *, {_r(f'(1 - pow(2.718281828e0, -0.7e0 * independent_sources)) * source_quality', 4)} as confirmation from (select a.*, {_r('b.trust', 4)} as source_quality from (select {', '.join(_K)}, max(published_at) as as_of,
          {_r('avg(way)', 4)} as text_sentiment, max({_case('materiality', ns.MATERIALITY, '0.25e0')}) as materiality, avg({_case(f'({_KIND})', ns.CERTAINTY, '0.3e0')}) as certainty,
          arg_min({_KIND}, list_position({list(ns.CERTAINTY)}, {_KIND})) as epistemic_status, {_case(f'min({_TERM})::varchar', {str(i): f"'{t}'" for i, t in enumerate(ns.TERMS, 1)}, "'UNSPECIFIED'")} as time_horizon,
          count(distinct coalesce(duplicate_of, source_id)) as independent_sources, count(*) as clauses, coalesce({_r(f"avg(case when cs is not null and list_has_any(areas, {_TRIGGERS}) then case when score is not null and (value < 0 or way is not null) then 0.85e0 else 0.4e0 end end)", 4)}, 0) as magnitude_confidence
          from weighed{s} group by {', '.join(_K)}) a join sources{s} b on {_ON})""",
        f"heavy{s}": f"select *, {weigh.format(f"timestamp '{reports.NOW}'" if days else 'as_of')} as w from vectors{s}",
        f"loaded{s}": f"select b.*, a.w, a.as_of from heavy{s} a join axes{s} b on {_ON}",
    }


TABLES = reports.TABLES | {
    "own_q": "select t.* from timeline_q t join roles_q r using (source_id, clause_index) where r.attributable",
    "measured_q": "select *, case when pct is not null then 'PERCENT' when bps is not null then 'BPS' when usd is not null then 'USD' end as unit, coalesce(pct, bps, usd) as value from (" + reports.TABLES["found"].replace("(said", "(clause").replace("from figured", "from own_q") + ")",
} | _chain("_v", 4) | _chain("_d", 0) | {
    "items_q": "select * from (select event_id, case " + " ".join(f"when regexp_matches(said, '{'|'.join(p)}') then '{kind}|{way}'" for p, kind, way in ns.ITEM_RULES) + f""" end as hit from (
      select event_id, lower(entity || ' ' || {list(HEADLINES)}[event_id % {len(HEADLINES)} + 1]) as said from ev)) where hit is not null""",
    "names_q": f"""select s_suppkey, name, case when short = name or short = '' then name else name || '|' || short end as aliases from (select *, trim(regexp_replace(name, '(?i) ({'|'.join(ns.NAME_SUFFIXES)})$', '')) as short from (
      select s_suppkey, s_name || {list(SUFFIXES)}[s_suppkey % {len(SUFFIXES)} + 1] as name from supplier))""",
    "words": """select c.*, d.entity, d.publisher, ' ' || regexp_replace(lower(clause), '[^a-z0-9_]+', ' ', 'g') || ' ' as padded, trim(regexp_replace(lower(d.publisher), '[^a-z0-9_]+', ' ', 'g')) as alias,
      trim(regexp_extract(clause, '(?:^|[^A-Za-z0-9_])(?i:""" + "|".join(ns.COMPETITOR_CUES) + r""")\s+((?:[A-Z][A-Za-z0-9&.\-]*\s*){1,3})', 1)) as party from clauses c join docs_v d using (source_id)""",
    "roles_q": f"""select source_id, clause_index, role, role not in ('COMPETITOR', 'INDUSTRY') as attributable from (select *, case when {news._any(ns.COMPETITOR_CUES)} and party <> '' and lower(party) not in (lower(entity), coalesce(lower(publisher), '')) then 'COMPETITOR'
      when {news._any(ns.INDUSTRY_CUES)} and not (contains(padded, ' ' || lower(entity) || ' ') or coalesce(alias <> '' and contains(padded, ' ' || alias || ' '), false)) then 'INDUSTRY'
      when {news._any(ns.COUNTERPARTY_CUES)} then 'COUNTERPARTY' when {news._any(ns.SUBSIDIARY_CUES)} then 'SUBSIDIARY' else 'SELF' end as role from words)""",
    "dominant_q": "select * from (select *, row_number() over (partition by entity order by materiality desc, event_type, area nulls first, cluster) as place from vectors_v) where place <= 5",
    "company_q": f"""select entity, axis, {_r(_W, 4)} as mean, {_r(f'greatest(sum(w * mean * mean) / sum(w) - pow({_W}, 2), 0) + sum(w * dispersion) / sum(w)', 4)} as dispersion from loaded_v group by 1, 2""",
    "state_q": f"""select entity, count(*) as independent_events, {_r('sum(certainty * (0.5 + 0.5e0 * confirmation) * w) / sum(w)', 4)} as confidence, {_r('sum(source_quality * w) / sum(w)', 4)} as source_quality,
      case when count(text_sentiment) > 0 then {_r('sum(text_sentiment * w) / sum(w) filter (text_sentiment is not null)', 4)} end as text_sentiment from heavy_v group by 1""",
    "profiled": f"select a.*, b.profile from vectors_d a left join (select {', '.join(_K)}, {_AXES} as profile from axes_d group by all) b on {_ON}",
    "nearest_q": f"""select a.entity, a.event_type, a.area, a.cluster, count(b.entity) as priors, case when count(b.entity) >= 3 then {_r("min(sqrt(list_avg(list_filter(list_transform(range(1, 11), lambda i: pow(a.profile[i] - b.profile[i], 2)), lambda g: g is not null))))", 4)} end as novelty
      from profiled a left join profiled b on a.entity = b.entity and b.as_of < a.as_of group by 1, 2, 3, 4""",
    "days_q": f"select entity, as_of, {_AXES} as axes from (select entity, as_of, axis, {_r(_W, 4)} as mean from loaded_d group by 1, 2, 3) group by 1, 2",
    "moved": f"""select entity, as_of, epoch(as_of - before_at) / 86400 as days, list_filter(list_transform(range(1, 11), lambda i: {_r('(axes[i] - before[i])', 4)}), lambda d: d is not null) as delta from (
      select *, lag(axes) over (partition by entity order by as_of) as before, lag(as_of) over (partition by entity order by as_of) as before_at from days_q) where before is not null""",
    "moved_q": f"select *, len(delta) as changed, case when len(delta) > 0 then {_r('magnitude / days', 6)} end as velocity from (select *, sqrt(coalesce(list_sum(list_transform(delta, lambda d: d * d)), 0)) as magnitude from moved)",
    "told_q": "select n.*, g.speculative from narratives_q n join (select entity, event_type, area, bool_and(evidence_type = 'SPECULATION') as speculative from timeline_q group by 1, 2, 3) g on n.entity = g.entity and n.event_type = g.event_type and n.area is not distinct from g.area",
    "checked_q": f"""select n.*, case when area is null or area not in {assess.PERFORMANCE} or coalesce(direction, 'UNKNOWN') = 'UNKNOWN' or sentiment = 'NEUTRAL' then 'INSUFFICIENT_EVIDENCE' when direction = 'MIXED' or sentiment = 'MIXED' then 'PARTIALLY_SUPPORTED'
      when direction = sentiment then 'SUPPORTED' else 'CONTRADICTED' end as verdict from told_q n left join (select {_BRAND} as entity, direction from direction_q) d using (entity)""",
    "risks_q": f"""select entity, event_type, area, 'NARRATIVE' as origin, {_case('area', {a: f"'{c}'" for a, c in assess.RISK_OF_AREA.items()}, "'BUSINESS'")} as category, case when speculative then 'SPECULATIVE' when trend = 'EMERGING' then 'EMERGING' else 'KNOWN' end as status,
      case when trend in ('STRENGTHENING', 'EMERGING') and independent_sources >= 2 then 'HIGH' when independent_sources = 1 then 'LOW' else 'MEDIUM' end as severity, confidence from told_q where sentiment = 'NEGATIVE'
      union all select entity, event_type, area, 'CONTRADICTION', 'NARRATIVE', 'EMERGING', 'MEDIUM', 'LOW' from told_q where side_a is not null and side_b is not null
      union all select {_BRAND}, null, 'cash_flow', 'FIGURES', 'LIQUIDITY', 'KNOWN', 'HIGH', 'HIGH' from latest_q where concept = 'FreeCashFlow' and val < 0""",
    "view_a": f"""select coalesce(a.entity, b.entity) as entity, coalesce(n, 0) as n_narratives, coalesce(m, 0) as n_risks, (coalesce(points, 0) + coalesce(cost, 0))::double as score, {_r('(least(1e0, sources / 10e0) + share) / 2', 2)} as confidence from (select entity, count(*) as n, sum(independent_sources) as sources,
      avg({_case('confidence', assess.CONFIDENCE_SHARE, '0.3e0')}) as share, sum(case sentiment when 'POSITIVE' then 1 when 'NEGATIVE' then -1 else 0 end * case confidence when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end + case verdict when 'SUPPORTED' then 1 when 'CONTRADICTED' then -2 else 0 end) as points from checked_q group by 1) a
      full join (select entity, count(*) as m, sum(case severity when 'HIGH' then -2 when 'MEDIUM' then -1 else 0 end) as cost from risks_q group by 1) b on a.entity = b.entity""",
    "view_q": f"select *, {_GRADE.format('score', '(n_narratives + n_risks > 0)')} as assessment from view_a",
    "news_mean": "select s.entity, s.confidence as news_confidence, m.news from state_q s left join (select entity, avg(mean) as news from company_q group by 1) m using (entity)",
    "modes_a": "select coalesce(a.entity, b.entity) as entity, coalesce(score, 0) as score, coalesce(n_narratives + n_risks > 0, false) as has, confidence, news, news_confidence from view_q a full join news_mean b on a.entity = b.entity",
    "modes_b": f"""select entity, 'A' as mode, {_GRADE.format('score', 'has')} as decision, confidence as sure, null::double as fixed from modes_a union all select entity, 'B', {_GRADE.format('(score + coalesce(news * 3, 0))', '(has or news is not null)')}, confidence, null from modes_a
      union all select entity, 'C', case when news is null then 'NEWS_NO_SIGNAL' when news > 0 then 'NEWS_ONLY_UP' when news < 0 then 'NEWS_ONLY_DOWN' else 'NEWS_ONLY_FLAT' end, news_confidence, {_r('news', 4)} from modes_a""",
    "modes_c": f"select *, case when mode = 'C' then fixed else {_case('decision', assess.IMPACT, 'null')} end as predicted_impact from modes_b",
    "modes_q": "select *, case when sure >= 0.7 and predicted_impact is not null then 'HIGH' when sure >= 0.4 and predicted_impact is not null then 'MEDIUM' else 'LOW' end as confidence_bucket, case when predicted_impact is not null then sure end as predicted_confidence from modes_c",
    **{f"{name}_e": reports.TABLES[name].replace(reports.NOW, EARLIER).replace("from timeline_q", f"from timeline_q where published_at <= timestamp '{EARLIER}'").replace("from told", "from told_e") for name in ("told", "told_d")},
    "narratives_e": reports.TABLES["narratives_q"].replace("from told_d", "from told_d_e"),
    "changes_q": "select n.entity, n.event_type, n.area, unnest(list_filter([case when o.trend is null then 'NEW_NARRATIVE' end, case when n.sentiment <> o.sentiment then 'SENTIMENT_CHANGE' end, case when n.trend <> o.trend then 'TREND_CHANGE' end], lambda c: c is not null)) as change, o.sentiment as sentiment_before, n.sentiment, o.trend as trend_before, n.trend "
    "from narratives_q n left join narratives_e o on n.entity = o.entity and n.event_type = o.event_type and n.area is not distinct from o.area",
    "summary_q": "select entity, min(concat_ws(':', event_type, area)) filter (confidence = 'LOW' or independent_sources <= 1) as weakest, count(*) filter (verdict = 'INSUFFICIENT_EVIDENCE') as unchecked, count(*) filter (trend = 'DISPUTED') as disputed from checked_q group by 1",
    "looked_q": "select t.event_id, d.source_id, d.publisher, d.reliability, d.source_type from timeline_q t join docs_v d using (source_id)",
    "areas_q": f"select source_id, clause_index, array_to_string({_AREAS}, ',') as areas from clauses",
    "known_q": f"select source_id, clause_index, {_KIND} as status from clauses",
    "split_items": "select event_id, split_part(hit, '|', 1) as event_type, split_part(hit, '|', 2) as direction from items_q",
}


def query(name: str, make: Query, columns: str, table: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES)


_KEYS = " ".join(_K)
query("interpret_items", items, "event_id event_type direction", "split_items")
query("name_aliases", names, "s_suppkey name aliases", "names_q")
query("attribution", attributed, "source_id clause_index role attributable", "roles_q")
query("epistemic", known, "source_id clause_index status", "known_q")
query("affected_areas", areas, "source_id clause_index areas", "areas_q")
query("document_lookup", looked_up, "event_id source_id publisher reliability source_type", "looked_q")
query("implications", implied, "event_id axis ~value ~weight basis", "implied_v")
query("event_axes", lambda s, d: built(s, d)[1], f"{_KEYS} axis ~mean ~dispersion basis", "axes_v")
query("event_vector", lambda s, d: built(s, d)[0], f"{_KEYS} as_of ~text_sentiment ~materiality ~certainty epistemic_status time_horizon independent_sources clauses ~source_quality ~confirmation ~magnitude_confidence", "vectors_v")
query("dominant_events", lambda s, d: ns.dominant_events(built(s, d)[0]), f"{_KEYS} place ~materiality", "dominant_q")
query("company_axes", company_axes, "entity axis ~mean ~dispersion", "company_q")
query("company_state", company_state, "entity independent_events ~confidence ~source_quality ~text_sentiment", "state_q")
query("nearest_prior", lambda s, d: ns.novelty(stored(ns.profiles(*built(s, d, 0)), "profiled")), f"{_KEYS} priors ~novelty", "nearest_q")
query("state_trajectory", lambda s, d: ns.trajectory(daily(s, d)), "entity as_of changed ~magnitude ~velocity", "moved_q")
query("consistency", checked, "entity event_type area sentiment verdict", "checked_q")
query("risks", found_risks, "entity event_type area origin category status severity confidence", "risks_q")
query("assessment", assessed, "entity n_narratives n_risks ~score assessment ~confidence", "view_q")
query("research_modes", modes, "entity mode decision ~predicted_impact ~predicted_confidence confidence_bucket", "modes_q")
query("change_diff", changes, "entity event_type area change sentiment_before sentiment trend_before trend", "changes_q")
query("evidence_summary", evidence_summary, "entity weakest unchecked disputed", "summary_q")

__all__ = ["ORACLE_SQL", "QUERIES"]
