"""Queries over clauses as events, narratives and reported figures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import fundamentals as fun, identity, research, text
from tidemark.plans import news
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick
from tidemark.shared import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
EVENT_TYPES = {"revenue": "EARNINGS", "demand": "DEMAND", "regulatory": "REGULATORY", "guidance": "GUIDANCE"}
NOW = "2024-01-31"
TAGS = {"Revenues": ("Revenues", "Sales"), "OperatingCashFlow": ("Cash",), "CapitalExpenditure": ("Spent",)}


def timeline(spark: SparkSession, sf_dir: str, words: str | None = None) -> DataFrame:
    """Events of all documents, with their clause's words in a column of that name. A clause keeps what is known of its
    document, but not its text."""
    docs = text.dedupe_documents(views.documents(spark, sf_dir))
    rows = text.split_clauses(docs, news.CONTRAST, words="__words").drop("title", "title_key", "body", "lang")
    clause, among = F.col("clause"), F.col("__words")
    rows = rows.withColumns({"area": text.affected_area(clause, news.AREAS, among), "sentiment": text.sentiment(clause, news.POSITIVE, news.NEGATIVE, news.NEGATION, among), "evidence_type": text.evidence_type(clause, F.col("source_type"), news.CUES)})
    out = research.timeline_events(rows, EVENT_TYPES)
    return out.drop("__words") if words is None else out.withColumnRenamed("__words", words)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.narratives(timeline(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of all documents, each with a figure made of its document's and its own number in front."""
    rows = news.clauses(spark, sf_dir).withColumn("sentiment", text.sentiment(F.col("clause"), news.POSITIVE, news.NEGATIVE, news.NEGATION))
    n = (F.col("source_id") + F.col("clause_index")) % 400
    figure = F.when(n % 4 == 0, F.concat(F.when(n % 8 == 0, "-").otherwise(""), n.cast("string"), F.lit(" percent "))).when(n % 4 == 1, F.concat(n.cast("string"), F.lit(".5 bps "))).when(n % 4 == 2, F.concat(F.lit("$"), n.cast("string"), F.lit(" million "))).otherwise("")
    rows = rows.withColumn("found", research.magnitude(F.concat(figure, F.col("clause"))))
    return rows.select("source_id", "clause_index", "found.*", research.clause_score(F.col("found"), F.col("sentiment")).alias("signed_score"))


def figured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline's events, told on days by their place in the document, each with a figure made of its document's and
    its own number: powers of three, so that those next to each other diverge."""
    n = F.col("source_id") + F.col("clause_index")
    unit = F.when(n % 97 == 0, "USD").when(n % 89 != 0, "PERCENT")
    value = F.when(unit.isNotNull(), F.pow(F.lit(3.0), n % 7) * (1 + (n % 3) / 10) * F.when(n % 11 == 0, -1).otherwise(1))
    at = F.col("published_at") + F.make_dt_interval((F.col("clause_index") % 9).cast("int"))
    return timeline(spark, sf_dir).withColumns({"published_at": at, "unit": unit, "value": value})


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once, as occurrences read their events several times.
    rows = figured_events(spark, sf_dir).select("event_id", "published_at", *identity.TOPIC, "unit", "value")
    return identity.event_instances(stored(rows, "timeline"), unit=F.col("unit"), value=F.col("value"))


def linked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cells (day, unit, band of sizes) of which some events are linked, with the topic's names."""
    celled = stored(identity.cells(figured_events(spark, sf_dir), identity.TOPIC, F.col("unit"), F.col("value")), "celled")
    names = celled.select("topic", *identity.TOPIC).distinct()
    return identity.links(celled).join(names, "topic").drop("topic")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly and half-yearly sums of each brand's lines, as reported figures."""
    lines = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity")), F.col("l_partkey") == F.col("p_partkey"))
    values = F.inline(F.array(*[F.struct(F.lit(tag).alias("tag"), F.expr(e).cast("double").alias("part")) for tag, e in (("Revenues", "l_extendedprice"), ("Cash", "l_tax * l_extendedprice"), ("Spent", "l_discount * l_extendedprice"))]))
    ends = lines.select("entity", F.col("l_shipdate").cast("date").alias("day"), "l_tax", "l_discount", "l_extendedprice").select("entity", "day", values)
    out = None
    for months in (3, 6):
        month = F.month("day")
        start = F.make_date(F.year("day"), (F.floor((month - 1) / months) * months + 1).cast("int"), F.lit(1))
        rows = ends.groupBy("entity", "tag", start.alias("start")).agg(F.sum("part").alias("val"))
        rows = rows.withColumn("end", F.date_sub(F.add_months("start", months), 1)).withColumn("form", F.lit("10-Q")).withColumn("filed", F.date_add("end", 30))
        out = rows if out is None else out.unionByName(rows)
    return out


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fun.series(facts(spark, sf_dir), TAGS)


def _dominant(p: str) -> str:
    a, b, c = f"{p}positive", f"{p}negative", f"{p}mixed"
    top = f"greatest({a}, {b}, {c})"
    return f"""case when {top} = 0 then 'NEUTRAL' when ({a} > 0)::int + ({b} > 0)::int + ({c} > 0)::int > 1 and {a} in (0, {top}) and {b} in (0, {top}) and {c} in (0, {top}) then 'MIXED'
      when {a} = {top} then 'POSITIVE' when {b} = {top} then 'NEGATIVE' else 'MIXED' end as {p}dominant"""


_SPANS = {"": "true", "recent_": f"published_at between timestamp '{NOW}' - interval 7 days and timestamp '{NOW}'", "earlier_": f"published_at between timestamp '{NOW}' - interval 21 days and timestamp '{NOW}' - interval 7 days"}
_POS, _NEG, _NOT = news._any(news.POSITIVE), news._any(news.NEGATIVE), news._any(news.NEGATION)
_SENTIMENT = f"""case when {_POS} and {_NEG} then 'MIXED' when {_POS} then case when {_NOT} then 'NEGATIVE' else 'POSITIVE' end when {_NEG} then case when {_NOT} then 'POSITIVE' else 'NEGATIVE' end else 'NEUTRAL' end"""


def _anchored(x: str, unit: str) -> str:
    points = research.ANCHORS[unit]
    return "case " + " ".join(f"when {x} <= {b} then {y} + {z - y} * ({x} - {a}) / {b - a}" for (a, y), (b, z) in zip(points, points[1:])) + f" else {points[-1][1]} end"


def occurrences(s: str, of: str, days: int) -> dict[str, str]:
    """Tables up to occ{s}: the rows of a table with unit and value, and the number of each one's occurrence in its topic.
    All pairs of different days and sizes of a topic are looked at; labels spread in rounds, each with a jump."""
    cell = "concat_ws('|', entity, event_type, coalesce('=' || area, '-'), published_at::date, case when value is not null then unit end, case when unit is not null then value end)"
    tables = {
        f"cell{s}": f"select distinct {cell} as id, entity, event_type, area, published_at::date as day, case when value is not null then unit end as unit, case when unit is not null then value end as value from {of}",
        f"edge{s}": f"""select a.id, b.id as other from cell{s} a join cell{s} b on a.entity = b.entity and a.event_type = b.event_type and a.area is not distinct from b.area and abs(a.day - b.day) <= {days}
          and not coalesce(a.unit = b.unit and abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-9) > 0.5, false)""",
        f"round{s}_0": f"select id, id as label from cell{s}",
    }
    for i in range(8):
        tables[f"near{s}_{i}"] = f"select e.id, min(r.label) as label from edge{s} e join round{s}_{i} r on e.other = r.id group by 1"
        tables[f"round{s}_{i + 1}"] = f"select a.id, least(a.label, b.label) as label from near{s}_{i} a join near{s}_{i} b on a.label = b.id"
    tables[f"first{s}"] = f"select label, entity, event_type, area, min(row(published_at, event_id)) as first from {of} t join round{s}_8 r on {cell} = r.id group by 1, 2, 3, 4"
    tables[f"count{s}"] = f"select label, row_number() over (partition by entity, event_type, area order by first) as cluster from first{s}"
    tables[f"occ{s}"] = f"select t.*, c.cluster from {of} t join round{s}_8 r on {cell} = r.id join count{s} c on r.label = c.label"
    return tables


_BAND = "case when value is null or value = 0 then 0 else sign(value)::int * (floor(log2(abs(value)))::int + 1100) end"
TABLES = news.TABLES | occurrences("_f", "figured_q", 4) | {
    "figured_q": """select * exclude (published_at, k), published_at + to_days((clause_index % 9)::int) as published_at, case when k % 97 = 0 then 'USD' when k % 89 <> 0 then 'PERCENT' end as unit,
      case when k % 97 = 0 or k % 89 <> 0 then pow(3, k % 7) * (1 + (k % 3) / 10e0) * case when k % 11 = 0 then -1 else 1 end end as value from (select *, source_id + clause_index as k from timeline_q)""",
    "banded": f"select *, coalesce(unit, '') as unit_of, {_BAND} as band from cell_f",
    "linked_q": """select distinct a.entity, a.event_type, a.area, a.day, a.unit_of, case when a.unit_of = b.unit_of then a.band end as band, b.day as other_day, b.unit_of as other_unit, case when a.unit_of = b.unit_of then b.band end as other_band
      from edge_f e join banded a on e.id = a.id join banded b on e.other = b.id where a.day < b.day or (a.day = b.day and (a.unit_of < b.unit_of or (a.unit_of = b.unit_of and a.band < b.band)))""",
    "all_parts": r"""select *, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(body, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)),
      lambda s: string_split(regexp_replace(regexp_replace(s, '(^|[^A-Za-z0-9_])([aA][sS])($|[^A-Za-z0-9_])', '\1' || chr(2) || '\3', 'g'), '(^|[^A-Za-z0-9_])([aA][sS])($|[^A-Za-z0-9_])', '\1' || chr(2) || '\3', 'g'), chr(2)))), lambda c: trim(c, ' ,.;:')), lambda c: c <> '') as cs from docs_d""",
    "every_clause": "select * exclude (cs), unnest(cs) as clause, generate_subscripts(cs, 1) - 1 as clause_index from all_parts",
    "labelled": f"""select *, case {' '.join(f"when {news._any(w)} then '{a}'" for a, w in news.AREAS.items())} end as area, {_SENTIMENT} as sentiment,
      case when source_type = 'filing' then 'FACT' when contains(lower(clause), 'be ') then 'SPECULATION' when contains(lower(clause), 'it ') then 'INTERPRETATION' else 'REPORTING' end as evidence_type from every_clause""",
    "timeline_q": f"""select *, case when source_type = 'filing' then 'HIGH' when event_type = 'GENERAL_NEWS' then 'LOW' else 'MEDIUM' end as materiality from (
      select *, substr(sha256(source_id || ':' || clause_index), 1, 16) as event_id, coalesce(case area {' '.join(f"when '{a}' then '{t}'" for a, t in EVENT_TYPES.items())} end, case when source_type = 'filing' then 'PERIODIC_FILING' else 'GENERAL_NEWS' end) as event_type,
      case when evidence_type = 'FACT' then 'HIGH' when evidence_type = 'SPECULATION' then 'LOW' when reliability = 'PRIMARY' then 'HIGH' when reliability = 'SECONDARY' then 'MEDIUM' else 'LOW' end as confidence
      from labelled where length(clause) >= 25 and (source_type = 'filing' or area is not null))""",
    "told": "select entity, event_type, area, count(distinct coalesce(duplicate_of, source_id)) as independent_sources, min(published_at) as first_observed, max(published_at) as latest_update, min(case reliability when 'PRIMARY' then 1 when 'SECONDARY' then 2 when 'TERTIARY' then 3 end) as best, arg_min(event_id, row(published_at, event_id)) filter (sentiment = 'NEGATIVE') as first_negative, arg_min(event_id, row(published_at, event_id)) filter (sentiment <> 'NEGATIVE') as first_other, "
    + ", ".join(f"count(*) filter ({s}) as {p}n, " + ", ".join(f"count(*) filter ({s} and sentiment = '{k}') as {p}{k.lower()}" for k in ("POSITIVE", "NEGATIVE", "MIXED")) for p, s in _SPANS.items()) + " from timeline_q group by 1, 2, 3",
    "told_d": f"select *, {', '.join(_dominant(p) for p in _SPANS)} from told",
    "narratives_q": """select *, dominant as sentiment, n as source_count, case when dominant = 'NEGATIVE' then negative else n - negative end as supporting, case when dominant = 'NEGATIVE' then n - negative else negative end as contradicting,
      case when dominant = 'NEGATIVE' then first_negative else first_other end as side_a, case when dominant = 'NEGATIVE' then first_other else first_negative end as side_b,
      case best when 1 then 'PRIMARY' when 2 then 'SECONDARY' when 3 then 'TERTIARY' else 'MIXED' end as source_quality, case when independent_sources >= 3 and best <= 2 then 'HIGH' when independent_sources >= 2 then 'MEDIUM' else 'LOW' end as confidence,
      case when earlier_n = 0 and recent_n > 0 then 'EMERGING' when recent_n = 0 and earlier_n > 0 then 'FADING' when recent_n = 0 then 'STABLE' when recent_dominant = 'MIXED' then 'DISPUTED'
        when recent_dominant <> earlier_dominant and recent_dominant <> 'NEUTRAL' and earlier_dominant <> 'NEUTRAL' then case when recent_n > earlier_n then 'STRENGTHENING' else 'WEAKENING' end
        when recent_n > earlier_n * 1.3 then 'STRENGTHENING' when recent_n < earlier_n * 0.7 then 'WEAKENING' else 'STABLE' end as trend from told_d""",
    "figured": """select *, case k % 4 when 0 then case when k % 8 = 0 then '-' else '' end || k || ' percent ' when 1 then k || '.5 bps ' when 2 then '$' || k || ' million ' else '' end || clause as said from (
      select source_id, clause_index, clause, (source_id + clause_index) % 400 as k from clauses)""",
    "found": r"""select *, nullif(regexp_extract(said, '(?i)(-?\d+(?:\.\d+)?)\s*(?:percent|%)', 1), '')::double as pct, nullif(regexp_extract(said, '(?i)(-?\d+(?:\.\d+)?)\s*(?:bps|basis points?)', 1), '')::double as bps,
      nullif(regexp_extract(said, '(?i)\$\s?(\d+(?:\.\d+)?)\s*(billion|million|bn|mn|b|m)\b', 1), '')::double * case when lower(regexp_extract(said, '(?i)\$\s?(\d+(?:\.\d+)?)\s*(billion|million|bn|mn|b|m)\b', 2)) in ('billion', 'bn', 'b') then 1e9 else 1e6 end as usd from figured""",
    "scored_c": f"""select source_id, clause_index, clause, case when pct is not null then 'PERCENT' when bps is not null then 'BPS' when usd is not null then 'USD' end as unit, coalesce(pct, bps, usd) as value,
      round(case when pct is not null then {_anchored('abs(pct)', 'PERCENT')} when bps is not null then {_anchored('abs(bps)', 'BPS')} end, 2) as score, {_SENTIMENT} as tone from found""",
    "magnitude_q": "select *, coalesce(case when value < 0 then -1 else way end * score, way * 0.5) as signed_score from (select *, case tone when 'POSITIVE' then 1.0 when 'NEGATIVE' then -1.0 end as way from scored_c)",
    "quarters": """select entity, tag, 'Q' as span, start, (start + interval 3 months - interval 1 day)::date as fin, sum(part)::double as val from (select p_brand as entity, date_trunc('quarter', l_shipdate)::date as start,
      unnest(['Revenues', 'Cash', 'Spent']) as tag, unnest([l_extendedprice, l_tax * l_extendedprice, l_discount * l_extendedprice]) as part from lineitem join part on l_partkey = p_partkey) group by all""",
    "series_q": """select entity, case tag when 'Revenues' then 'Revenues' when 'Cash' then 'OperatingCashFlow' else 'CapitalExpenditure' end as concept, tag, start, fin as "end", val from quarters""",
    "tops": 'select * from (select *, row_number() over (partition by entity, concept order by "end" desc) as k from series_q) where k = 1',
    "latest_q": """select entity, concept, "end", val from tops union all select a.entity, 'FreeCashFlow', a."end", a.val - b.val from tops a join tops b on a.entity = b.entity and a."end" = b."end" and a.concept = 'OperatingCashFlow' and b.concept = 'CapitalExpenditure'""",
    "yoy_q": """select *, (val - prior_val) / abs(prior_val) as growth from (select t.entity, t.concept, t."end", t.val, max_by(s.val, s."end") as prior_val from tops t left join series_q s on s.entity = t.entity and s.concept = t.concept
      and t."end" - s."end" between 350 and 380 and abs((t."end" - t.start) - (s."end" - s.start)) <= 15 group by 1, 2, 3, 4)""",
    "direction_q": """select entity, case when grew and fell then 'MIXED' when grew then 'POSITIVE' when fell then 'NEGATIVE' else 'UNKNOWN' end as direction, diluted as cash_flow_diluted from (select entity,
      coalesce(r > 0, false) or (o is not null and x is not null) as grew, coalesce(r <= 0, false) as fell, coalesce(o < coalesce(r, 0) and x > coalesce(r, 0), false) as diluted from (select entity, max(growth) filter (concept = 'Revenues') as r,
      max(growth) filter (concept = 'OperatingCashFlow') as o, max(growth) filter (concept = 'CapitalExpenditure') as x from yoy_q group by 1))""",
}


def query(name: str, make: Query, columns: str, table: str, where: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns.replace("end", '"end"') if table in ("series_q", "latest_q", "yoy_q") else columns, TABLES, where)


query("timeline_events", timeline, "event_id source_id clause_index entity event_type area sentiment evidence_type confidence materiality", "timeline_q")
query("narratives", narratives, "entity event_type area sentiment supporting contradicting first_observed latest_update source_count independent_sources source_quality confidence trend", "narratives_q")
query("contradiction_pairs", lambda s, d: research.contradictions(narratives(s, d)), "entity event_type area side_a side_b", "narratives_q", "side_a is not null and side_b is not null")
query("event_instances", instances, "event_id entity event_type area cluster", "occ_f")
query("pairwise_clauses", linked_cells, "entity event_type area day unit_of band other_day other_unit other_band", "linked_q")
query("magnitude", sized, "source_id clause_index unit ~value ~score ~signed_score", "magnitude_q")
query("fundamental_series", figures, "entity concept tag start end ~val", "series_q")
query("fundamental_facts", lambda s, d: fun.latest(figures(s, d)), "entity concept end ~val", "latest_q")
query("yoy_growth", lambda s, d: fun.yoy_growth(figures(s, d)), "entity concept end ~val ~prior_val ~growth", "yoy_q")
query("fundamental_direction", lambda s, d: fun.direction(fun.yoy_growth(figures(s, d))), "entity direction cash_flow_diluted", "direction_q")
