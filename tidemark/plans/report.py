"""The research report of every company and its views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import assessment as assess, news_state as ns, report
from tidemark.plans import reports, state
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick
from tidemark.shared import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies' reports in one plan, written once; the timeline and what rests on it are read by several parts."""
    timeline = stored(state.read(spark, sf_dir), "timeline")
    told = stored(state.told(spark, sf_dir, timeline), "told")
    figures = stored(state.numbered(state.fun.latest(reports.figures(spark, sf_dir))), "figures")
    risks = stored(assess.risks(told, figures), "risks")
    checked = stored(assess.consistency(told, state.numbered(state.fun.direction(state.fun.yoy_growth(reports.figures(spark, sf_dir))))), "checked")
    vectors, axes = state.built(spark, sf_dir, timeline=timeline)
    lists = {
        "narratives": checked.select("entity", "event_type", "area", "sentiment", "confidence", "trend", "verdict"),
        "risks": risks.select("entity", "origin", "event_type", "area", "category", "status", "severity"),
        "figures": figures.select("entity", "concept", "end", "val"),
        "axes": ns.company_axes(vectors, axes, state.now()).select("entity", "axis", "mean", "contradicted"),
        "timeline": report.latest_few(timeline.select("entity", "published_at", "event_id", "event_type", "sentiment"), "published_at", "event_id"),
    }
    singles = {"assessment": assess.assess(checked, risks).select("entity", "assessment", "score", "confidence"), "news_state": ns.company_state(vectors, state.now())}
    return stored(report.research_report(views.documents(spark, sf_dir), lists, singles), "report")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda field, *parts: F.array_join(F.array_sort(F.transform(field, lambda x: F.concat_ws(":", *[F.coalesce(x[p], F.lit("-")) for p in parts]))), "|")
    rows = built(spark, sf_dir)
    return rows.select("entity", line("narratives", "event_type", "area", "sentiment", "trend", "verdict").alias("narratives"), line("risks", "origin", "area", "category", "severity").alias("risks"), line("timeline", "event_id").alias("timeline"), F.size("axes").alias("n_axes"), F.size("figures").alias("n_figures"), "assessment.assessment", "assessment.score", "news_state.independent_events", F.col("news_state.confidence").alias("news_confidence"))


def told_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of the watched companies: those whose number is even."""
    watched = views.documents(spark, sf_dir).select("entity").distinct().where("cast(substring(entity, 2) as int) % 2 = 0")
    return report.view(built(spark, sf_dir), "narratives", "event_type", "area", "sentiment", watched=watched)


def state_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.view(built(spark, sf_dir), "news_state", "independent_events", "source_quality")


def _line(parts: str, of: str, where: str = "") -> str:
    return f"(select coalesce(array_to_string(list_sort(list(concat_ws(':', {parts}))), '|'), '') from {of} x where x.entity = e.entity {where})"


TABLES = state.TABLES | {
    "report_q": f"""select e.entity, {_line("event_type, coalesce(area, '-'), sentiment, trend, verdict", "checked_q")} as narratives, {_line("origin, coalesce(area, '-'), category, severity", "risks_q")} as risks,
      {_line("event_id", "(select entity, event_id, row_number() over (partition by entity order by published_at desc, event_id) as k from timeline_q)", "and k <= 20")} as timeline,
      (select count(*) from company_q x where x.entity = e.entity) as n_axes, (select count(*) from latest_q x where 'E' || split_part(x.entity, '#', 2) = e.entity) as n_figures, v.assessment, v.score, s.independent_events, s.confidence as news_confidence
      from (select distinct entity from docs_v) e left join view_q v using (entity) left join state_q s using (entity)""",
    "report_n": "select entity, event_type, area, sentiment from checked_q where substr(entity, 2)::int % 2 = 0",
    "report_s": "select entity, independent_events, source_quality from state_q",
}


def query(name: str, make: Query, columns: str, table: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES)


query("research_report", summary, "entity narratives risks timeline n_axes n_figures assessment ~score independent_events ~news_confidence", "report_q")
query("research_narratives_view", told_view, "entity event_type area sentiment", "report_n")
query("research_state_view", state_view, "entity independent_events ~source_quality", "report_s")

__all__ = ["ORACLE_SQL", "QUERIES"]
