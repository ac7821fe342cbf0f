"""One nested row per company, put together from tables that other operators make, and single fields of it.

Every part is grouped by company before it is joined, so rows are as many as companies. Parts with a row for each event
belong in a report as their latest few; narratives, risks and axes are short lists by nature. A stored report is read by
field: a view of narratives reads no risks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_few(rows: DataFrame, time_col: str, tie: str, most: int = 20) -> DataFrame:
    """The latest rows of each company: what a report names, not all there are."""
    order = Window.partitionBy("entity").orderBy(F.col(time_col).desc(), tie)
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most).drop("__place")


def research_report(entities: DataFrame, lists: Mapping[str, DataFrame], singles: Mapping[str, DataFrame]) -> DataFrame:
    """entity, an array of structs for each of `lists` (sorted by its columns in order; empty where a company has none) and
    a struct for each of `singles` (null where there is none). Tables have a column entity; of several single rows of a
    company the least is taken; companies that are not among the entities are left out."""
    out = entities.select("entity").where("entity is not null").distinct()
    for name, rows in lists.items():
        columns = [c for c in rows.columns if c != "entity"]
        grouped = rows.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        empty = F.array().cast(grouped.schema[name].dataType)
        out = out.join(grouped, "entity", "left").withColumn(name, F.coalesce(name, empty))
    for name, rows in singles.items():
        columns = [c for c in rows.columns if c != "entity"]
        out = out.join(rows.groupBy("entity").agg(F.min(F.struct(*columns)).alias(name)), "entity", "left")
    return out


def view(report: DataFrame, field: str, *parts: str, watched: DataFrame | None = None) -> DataFrame:
    """One field of the report, a row for each of its elements, with the named parts of them (all without names); of the
    watched companies alone where a watchlist is given."""
    rows = report if watched is None else report.join(watched.select("entity"), "entity", "left_semi")
    kind = report.schema[field].dataType
    if kind.typeName() == "array":
        return rows.select("entity", F.explode(field).alias("x")).select("entity", *([f"x.{p}" for p in parts] or ["x.*"]))
    return rows.where(F.col(field).isNotNull()).select("entity", *([f"{field}.{p}" for p in parts] or [f"{field}.*"]))
