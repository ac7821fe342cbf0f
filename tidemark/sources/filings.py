"""Readers of filings, news items, reported figures and watchlists, and tables that grow by appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.text import fingerprint

# Publishers whose reports count as first-hand, and forms that matter.
WIRES = ("reuters", "bloomberg", "associated press", "ap news", "the wall street journal", "dow jones", "wsj", "wsj.com", "bloomberg.com", "reuters.com")
FORMS = ("10-K", "10-Q", "8-K")
HIT = "accession string, display_names array<string>, file_date string, items array<string>, direction string, phrase string"
FACTS = "entity string, facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, form: string, fp: string, filed: string>>>>>>"
INDEX = "entity string, name string, recent struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>, items: array<string>>"


def filing_hits(hits: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Search hits (HIT) as raw items: one per direction and accession, that of the phrase named first; the ticker stands
    in brackets in the first display name, and hits without one go."""
    rank = F.array_position(F.array(*[F.lit(p) for p in phrases]), F.col("phrase"))
    rows = hits.groupBy("direction", "accession").agg(F.min_by(F.struct("display_names", "file_date", "items", "phrase"), F.struct(F.when(rank > 0, rank), F.col("phrase"))).alias("hit"))
    name = F.get("hit.display_names", 0)
    return rows.select("direction", "accession", F.nullif(F.regexp_extract(name, r"\(([A-Z]{1,6})\)", 1), F.lit("")).alias("entity"), F.concat(name, F.lit(": "), "hit.phrase").alias("text"), F.to_timestamp("hit.file_date", "yyyy-MM-dd").alias("published_at"), F.col("hit.phrase").alias("matched_phrase"), F.col("hit.items").alias("items")).where("entity is not null")


def news_documents(items: DataFrame) -> DataFrame:
    """Items (title, link, description, publisher, published_at, entity) as documents: tags and repeated blanks go, an empty
    body falls back to the title, items without a title go."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    rows = items.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).where("title <> ''")
    rows = rows.withColumn("body", F.coalesce(F.nullif(body, F.lit("")), "title"))
    trust = F.when(F.lower(F.trim("publisher")).isin(*WIRES), "SECONDARY").otherwise("TERTIARY")
    link = F.coalesce("link", F.lit(""))
    return rows.select(F.concat(F.lit("news:"), fingerprint(F.col("title"), link)).alias("source_id"), F.coalesce("publisher", F.lit("Unknown")).alias("publisher"), F.lit("news").alias("source_type"), link.alias("url"), "published_at", "entity", "title", "body", trust.alias("reliability"), fingerprint(F.col("title"), F.col("body")).alias("fingerprint"))


def filings_index(index: DataFrame, until: str, lookback_days: int = 365, most: int = 40) -> DataFrame:
    """An index of parallel arrays (INDEX) as documents: forms that matter, of the last days before `until`, the first `most`
    of each entity in the index's order."""
    rows = index.select("entity", "name", F.posexplode(F.arrays_zip("recent.form", "recent.filingDate", "recent.accessionNumber", "recent.primaryDocument", "recent.items")).alias("place", "f"))
    rows = rows.select("entity", "name", "place", "f.*").withColumn("filed", F.to_date("filingDate"))
    rows = rows.where(F.col("form").isin(*FORMS) & (F.datediff(F.lit(until).cast("date"), "filed") <= lookback_days))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("place"))).where(F.col("k") <= most)
    codes = F.when(F.coalesce("items", F.lit("")) != "", F.col("items"))
    title = F.concat("name", F.lit(" "), "form", F.lit(" filed "), "filingDate", F.coalesce(F.concat(F.lit(" (items "), codes, F.lit(")")), F.lit("")))
    return rows.select(F.concat(F.lit("sec:"), "accessionNumber").alias("source_id"), F.lit("filing").alias("source_type"), F.col("filed").cast("timestamp").alias("published_at"), "entity", title.alias("title"), codes.alias("item_codes"), F.lit("PRIMARY").alias("reliability"))


def company_facts(facts: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """Nested figures (FACTS) as rows: entity, tag, unit, start, end, val, form, fp, filed."""
    tags = facts.select("entity", F.explode(F.col("facts")[taxonomy]).alias("tag", "entry"))
    units = tags.select("entity", "tag", F.explode("entry.units").alias("unit", "values"))
    rows = units.select("entity", "tag", "unit", F.inline("values"))
    return rows.withColumns({c: F.to_date(c) for c in ("start", "end", "filed")})


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a text file: what follows # and blank lines go, upper case."""
    rows = spark.read.text(path).select(F.upper(F.trim(F.split("value", "#")[0])).alias("ticker"))
    return rows.where("ticker <> ''")


def insert_if_absent(new: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `new` to append: one per key, of those that the table doesn't have yet."""
    return new.dropDuplicates([*keys]).join(table.select(*keys), [*keys], "left_anti")


def rejected_outcomes(new: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `new` whose key has an outcome already: an error of whoever sends them."""
    return new.join(table.select(*keys), [*keys], "left_semi")


def latest_state(changes: DataFrame, keys: Sequence[str], order: Sequence[str], sticky: Sequence[str] = ()) -> DataFrame:
    """A change log as its latest state: each column's last value, of `sticky` ones the last that isn't null. Maxima with
    partial sums, so a key with a long history is no hot window."""
    at = F.struct(*order)
    others = [c for c in changes.columns if c not in keys and c not in sticky]
    last = F.max_by(F.struct(*others), at).alias("last")
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in sticky]
    return changes.groupBy(*keys).agg(last, *kept).select(*keys, "last.*", *sticky)
