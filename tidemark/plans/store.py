"""Queries of tables that grow by batches, and of similar texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import ledger as led
from tidemark.operators.similarity import similar_texts
from tidemark.plans import knowledge, market
from tidemark.plans.market import Query, take
from tidemark.plans.sql import pick
from tidemark.shared import stored, work_dir
from tidemark.sources import ledger_store as store

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CASE = ["event_id", "horizon_days"]
LIKE, STOP_WORDS = 0.7, ("the", "of", "and", "to", "in")


def grown(rows: DataFrame, natural: list[str], early: str, label: str) -> DataFrame:
    """The table after a batch of early rows, one of all rows, and both once more."""
    path = work_dir(rows.sparkSession, label)
    for batch in ("early", "all", "early", "all"):
        store.append(rows.where(early) if batch == "early" else rows, path, natural, batch)
    return store.read(rows.sparkSession, path, store.keyed(rows, natural).schema)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = (*CASE, "published_at", "direction", "realized", "outcome_status")
    rows = stored(market.predicted(spark, sf_dir, needed).select(*CASE, "published_at", "predicted_impact"), "predictions")
    return grown(rows, CASE, f"published_at < timestamp'{knowledge.CUT}'", "predictions")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(led.outcome_known(knowledge.observations(spark, sf_dir)).select("entity", "as_of", "horizon_days", "realized"), "observations")
    return grown(rows, ["entity", "as_of", "horizon_days"], f"as_of < timestamp'{knowledge.CUT}'", "observations")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of logged predictions after two batches, of which the second has others for the first's cases, and what
    was refused of it."""
    rows = stored(led.outcome_known(market.ledger(spark, sf_dir)).select(*CASE, "published_at", "realized"), "outcomes")
    path, early = work_dir(spark, "outcomes"), F.col("published_at") < F.lit(knowledge.CUT).cast("timestamp")
    logged = rows.where("event_id % 10 <> 0").select(*CASE)
    asked = rows.withColumn("observed_at", F.col("published_at"))
    store.record_outcomes(asked.where(early), logged, path, CASE, "early", "observed_at")
    refused = store.record_outcomes(asked.withColumn("realized", F.when(early, -F.col("realized")).otherwise(F.col("realized"))), logged, path, CASE, "all", "observed_at")
    held = store.read(spark, path, store.keyed(asked, CASE).schema)
    return held.select(*CASE, "realized", F.col(store.BATCH).alias("came")).unionByName(refused.select(*CASE, "realized", F.col("reason").alias("came")))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose words are alike, and each one's number of similar classes."""
    pairs, classes = similar_texts(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", LIKE, STOP_WORDS)
    ends = pairs.select(F.col("a").alias("of")).union(pairs.select("b")).groupBy("of").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(ends, classes["class_id"] == ends["of"], "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", LIKE, STOP_WORDS)[0]


TABLES = knowledge.TABLES | {
    "append_p": f"select event_id, horizon_days, predicted_impact, case when published_at < timestamp '{knowledge.CUT}' then 'early' else 'all' end as batch from pred",
    "append_o": f"select entity, as_of, horizon_days, realized, case when as_of < timestamp '{knowledge.CUT}' then 'early' else 'all' end as batch from observed where realized is not null",
    "append_r": f"""select event_id, horizon_days, unnest(case when event_id % 10 = 0 then [case when early then -realized else realized end] when early then [realized, -realized] else [realized] end) as realized,
      unnest(case when event_id % 10 = 0 then ['NO_PREDICTION'] when early then ['early', 'SECOND_OUTCOME'] else ['all'] end) as came from (select *, published_at < timestamp '{knowledge.CUT}' as early from known)""",
    "sim_t": f"select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents) where term not in {STOP_WORDS} group by 1, 2",
    "sim_w": "select *, tf * (ln((1 + (select count(distinct doc_id) from documents)) / (1 + count(*) over (partition by term))::double) + 1) as raw from sim_t",
    "sim_v": "select doc_id, term, tf, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from sim_w",
    "sim_c": "select doc_id, min(doc_id) over (partition by bag) as class_id from (select doc_id, list(term || ':' || tf order by term) as bag from sim_t group by 1)",
    "sim_h": "select v.* from sim_v v join sim_c c using (doc_id) where doc_id = class_id",
    "sim_p": f"select a.doc_id as a, b.doc_id as b, sum(a.weight * b.weight) as similarity from sim_h a join sim_h b on a.term = b.term and a.doc_id < b.doc_id group by 1, 2 having sum(a.weight * b.weight) >= {LIKE}",
    "sim_q": "select doc_id, class_id, (select count(*) from sim_p where a = class_id or b = class_id) as links from sim_c",
}


def query(name: str, make: Query, columns: str, table: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: take(make(spark, sf_dir), columns)
    ORACLE_SQL[name] = pick(table, columns, TABLES)


query("append_predictions", predictions, "event_id horizon_days ~predicted_impact batch", "append_p")
query("append_observations", observations, "entity as_of horizon_days ~realized batch", "append_o")
query("append_outcomes", outcomes, "event_id horizon_days ~realized came", "append_r")
query("tfidf_similarity", similar, "doc_id class_id links", "sim_q")
query("tfidf_pairs", similar_pairs, "a b ~similarity", "sim_p")

__all__ = ["ORACLE_SQL", "QUERIES"]
