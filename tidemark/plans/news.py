"""Queries over source documents, each with its SQL. The word lists here stand in for real ones, which the invented prose
of the tables doesn't hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import text
from tidemark.plans.sql import sql

CONTRAST, POSITIVE, NEGATIVE, NEGATION = ("as",), ("with", "from", "this"), ("was", "by", "at"), ("are",)
CUES = {"SPECULATION": ("be ",), "INTERPRETATION": ("it ",)}
AREAS = {"revenue": ("that",), "demand": ("for",), "regulatory": ("in",), "guidance": ("to",), "workforce": ("is",)}


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of all documents."""
    return text.split_clauses(views.documents(spark, sf_dir), CONTRAST)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dedupe_documents(views.documents(spark, sf_dir))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir).select("source_id", text.fingerprint(F.col("title"), F.col("body")).alias("fingerprint"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir).select("source_id", text.title_key(F.col("title")).alias("title_key"))


def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select("source_id", "title_key", "duplicate_of")


def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.independent_sources(deduped(spark, sf_dir), ["entity"])


def split_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("source_id", "clause_index", "clause")


def evidence_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("source_id", "clause_index", text.evidence_type(F.col("clause"), F.col("source_type"), CUES).alias("evidence_type"))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("source_id", "clause_index", text.sentiment(F.col("clause"), POSITIVE, NEGATIVE, NEGATION).alias("sentiment"))


def affected_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("source_id", "clause_index", text.affected_area(F.col("clause"), AREAS).alias("area"))


def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.event_clusters(views.documents(spark, sf_dir), ["entity", "lang"], "published_at", "source_id")
    return rows.select("source_id", "entity", "lang", "cluster")


_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '\s*[-|]\s*[a-z0-9 .]{2,40}$', ''), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_SQUEEZE = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


def _any(words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower(clause), '(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])')"


TABLES = {
    "docs_v": """select doc_id as source_id, source as publisher, 'E' || (doc_id % 20) as entity, timestamp '2024-01-01' + to_days((doc_id % 30)::int) as published_at,
      substr(string_split(text, chr(10))[1], 1, 60) as title, text as body, lang, case when doc_id % 10 = 0 then 'filing' else 'news' end as source_type,
      case when quality = 1 then 'SECONDARY' else 'TERTIARY' end as reliability from documents left join labels using (doc_id)""",
    "docs_k": f"""select *, {_KEY} as title_key from docs_v""",
    # Rounds of the least label by title and by fingerprint: more than chains of these tables are long.
    "story0": f"select *, source_id as label, coalesce(title_key, '#' || source_id) as by_title, sha256({_SQUEEZE.format("coalesce(title, '')")} || '|' || substr({_SQUEEZE.format("coalesce(body, '')")}, 1, 400)) as by_print from docs_k",
    **{f"story{i + 1}": f"select * replace (min(label) over (partition by {'by_print' if i % 2 else 'by_title'}) as label) from story{i}" for i in range(6)},
    "docs_d": """select k.* exclude (label, by_title, by_print), case when head <> source_id then head end as duplicate_of from story6 k
      join (select label, arg_min(source_id, row(case reliability when 'PRIMARY' then 1 when 'SECONDARY' then 2 when 'TERTIARY' then 3 else 4 end, published_at, source_id)) as head from story6 group by 1) using (label)""",
    "parts": r"""select source_id, source_type, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(body, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)),
      lambda s: string_split(regexp_replace(regexp_replace(s, '(^|[^A-Za-z0-9_])([aA][sS])($|[^A-Za-z0-9_])', '\1' || chr(2) || '\3', 'g'), '(^|[^A-Za-z0-9_])([aA][sS])($|[^A-Za-z0-9_])', '\1' || chr(2) || '\3', 'g'), chr(2)))), lambda c: trim(c, ' ,.;:')), lambda c: c <> '') as cs from docs_v""",
    "clauses": "select source_id, source_type, unnest(cs) as clause, generate_subscripts(cs, 1) - 1 as clause_index from parts",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (dedupe_documents, independent_sources, split_clauses, evidence_type, sentiment, affected_area, cluster_events)} | {"fingerprint": fingerprints, "title_key": title_keys}

ORACLE_SQL = {name: sql(final, TABLES) for name, final in {
    "fingerprint": f"select source_id, substr(sha256({_SQUEEZE.format('title')} || '|' || substr({_SQUEEZE.format('body')}, 1, 400)), 1, 24) as fingerprint from docs_v",
    "title_key": "select source_id, title_key from docs_k",
    "dedupe_documents": "select source_id, title_key, duplicate_of from docs_d",
    "independent_sources": "select entity, count(distinct coalesce(duplicate_of, source_id)) as independent, count(*) as documents from docs_d group by 1",
    "split_clauses": "select source_id, clause_index, clause from clauses",
    "evidence_type": "select source_id, clause_index, case when source_type = 'filing' then 'FACT' when contains(lower(clause), 'be ') then 'SPECULATION' when contains(lower(clause), 'it ') then 'INTERPRETATION' else 'REPORTING' end as evidence_type from clauses",
    "sentiment": f"""select source_id, clause_index, case when {_any(POSITIVE)} and {_any(NEGATIVE)} then 'MIXED' when {_any(POSITIVE)} then case when {_any(NEGATION)} then 'NEGATIVE' else 'POSITIVE' end
      when {_any(NEGATIVE)} then case when {_any(NEGATION)} then 'POSITIVE' else 'NEGATIVE' end else 'NEUTRAL' end as sentiment from clauses""",
    "affected_area": "select source_id, clause_index, case " + " ".join(f"when {_any(w)} then '{a}'" for a, w in AREAS.items()) + " end as area from clauses",
    "cluster_events": """select source_id, entity, lang, sum(fresh) over (partition by entity, lang order by published_at, source_id rows unbounded preceding)::bigint as cluster from (
      select *, case when coalesce(published_at - lag(published_at) over (partition by entity, lang order by published_at, source_id) > interval 4 days, true) then 1 else 0 end as fresh from docs_v)""",
}.items()}
