"""A pipeline of five stages from documents to token ids. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import kept_text, line_dedup
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.common import digest
from tidemark.llm.mix import mix_sources
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.queries import tokenizer
from tidemark.llm.sentencepiece_codec import encode_documents
from tidemark.shared import work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns as they are. Null and empty texts have no words and go;
    repeated rows are judged each; empty input gives no rows."""
    return quality_rules(docs, keep_columns=True).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; n_chars follows. A document left without text stays, empty; a
    null text becomes empty; repeated rows count once among the ten and each stay; empty input gives no rows."""
    rows = line_dedup(docs).withColumn("text", kept_text())
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id. Of rows of one id and text the least stays;
    null texts count as empty, null ids come last in a class; empty input gives no rows."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    rows = docs.withColumn("__of", digest("text"))
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__of"] == kept["__digest"]), "left_semi")
    return joined.groupBy("doc_id", "__of").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its words are taken; a part is rounded up or down by a draw from its id and
    text, so that sources keep near their targets. Texts without words go; a null source is one of its own; repeated rows
    are mixed each; empty input gives no rows."""
    mixed = mix_sources(docs, keep_columns=True).where("taken > 0")
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.col("size")) < F.pmod("taken", "size")
    times = F.floor(F.col("taken") / F.col("size")).cast("int") + part.cast("int")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("row.*").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, the md5 of the text decoded from them, and whether that is the text itself.
    Null texts count as empty; empty texts have no ids; repeated rows are encoded each; empty input gives no rows."""
    rows = encode_documents(docs.select("doc_id", "source", "text"), tokenizer("piece_bpe_32k.model"), decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_ids"), F.md5("decoded").alias("decoded_md5"), same.alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near_dedup), ("mixing", mix), ("SentencePiece", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = work_dir(spark, f"stage{i}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        docs = out
    return docs
