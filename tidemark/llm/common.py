"""What the operators of this subpackage share: column expressions and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit(""))


def digest(text_col: str) -> Column:
    """16 bytes of a whole text."""
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes for a document: its id and its whole text. Repeated rows share a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit("|"), text_or_empty(text_col)).cast("binary")))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
