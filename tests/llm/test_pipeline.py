"""The pipeline against the stages' rules, each judged on its own input."""

from collections import Counter
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline as p
from tidemark.llm.queries import tokenizer
from tidemark.llm.sentencepiece_codec import load

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, lines, near, mix, encode = (f for _, f in p.STAGES)
    kept = quality(spark, docs, SF)
    assert kept.columns == docs.columns
    lost = docs.subtract(kept).collect()
    assert all(len(r["text"].split()) < 50 or len(set(r["text"].split())) < 0.8 * len(r["text"].split()) for r in lost)
    cut = lines(spark, kept, SF)
    assert cut.columns == docs.columns and cut.count() == kept.count()
    one = near(spark, cut, SF)
    assert one.columns == docs.columns and one.select("text").distinct().count() == one.count() == near(spark, cut.union(cut), SF).count()
    mixed = mix(spark, one, SF)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    library = load(tokenizer("piece_bpe_32k.model")).library
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    out = encode(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in out)
    assert all(r["decoded_md5"] == md5(library.decode(r["ids"]).encode()).hexdigest() for r in out)
    assert all(r["round_trip"] == (library.decode(r["ids"]) == texts[r["doc_id"]]) for r in out)


def test_nulls_and_repeats(spark):
    """A null in each column, repeated rows and empty texts: each stage on rows that the one before would not give it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.withColumn("text", docs["text"].substr(1, 3000)).cache()
    odd = [docs.where("doc_id is not null").limit(1).withColumn(c, F.lit(None).cast(docs.schema[c].dataType)) for c in docs.columns]
    odd.append(docs.limit(1).withColumn("text", F.lit("")))
    rows = reduce(DataFrame.unionByName, [docs, docs, *odd])
    quality, lines, near, mix, encode = (f for _, f in p.STAGES)
    assert quality(spark, rows, SF).where("text is null or text = ''").count() == 0
    assert lines(spark, rows, SF).count() == rows.count()
    one = near(spark, rows, SF)
    assert one.where("coalesce(text, '') = ''").count() == 1 and one.count() <= docs.count() + 1
    assert mix(spark, rows, SF).where("coalesce(text, '') = ''").count() == 0
    out = encode(spark, rows, SF).collect()
    assert len(out) == rows.count() and all(r["n_ids"] == len(r["ids"]) for r in out)
    assert [r["ids"] for r in out if r["n_ids"] == 0] == [[], []] and all(r["round_trip"] for r in out if r["n_ids"] == 0)


def test_run(spark):
    assert p.run(spark, SF).count() > 50


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
