"""Reports of companies: one row each, nothing lost, and views that read no other field."""

import contextlib
import io
import tempfile

from pyspark.sql import functions as F

from tidemark.operators import report


def test_report_and_views(spark):
    entities = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "entity string")
    told = spark.createDataFrame([("A", "x", "POSITIVE"), ("A", "w", None), ("Z", "q", "NEGATIVE")], "entity string, topic string, sentiment string")
    risks = spark.createDataFrame([("A", "LEGAL"), ("B", None)], "entity string, category string")
    judged = spark.createDataFrame([("B", 2.0), ("B", 1.0)], "entity string, score double")
    rows = report.research_report(entities, {"narratives": told, "risks": risks}, {"assessment": judged})
    got = {r["entity"]: r for r in rows.collect()}
    assert sorted(got) == ["A", "B"] and [n["topic"] for n in got["A"]["narratives"]] == ["w", "x"]
    assert got["B"]["narratives"] == [] and got["B"]["assessment"]["score"] == 1.0 and got["A"]["assessment"] is None
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/report"
    rows.write.parquet(path)
    held = spark.read.parquet(path)
    seen = report.view(held, "narratives", "topic", watched=spark.createDataFrame([("A",)], "entity string"))
    assert sorted(r["topic"] for r in seen.collect()) == ["w", "x"]
    assert report.view(held, "assessment").collect()[0]["score"] == 1.0
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        report.view(held, "narratives", "topic").explain("formatted")
    scan = next(line for line in out.getvalue().splitlines() if line.startswith("ReadSchema"))
    assert "topic" in scan and "sentiment" not in scan and "risks" not in scan and "assessment" not in scan


def test_latest_few(spark):
    rows = spark.range(50).select(F.lit("A").alias("entity"), (F.col("id") % 25).alias("at"), "id")
    assert sorted(r["id"] for r in report.latest_few(rows, "at", "id", 3).collect()) == [23, 24, 49]
