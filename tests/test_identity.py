"""Occurrences against pairwise linking of all events, and the gate that keeps other parties' events out."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import identity, news_state as ns, text

DAY = dt.datetime(2024, 6, 1)
SCHEMA = "event_id string, entity string, event_type string, area string, published_at timestamp, unit string, value double"


def clusters(spark, rows, days=4):
    df = spark.createDataFrame(rows, SCHEMA)
    out = identity.event_instances(df, unit=F.col("unit"), value=F.col("value"), days=days).collect()
    groups = {}
    for r in out:
        groups.setdefault((r["entity"], r["event_type"], r["area"], r["cluster"]), set()).add(r["event_id"])
    return groups


def row(i, day, unit=None, value=None, entity="A", area="revenue"):
    return (f"e{i:04d}", entity, "EARNINGS", area, DAY + dt.timedelta(days=day), unit, value)


def test_cases(spark):
    def parts(*rows):
        return sorted(map(len, clusters(spark, list(rows)).values()))

    assert parts(row(1, 0), row(2, 1), row(3, 2)) == [3]
    assert parts(row(1, 0), row(2, 19)) == [1, 1]
    assert parts(row(1, 0), row(2, 0, area="regulatory")) == [1, 1]
    assert parts(row(1, 0), row(2, 0, entity="B")) == [1, 1]
    assert parts(row(1, 0, "PERCENT", 2.0), row(2, 1, "PERCENT", 40.0)) == [1, 1]
    assert parts(row(1, 0, "PERCENT", 40.0), row(2, 1, "PERCENT", 42.0)) == [2]
    assert parts(row(1, 0, "PERCENT", 40.0), row(2, 1)) == [2]
    assert parts(row(1, 0), row(2, 3), row(3, 6)) == [3]
    assert parts(row(1, 0), row(2, 2), row(3, 4)) == [3]
    assert parts(row(1, 0, "PERCENT", 4.0), row(2, 0, "PERCENT", 8.0), row(3, 0, "PERCENT", -4.0), row(4, 0, "PERCENT", 16.1)) == [1, 1, 2]
    assert parts(row(1, 0, "PERCENT", 2.0), row(2, 0, "PERCENT", 90.0), row(3, 4, "USD", 1e9)) == [3]
    assert identity.event_instances(spark.createDataFrame([], SCHEMA), unit=F.col("unit"), value=F.col("value")).count() == 0


def brute(rows, days=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[1:4] == b[1:4] and abs((a[4] - b[4]).days) <= days:
                diverge = a[5] is not None and a[5] == b[5] and abs(a[6] - b[6]) / max(abs(a[6]), abs(b[6]), 1e-9) > 0.5
                if not diverge:
                    root[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), set()).add(r[0])
    return sorted(map(sorted, out.values()))


def test_occurrences_are_components_of_all_links(spark):
    rng = random.Random(4)
    values = [0.5, 1.0, 1.9, 2.0, 2.1, 3.9, 4.0, 4.1, 8.0, 8.2, 31.0, 64.0, 1e9, 0.0]
    rows = []
    for i in range(500):
        unit = rng.choice(["PERCENT", "PERCENT", "PERCENT", "BPS", None]) if i % 5 == 0 else "PERCENT"
        value = rng.choice(values) * rng.choice([1, 1, -1]) if unit else None
        rows.append(row(i, rng.randint(0, 120), unit, value, area=rng.choice(["revenue", None, "x", "y", "z"])))
    assert sorted(map(sorted, clusters(spark, rows).values())) == brute(rows)
    # A hot topic: very many events of few sizes are few cells.
    hot = [row(i, i % 40, "USD", float(i % 97 + 1)) for i in range(3000)]
    df = spark.createDataFrame(hot, SCHEMA)
    assert identity.links(identity.cells(df, ["entity", "event_type", "area"], F.col("unit"), F.col("value"))).count() < 40 * 5 * 3 * 8
    assert sorted(map(sorted, clusters(spark, hot[:400]).values())) == brute(hot[:400])


def test_other_parties_stay_out(spark):
    said = ["Rival AMD posted revenue growth of 40% in its latest quarter.", "New sanctions are expected to hurt the broader industry.", "Revenue grew 10%.", "Its customers bought more.", None]
    rows = spark.createDataFrame([("NVDA", i, t) for i, t in enumerate(said)], "entity string, event_id int, clause string")
    assert {r["event_id"] for r in ns.attributable_events(rows).collect()} == {2, 3, 4}
    assert {(r["role"], r["n"]) for r in ns.excluded_by_role(rows).collect()} == {("COMPETITOR", 1), ("INDUSTRY", 1)}


def test_titles_alone_tell_stories(spark):
    rows = [(1, "Acme cuts outlook", "SECONDARY", DAY), (2, "Acme cuts outlook - Reuters", "PRIMARY", DAY), (3, None, "PRIMARY", DAY), (4, None, "PRIMARY", DAY)]
    df = spark.createDataFrame(rows, "source_id long, title string, reliability string, published_at timestamp")
    assert {r["source_id"]: r["duplicate_of"] for r in text.dedupe_documents(df).collect()} == {1: 2, 2: None, 3: None, 4: None}
