"""The timeline as the queries pass it on: without texts of documents, and worked out once."""

from pyspark.sql import functions as F

from tidemark.operators import identity, text
from tidemark.plans import report, reports, state

SF = "/root/testdata/sf0.001"


def test_clauses_do_not_carry_their_documents(spark):
    assert not {"body", "title", "title_key"} & set(reports.timeline(spark, SF).columns)


def test_occurrences_read_a_narrow_table(spark, monkeypatch):
    given = []
    monkeypatch.setattr(identity, "event_instances", lambda rows, **_: given.append(rows) or rows)
    reports.instances(spark, SF)
    assert set(given[0].columns) == {"event_id", "published_at", "entity", "event_type", "area", "unit", "value"}


def test_report_works_out_the_timeline_once(spark, monkeypatch):
    calls, plain = [], reports.timeline
    monkeypatch.setattr(reports, "timeline", lambda *a: calls.append(a) or plain(*a))
    assert report.built(spark, SF).count() == 20
    assert len(calls) == 1


def test_words_stand_as_under_the_plain_pattern(spark):
    texts = ["in", "In.", "inn", "_in", "in_", "é in ü", "éin", "ins in", "in\r\n", "\nin", "9in in9", "", " ", None, "to be", "tobe", "TO", "a to", "x.y", "xzy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (("in",), ("in", "to be"), ("x.y",)):
        plain = F.lower("t").rlike(f"(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])")
        assert df.where(~text.any_word(F.col("t"), words).eqNullSafe(plain)).collect() == []


def test_words_at_hand_tell_the_same_as_the_pattern(spark):
    texts = ["in", "In.", "inn", "_in", "in_", "é in ü", "éin", "ins in", "in\r\n", "9in in9", "", " ", None, "to be", "to  be", "to\nbe", "TO", "x.y", "café au lait", "caf au", "a-b", "xa-b", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("words", text.words_of(F.col("t")))
    for words in (("in",), ("in", "to be"), ("to be",), ("x.y",), ("café au",), ("é",), ("a-b", "in"), ("In",)):
        plain = F.lower("t").rlike(f"(?<![a-z0-9_])({'|'.join(words)})(?![a-z0-9_])")
        assert df.where(~text.any_word(F.col("t"), words, F.col("words")).eqNullSafe(plain)).collect() == [], words


def test_clauses_are_cut_as_sentence_by_sentence(spark):
    """One pattern cuts sentences and contrast words; before, each sentence was cut by two rounds of replacements."""
    parts = ["as", "As", "AS.", "as!", "has", "as_", "é", "as", "b.", "c?\n", "\x02", "d;", " ", "\t", "as\n", "e. \n f", "9as"]
    texts = [sep.join(parts[(i * k + k) % len(parts)] for i in range(12)) for k in range(1, 17) for sep in (" ", "", "\n", ". ")] + ["as as as as", "as", "", None, "x as", "as\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, body string")
    once = lambda s: F.regexp_replace(s, "(^|[^A-Za-z0-9_])([aA][sS])($|[^A-Za-z0-9_])", "$1\x02$3")
    cut = F.flatten(F.transform(F.split("body", r"(?<=[.!?])[ \t\n\f\r]+"), lambda s: F.split(once(once(s)), "\x02")))
    want = df.select("k", F.posexplode(F.filter(F.transform(cut, lambda c: F.btrim(c, F.lit(" ,.;:"))), lambda c: c != "")))
    for words in (None, "words"):
        got = text.split_clauses(df, ("as",), words=words).select("k", "clause_index", "clause")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fingerprints_are_those_of_the_whole_text(spark):
    long = "ΑΣ word  \n" * 300
    texts = [long, " " * 3000 + long, "x" * 2000, "Σ" * 399 + " " + "y" * 900, "Σ" * 400 + " y", "ab " * 133 + "Σ " + "z" * 2000, "ab " * 133 + "Σ'" + "z" * 2000, "a" + " " * 1300 + "b", "", None, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.substring(F.sha2(F.concat(text._squeezed(F.lit("T")), F.lit("|"), F.substring(text._squeezed(F.col("t")), 1, 400)).cast("binary"), 256), 1, 24)
    assert df.where(~text.fingerprint(F.lit("T"), F.col("t")).eqNullSafe(whole)).collect() == []


def test_texts_are_read_once_and_go(spark, monkeypatch):
    given = []
    monkeypatch.setattr(identity, "event_instances", lambda rows, **_: given.append(rows) or rows)
    state.clustered(state.read(spark, SF))
    assert not {"clause", "words"} & set(given[0].columns) and "__found" in given[0].columns


def test_documents_are_joined_once_to_their_story(spark):
    """Stories that fingerprints join are put together among titles: a text is shuffled once."""
    rows = [(1, "al\tpha", "x", "TERTIARY", 1), (2, "al pha", "x", "SECONDARY", 2), (3, "alpha", "y", "PRIMARY", 3), (4, "other", "y", "PRIMARY", 4)]
    found = text.dedupe_documents(spark.createDataFrame(rows, "source_id long, title string, body string, reliability string, published_at long"))
    assert {r["source_id"]: (r["title_key"], r["duplicate_of"]) for r in found.collect()} == {1: ("alpha", 3), 2: ("al pha", 3), 3: ("alpha", None), 4: ("other", None)}
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
