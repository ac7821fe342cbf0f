"""The state of a company in the news: what kind of statement a clause is, whom it is about, what it implies along fixed
axes, and these implications gathered per event, per company and over time.

Implications are rows of (axis, value, weight), so that means and variances are partial sums; no event or company is
collected into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.research import clause_score, event_weight, magnitude
from tidemark.operators.text import any_word, words_of

# Cues, patterns, rules and weights that decide results.
SPECULATION_CUES = ("could", "might", "may ", "likely to", "expected to", "analysts expect", "investors may", "could see", "may see", "is expected", "are expected", "forecast to", "projected to")
INTERPRETATION_CUES = ("suggests", "reflects", "appears to", "appears that", "indicates", "signals", "raises questions", "may indicate", "points to", "underscores")
MANAGEMENT_CUES = (
    "management said", "management expects", "management stated", "management noted", "management raised", "management raises", "company said", "company expects",
    "company stated", "the company raised", "ceo said", "cfo said", "chief executive said", "chief financial officer said", "in a statement", "raises its guidance",
    "raised its guidance", "raises guidance", "raised guidance", "raises its outlook", "raised its outlook", "guidance to", "forecasts", "the company forecasts", "management forecasts",
)
CERTAINTY = {"OBSERVED_FACT": 1.0, "MANAGEMENT_CLAIM": 0.65, "THIRD_PARTY_REPORTING": 0.55, "ANALYST_INTERPRETATION": 0.4, "SPECULATION": 0.2}
COMPETITOR_CUES = ("rival", "rivals", "competitor", "competitors", "competing firm", "cross-town rival")
COUNTERPARTY_CUES = ("customer", "customers", "client", "clients", "supplier", "suppliers", "vendor", "vendors", "partner", "partners", "distributor", "distributors")
SUBSIDIARY_CUES = ("subsidiary", "subsidiaries", "business unit", "division", "unit of")
INDUSTRY_CUES = ("industry-wide", "industrywide", "sector-wide", "sectorwide", "across the industry", "across the sector", "the broader industry", "the whole industry", "the entire industry", "industry peers", "sector peers", "peers across the industry")
NAME_SUFFIXES = ("CORPORATION", "INCORPORATED", "HOLDINGS", "COMPANY", "LIMITED", "CORP", "INC", "LTD", "PLC", "LLC", "CO")
AXES = ("growth", "profitability", "cash_flow", "balance_sheet", "demand", "supply_chain", "competitive_position", "regulatory", "guidance", "risk")
RULES = (
    (("revenue",), "growth", "DIRECT"), (("earnings",), "profitability", "DIRECT"), (("guidance",), "guidance", "DIRECT"), (("guidance",), "growth", "DIRECT"),
    (("cash_flow",), "cash_flow", "DIRECT"), (("debt", "capital_allocation"), "balance_sheet", "DIRECT"), (("regulatory",), "regulatory", "DIRECT"),
    (("supply_chain",), "supply_chain", "DIRECT"), (("competition",), "competitive_position", "DIRECT"), (("demand",), "demand", "DIRECT"),
    (("regulatory", "geopolitical", "workforce", "supply_chain", "competition"), "risk", "INVERSE"),
)
SAVING_CUES = ("cost-cutting", "cost cutting", "cost reduction", "reduce costs", "reducing costs", "streamline", "cost savings", "lower costs", "cut costs")
MODALITY = {"FACT": 1.0, "REPORTING": 1.0, "INTERPRETATION": 0.7, "SPECULATION": 0.4}
MATERIALITY = {"HIGH": 1.0, "MEDIUM": 0.55, "LOW": 0.25}
TRUST = {"PRIMARY": 1.0, "SECONDARY": 0.6, "TERTIARY": 0.3}
SCORED, DIRECTION_ONLY = 0.85, 0.4
CONFIRMATION, DISAGREEMENT, LEAST_PRIORS, DOMINANT = 0.7, 0.15, 3, 5
TERMS = {
    "SHORT_TERM": ("next quarter", "this quarter", "near-term", "near term"),
    "MEDIUM_TERM": ("this year", "next year", "full-year", "full year", "fiscal year"),
    "LONG_TERM": ("long-term", "long term", "multi-year", "strategic", "over the coming years"),
}
RAISED_GUIDANCE = (r"\braises?\s+(?:full[- ]year\s+)?guidance\b", r"\braises?\s+(?:full[- ]year\s+)?(?:forecast|outlook)\b", r"\bboosts?\s+guidance\b", r"\blifts?\s+(?:full[- ]year\s+)?(?:guidance|forecast|outlook)\b")
CUT_GUIDANCE = (r"\bcuts?\s+(?:full[- ]year\s+)?guidance\b", r"\bcuts?\s+(?:full[- ]year\s+)?(?:forecast|outlook)\b", r"\blowers?\s+(?:full[- ]year\s+)?(?:guidance|forecast|outlook)\b", r"\bslashes?\s+(?:full[- ]year\s+)?(?:guidance|forecast|outlook)\b", r"\bwithdraws?\s+guidance\b")
RAISED_DIVIDEND = (r"\bincreases?\s+(?:its\s+)?(?:quarterly\s+)?dividend\b", r"\braises?\s+(?:its\s+)?(?:quarterly\s+)?dividend\b", r"\bdeclares?\s+(?:a\s+)?special\s+dividend\b")
CUT_DIVIDEND = (r"\bsuspends?\s+(?:its\s+|the\s+)?(?:quarterly\s+)?dividend\b", r"\beliminates?\s+(?:its\s+)?(?:quarterly\s+)?dividend\b", r"\bwill\s+not\s+pay\s+a\s+dividend\b", r"\breduces?\s+the\s+quarterly\s+dividend\b")
ITEM_RULES = ((RAISED_GUIDANCE, "GUIDANCE_CHANGE", "positive"), (CUT_GUIDANCE, "GUIDANCE_CHANGE", "negative"), (RAISED_DIVIDEND, "DIVIDEND_CHANGE", "positive"), (CUT_DIVIDEND, "DIVIDEND_CHANGE", "negative"))

CLUSTER = ("entity", "event_type", "area", "cluster")
#: Columns with what events' clauses tell, see clause_facts.
FACTS = ("__own", "__found", "__areas", "__kind", "__term", "__saving")


def rounded(x: Column, places: int) -> Column:
    """Half away from zero, with a margin for how doubles were summed, so that the order of sums doesn't show."""
    unit = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5 + 1e-9) / unit + F.lit(0.0)


def _contains(text: Column, cues: Sequence[str]) -> Column:
    hit = F.lit(False)
    for cue in cues:
        hit = hit | F.contains(text, F.lit(cue))
    return hit


def _named(labels: Mapping[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[key], F.lit(default))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys among which nulls are equal."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*[f"__{k}" for k in keys])


def interpret_items(items: DataFrame, text: str = "text") -> DataFrame:
    """Items with event_type and direction by the first list of patterns with a match; items without one go, as do those
    without a text."""
    case = F
    for patterns, kind, direction in ITEM_RULES:
        case = case.when(F.lower(text).rlike("|".join(patterns)), F.struct(F.lit(kind).alias("event_type"), F.lit(direction).alias("direction")))
    return items.withColumn("__found", case.otherwise(None)).where("__found is not null").select(*items.columns, "__found.*")


def epistemic(clause: Column, source_type: Column) -> Column:
    """How a clause is known: filings are observed; else by the first kind with a cue, hedges first."""
    low = F.lower(clause)
    return F.when(source_type == "filing", "OBSERVED_FACT").when(_contains(low, SPECULATION_CUES), "SPECULATION").when(_contains(low, MANAGEMENT_CUES), "MANAGEMENT_CLAIM").when(_contains(low, INTERPRETATION_CUES), "ANALYST_INTERPRETATION").otherwise("THIRD_PARTY_REPORTING")


def name_aliases(name: Column) -> Column:
    """The registered name, and the same without one legal suffix; no names for a null or empty one."""
    short = F.trim(F.regexp_replace(name, f"(?i) ({'|'.join(NAME_SUFFIXES)})$", ""))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.array(name, short), lambda n: n != "")))


def attribution(clause: Column, entity: Column, aliases: Column, among: Column | None = None) -> Column:
    """Struct of role and attributable: whom a clause of this entity's documents is about. `among`: the clause's words_of."""
    padded = words_of(clause) if among is None else among
    names = F.concat(F.array(F.lower(entity)), F.transform(aliases, lambda a: F.lower(a)))
    plain = F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"\W+", " ")))
    told = F.exists(F.filter(plain, lambda n: n != ""), lambda n: F.contains(padded, F.concat(F.lit(" "), n, F.lit(" "))))
    has = lambda cues: any_word(clause, cues, among)
    rival = has(COMPETITOR_CUES)
    party = F.when(rival, F.trim(F.regexp_extract(clause, r"(?:^|\W)(?i:" + "|".join(COMPETITOR_CUES) + r")\s+((?:[A-Z][A-Za-z0-9&.\-]*\s*){1,3})", 1)))
    other = rival & (party != "") & ~F.array_contains(names, F.lower(party))
    role = F.when(other, "COMPETITOR").when(has(INDUSTRY_CUES) & ~told, "INDUSTRY").when(has(COUNTERPARTY_CUES), "COUNTERPARTY").when(has(SUBSIDIARY_CUES), "SUBSIDIARY").otherwise("SELF")
    return F.struct(role.alias("role"), (~role.isin("COMPETITOR", "INDUSTRY")).alias("attributable"))


def all_areas(clause: Column, areas: Mapping[str, Sequence[str]], among: Column | None = None) -> Column:
    """Every area with a word in the clause, in the order of the areas."""
    return F.array_compact(F.array(*[F.when(any_word(clause, words, among), area) for area, words in areas.items()]))


def clause_facts(events: DataFrame, areas: Mapping[str, Sequence[str]], aliases: Column | None = None, among: Column | None = None) -> DataFrame:
    """events with FACTS, all that later steps need of a clause's text: whether it is about its own company, its figure, areas
    and kind, the time that it speaks of, and whether it tells of savings. With these the text can be dropped, and no step
    reads it again."""
    clause = F.col("clause")
    names = F.array().cast("array<string>") if aliases is None else aliases
    own = F.coalesce(attribution(clause, F.col("entity"), names, among)["attributable"], F.lit(True))
    term = F.lit(len(TERMS) + 1)
    for i, cues in reversed(list(enumerate(TERMS.values(), 1))):
        term = F.when(_contains(F.lower(clause), cues), i).otherwise(term)
    told = all_areas(clause, areas, among)
    saving = any_word(clause, areas["workforce"], among) & _contains(F.lower(clause), SAVING_CUES) if "workforce" in areas else F.lit(False)
    return events.withColumns(dict(zip(FACTS, (own, magnitude(clause), told, epistemic(clause, F.col("source_type")), term, saving))))


def _read(events: DataFrame, areas: Mapping[str, Sequence[str]]) -> DataFrame:
    return events if set(FACTS) <= set(events.columns) else clause_facts(events, areas)


def implications(events: DataFrame, areas: Mapping[str, Sequence[str]]) -> DataFrame:
    """Events (clause or clause_facts, sentiment, evidence_type) once per rule that they set off: axis, value, weight and
    basis. A clause without a direction sets off nothing but the rule on savings."""
    rows = _read(events, areas).withColumns({"areas": F.col("__areas"), "__score": clause_score(F.col("__found"), F.col("sentiment")), "weight": _named(MODALITY, F.col("evidence_type"), 1.0)})
    item = lambda axis, value, basis: F.struct(F.lit(axis).alias("axis"), value.alias("value"), F.lit(basis).alias("basis"))
    hits = [F.when(F.col("__score").isNotNull() & F.arrays_overlap("areas", F.array(*[F.lit(a) for a in names])), item(axis, F.col("__score") * (1 if kind == "DIRECT" else -1), "STATED" if kind == "DIRECT" else "INFERRED")) for names, axis, kind in RULES]
    saving = F.when(F.col("__saving"), item("profitability", F.lit(1.0), "INFERRED"))
    return rows.select(*[c for c in events.columns if c not in FACTS], "areas", "weight", F.inline(F.array_compact(F.array(*hits, saving))))


def attributable_events(events: DataFrame, aliases: Column | None = None) -> DataFrame:
    """The events whose clause is about their own company, or about a party or a unit of it: those about a competitor or
    the industry go before anything is gathered. Null clauses stay."""
    names = F.array().cast("array<string>") if aliases is None else aliases
    return events.where(F.coalesce(attribution(F.col("clause"), F.col("entity"), names)["attributable"], F.lit(True)))


def excluded_by_role(events: DataFrame, aliases: Column | None = None) -> DataFrame:
    """(entity, role, n): how many events of a company are about somebody else."""
    names = F.array().cast("array<string>") if aliases is None else aliases
    found = events.select("entity", attribution(F.col("clause"), F.col("entity"), names).alias("found"))
    return found.where(~F.col("found.attributable")).groupBy("entity", F.col("found.role").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def event_axes(implied: DataFrame, keys: Sequence[str] = CLUSTER) -> DataFrame:
    """Per event and axis: weighted mean, weighted variance about the mean before rounding, and on what it rests."""
    v, w = F.col("value"), F.col("weight")
    out = implied.groupBy(*keys, "axis").agg(F.sum(w).alias("__w"), F.sum(v * w).alias("__vw"), F.sum(v * v * w).alias("__vvw"), F.min("basis").alias("__b"), F.max("basis").alias("__c"))
    mean = F.col("__vw") / F.col("__w")
    spread = F.greatest(F.col("__vvw") / F.col("__w") - mean * mean, F.lit(0.0))
    return out.select(*keys, "axis", rounded(mean, 2).alias("mean"), rounded(spread, 4).alias("dispersion"), F.when(F.col("__b") == F.col("__c"), F.col("__b")).otherwise("MIXED").alias("basis"))


def event_vectors(events: DataFrame, areas: Mapping[str, Sequence[str]], keys: Sequence[str] = CLUSTER) -> DataFrame:
    """Per event: last time, sentiment, materiality, certainty, strongest kind of statement, time it speaks of, sources,
    their quality, confirmation, and how far its size was measured. Sources are counted once each, copies as one."""
    found, way = F.col("__found"), F.when(F.col("sentiment") == "POSITIVE", 1.0).when(F.col("sentiment") == "NEGATIVE", -1.0)
    triggers = sorted({a for names, _, _ in RULES for a in names})
    fired = clause_score(found, F.col("sentiment")).isNotNull() & F.arrays_overlap("__areas", F.array(*[F.lit(a) for a in triggers]))
    measured = found["score"].isNotNull() & ((found["value"] < 0) | way.isNotNull())
    rows = _read(events, areas).withColumns({"__way": way, "__sure": F.when(fired, F.when(F.coalesce(measured, F.lit(False)), SCORED).otherwise(DIRECTION_ONLY))})
    rank = F.array_position(F.array(*[F.lit(k) for k in CERTAINTY]), F.col("__kind"))
    sums = {"certain": _named(CERTAINTY, F.col("__kind"), 0.3), "way": F.col("__way"), "sure": F.col("__sure")}
    parts = [e for n, c in sums.items() for e in (F.sum(c).alias(f"{n}_s"), F.count(c).alias(f"{n}_n"))]
    each = rows.groupBy(*keys, "source_id").agg(F.max("published_at").alias("at"), F.first(F.coalesce("duplicate_of", "source_id")).alias("story"), F.max(_named(TRUST, F.col("reliability"), 0.3)).alias("trust"), F.max(_named(MATERIALITY, F.col("materiality"), 0.25)).alias("materiality"), F.min(rank).alias("rank"), F.min("__term").alias("term"), F.count(F.lit(1)).alias("clauses"), *parts)
    total = [F.sum(c).alias(c) for n in sums for c in (f"{n}_s", f"{n}_n")]
    out = each.groupBy(*keys).agg(F.max("at").alias("as_of"), F.countDistinct("story").alias("independent_sources"), F.avg("trust").alias("trust"), F.max("materiality").alias("materiality"), F.min("rank").alias("rank"), F.min("term").alias("term"), F.sum("clauses").alias("clauses"), *total)
    ratio = lambda n: F.col(f"{n}_s") / F.nullif(F.col(f"{n}_n"), F.lit(0))
    quality = rounded(F.col("trust"), 4)
    confirmed = rounded((1 - F.pow(F.lit(2.718281828), -CONFIRMATION * F.col("independent_sources"))) * quality, 4)
    return out.select(*keys, "as_of", rounded(ratio("way"), 4).alias("text_sentiment"), "materiality", ratio("certain").alias("certainty"), F.get(F.array(*[F.lit(k) for k in CERTAINTY]), (F.col("rank") - 1).cast("int")).alias("epistemic_status"), F.coalesce(F.get(F.array(*[F.lit(t) for t in TERMS]), F.col("term") - 1), F.lit("UNSPECIFIED")).alias("time_horizon"), "independent_sources", "clauses", quality.alias("source_quality"), confirmed.alias("confirmation"), F.coalesce(rounded(ratio("sure"), 4), F.lit(0.0)).alias("magnitude_confidence"))


def weighed(vectors: DataFrame, now: Column) -> DataFrame:
    age = (now.cast("long") - F.col("as_of").cast("long")) / 86400
    return vectors.withColumn("event_weight", event_weight(age, F.col("materiality"), F.col("confirmation")))


def company_axes(vectors: DataFrame, axes: DataFrame, now: Column, by: Sequence[str] = ("entity",), keys: Sequence[str] = CLUSTER) -> DataFrame:
    """Per company and axis: weighted mean of its events, variance within and between them together, and whether they
    contradict each other."""
    heavy = weighed(vectors, now)
    own = [c for c in by if c not in keys]
    rows = same_keys(axes, heavy.select(*keys, *own, "event_weight"), keys)
    w, v = F.col("event_weight"), F.col("mean")
    out = rows.groupBy(*by, "axis").agg(F.sum(w).alias("__w"), F.sum(w * v).alias("__v"), F.sum(w * v * v).alias("__vv"), F.sum(w * F.col("dispersion")).alias("__d")).where("__w > 0")
    mean = F.col("__v") / F.col("__w")
    spread = rounded(F.greatest(F.col("__vv") / F.col("__w") - mean * mean, F.lit(0.0)) + F.col("__d") / F.col("__w"), 4)
    return out.select(*by, "axis", rounded(mean, 4).alias("mean"), spread.alias("dispersion")).withColumn("contradicted", F.col("dispersion") > DISAGREEMENT)


def company_state(vectors: DataFrame, now: Column, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Per company: events, confidence (certainty, raised by confirmation), quality of sources and sentiment, weighted as
    the events are."""
    w, s = F.col("event_weight"), F.col("text_sentiment")
    sure = F.col("certainty") * (0.5 + 0.5 * F.col("confirmation"))
    out = weighed(vectors, now).groupBy(*by).agg(F.count(F.lit(1)).alias("independent_events"), F.sum(w).alias("__w"), F.sum(sure * w).alias("__c"), F.sum(F.col("source_quality") * w).alias("__q"), F.sum(s * w).alias("__s"), F.sum(F.when(s.isNotNull(), w)).alias("__sw"))
    whole = F.when(F.col("__w") == 0, 1.0).otherwise(F.col("__w"))
    return out.select(*by, "independent_events", rounded(F.col("__c") / whole, 4).alias("confidence"), rounded(F.col("__q") / whole, 4).alias("source_quality"), F.when(F.col("__sw") > 0, rounded(F.col("__s") / F.col("__sw"), 4)).alias("text_sentiment"))


def dominant_events(vectors: DataFrame, tie: Sequence[str] = CLUSTER[1:], most: int = DOMINANT) -> DataFrame:
    """The events of most materiality of each company, as many as the state names."""
    order = Window.partitionBy("entity").orderBy(F.col("materiality").desc(), *tie)
    return vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def profiles(vectors: DataFrame, axes: DataFrame, keys: Sequence[str] = CLUSTER) -> DataFrame:
    """vectors with `profile`, the means of all axes in their order (null where there is none)."""
    wide = axes.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("axis") == a, F.col("mean"))) for a in AXES]).alias("profile"))
    return same_keys(vectors, wide, keys, "left")


def novelty(profiled: DataFrame) -> DataFrame:
    """Per event: how many events its company had before it, and the least root mean square distance from any of them over
    the axes that both have; null with fewer than three before. Means have two decimals, so companies repeat themselves:
    equal profiles are compared once, each from its first time on."""
    days = profiled.groupBy("entity", "as_of").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("entity").orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("entity", "as_of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("priors"))
    asked = profiled.where("profile is not null").select("entity", "as_of", "profile").distinct()
    known = profiled.where("profile is not null").groupBy("entity", F.col("profile").alias("earlier")).agg(F.min("as_of").alias("first_at"))
    gaps = F.array_compact(F.zip_with("profile", "earlier", lambda a, b: (a - b) * (a - b)))
    apart = F.when(F.size(gaps) > 0, F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps)))
    near = asked.join(known, "entity").where("first_at < as_of").groupBy("entity", "as_of", "profile").agg(F.min(apart).alias("nearest"))
    rows = profiled.join(days, ["entity", "as_of"]).join(near, ["entity", "as_of", "profile"], "left")
    return rows.withColumn("novelty", F.when(F.col("priors") >= LEAST_PRIORS, rounded(F.col("nearest"), 4)))


def trajectory(states: DataFrame) -> DataFrame:
    """Company states over time (entity, as_of, axis, mean): per state its distance from the one before over the axes that
    both have, by day."""
    wide = states.groupBy("entity", "as_of").agg(F.array(*[F.max(F.when(F.col("axis") == a, F.col("mean"))) for a in AXES]).alias("axes"))
    by = Window.partitionBy("entity").orderBy("as_of")
    delta = F.zip_with("axes", "__last", lambda a, b: rounded(a - b, 4))
    rows = wide.withColumns({"__last": F.lag("axes").over(by), "__at": F.lag("as_of").over(by)}).where("__last is not null").withColumn("delta", delta)
    shared = F.array_compact("delta")
    size = F.sqrt(F.aggregate(shared, F.lit(0.0), lambda s, x: s + x * x))
    days = F.greatest((F.col("as_of").cast("long") - F.col("__at").cast("long")) / 86400, F.lit(1e-6))
    rows = rows.withColumns({"changed": F.size(shared), "magnitude": size, "velocity": F.when(F.size(shared) > 0, rounded(size / days, 6))})
    return rows.withColumn("heading", F.transform("delta", lambda d: F.when(d.isNotNull(), F.when(F.col("magnitude") > 0, rounded(d / F.col("magnitude"), 4)).otherwise(0.0)))).drop("__last", "__at")
