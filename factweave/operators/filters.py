"""Predicates over evidence: four-state logic, constraint trees, overlaps, policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_private

UNSATISFIED, UNKNOWN, UNSUPPORTED, SATISFIED = 0, 1, 2, 3


def and4(*states: Column) -> Column:
    """Any unsatisfied wins, then unknown, then unsupported; of none: satisfied."""
    if not states:
        return F.lit(SATISFIED)
    any_ = lambda code: reduce(lambda a, b: a | b, [s == code for s in states])
    return F.when(any_(UNSATISFIED), UNSATISFIED).when(any_(UNKNOWN), UNKNOWN).when(any_(UNSUPPORTED), UNSUPPORTED).otherwise(SATISFIED)


def or4(*states: Column) -> Column:
    """Any satisfied wins, then unknown, then unsupported; of none: unsatisfied."""
    if not states:
        return F.lit(UNSATISFIED)
    any_ = lambda code: reduce(lambda a, b: a | b, [s == code for s in states])
    return F.when(any_(SATISFIED), SATISFIED).when(any_(UNKNOWN), UNKNOWN).when(any_(UNSUPPORTED), UNSUPPORTED).otherwise(UNSATISFIED)


def not4(state: Column) -> Column:
    """Swaps satisfied and unsatisfied only."""
    return F.when(state == SATISFIED, UNSATISFIED).when(state == UNSATISFIED, SATISFIED).otherwise(state)


def state_of(condition: Column) -> Column:
    """A plain condition as a state: null is unknown."""
    return F.when(condition.isNull(), UNKNOWN).when(condition, SATISFIED).otherwise(UNSATISFIED)


_OPS = {"eq": lambda c, v: c == v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "contains": lambda c, v: F.contains(c, F.lit(v)), "in": lambda c, v: c.isin(v), "exists": lambda c, v: c.isNotNull() == F.lit(v)}


def constraint(tree: dict) -> Column:
    """A boolean column from {"and": [..]}, {"any": [..]}, {"not": ..} or {"field", "op", "value"}; a null term is false."""
    if "and" in tree:
        return reduce(lambda a, b: a & b, map(constraint, tree["and"]), F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, map(constraint, tree["any"]), F.lit(False))
    if "not" in tree:
        return ~constraint(tree["not"])
    return F.coalesce(_OPS[tree["op"]](F.col(tree["field"]), tree["value"]), F.lit(False))


def budget_overlap(df: DataFrame, low: str, high: str, ask_low: float, ask_high: float) -> DataFrame:
    """The price band overlaps the asked band; 0 to 0 is unknown and fails."""
    return df.filter(~((F.col(low) == 0) & (F.col(high) == 0)) & (F.col(high) >= ask_low) & (F.col(low) <= ask_high))


def evaluate_terms(df: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """C4: a state column for each term, and their conjunction."""
    states = {name: state_of(c) for name, c in terms.items()}
    return df.withColumns(states).withColumn("all_terms", and4(*[F.col(n) for n in states]))


def numeric_constraint(value: Column, unit: Column, units: dict[str, float], op: str, wanted: float, tolerance: float = 0.001) -> Column:
    """In the canonical unit, within a tolerance; an unknown unit is unsupported, no value unknown."""
    factor = F.lit(None).cast("double")
    for name, f in units.items():
        factor = F.when(unit == name, F.lit(f)).otherwise(factor)
    v = value * factor
    hit = v <= wanted + tolerance if op == "max" else v >= wanted - tolerance
    return F.when(value.isNull(), UNKNOWN).when(factor.isNull(), UNSUPPORTED).when(hit, SATISFIED).otherwise(UNSATISFIED)


def area_matches(area: Column, asked: str, aliases: tuple[str, ...] = ()) -> Column:
    """Equal to the asked area or an alias, or one contains the other when both have four signs or more."""
    names = [asked.lower(), *(a.lower() for a in aliases)]
    a = F.lower(area)
    inside = [F.contains(a, F.lit(n)) | F.contains(F.lit(n), a) for n in names if len(n) >= 4]
    return a.isin(names) | (reduce(lambda x, y: x | y, inside, F.lit(False)) & (F.length(a) >= 4))


def admit_source(df: DataFrame, allowed: dict[str, list[str]], cap: float, floor: float) -> DataFrame:
    """Sources allowed for the key (a key without an entry allows all), confidence capped, and at least ``floor``."""
    ok = F.lit(True)
    for key, sources in allowed.items():
        ok = F.when(F.col("fact_key") == key, F.col("source_type").isin(sources)).otherwise(ok)
    return df.filter(ok).withColumn("confidence", F.least("confidence", F.lit(cap))).filter(F.col("confidence") >= floor)


def visible_facts(df: DataFrame, prefixes: list[str], trusted: list[str]) -> DataFrame:
    """Keys with a never-default prefix only from trusted sources."""
    special = reduce(lambda a, b: a | b, [F.col("fact_key").startswith(p) for p in prefixes], F.lit(False))
    return df.filter(~special | F.col("source_type").isin(trusted))


def requirements(any_filled: list[str] = (), all_filled: list[str] = (), any_positive: list[str] = ()) -> Column:
    """Any of, all of, and any positive of fields."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    ok = F.lit(True)
    if any_filled:
        ok = ok & reduce(lambda a, b: a | b, map(filled, any_filled))
    for c in all_filled:
        ok = ok & filled(c)
    if any_positive:
        ok = ok & F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in any_positive]), F.lit(False))
    return ok


def nearby_filter(df: DataFrame, markers: list[str], blocked: list[str], km: float, local_km: float, least_reviews: int) -> DataFrame:
    """A marker in the name, no blocked word, within ``km``, and enough reviews unless strongly local."""
    name = F.lower("name")
    hit = reduce(lambda a, b: a | b, [F.contains(name, F.lit(m)) for m in markers])
    block = reduce(lambda a, b: a | b, [F.contains(name, F.lit(m)) for m in blocked], F.lit(False))
    return df.filter(hit & ~block & (F.col("km") <= km) & ((F.col("km") <= local_km) | (F.col("reviews") >= least_reviews)))


def severity_band(metres: Column, kv: Column, bands: list[tuple[float, float, str]]) -> Column:
    """C11: the first band (within metres, from kV) that holds, else null."""
    out = F.lit(None).cast("string")
    for within, least_kv, name in reversed(bands):
        out = F.when((metres <= within) & (kv >= least_kv), name).otherwise(out)
    return out


def plausible_price(low: Column, high: Column, area: Column, rate_low: Column, rate_high: Column, slack: float = 0.35) -> Column:
    """The expected rate interval, widened by the slack, overlaps the stated rate."""
    return (area > 0) & (high / area * (1 + slack) >= rate_low) & (low / area * (1 - slack) <= rate_high)


def label_rules(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """(entity_id, label): rules over one fact, the first of several, or a ratio of two, guarded against 0."""
    keys = sorted({k for r in rules for k in r["facts"]})
    wide = facts.filter(F.col("fact_key").isin(keys)).groupBy("entity_id").agg(*[F.max(F.when(F.col("fact_key") == k, F.col("value_number"))).alias(k) for k in keys])
    hits = []
    for r in rules:
        cols = [F.col(k) for k in r["facts"]]
        v = F.when(cols[1] > 0, cols[0] / cols[1]) if r.get("ratio") else F.coalesce(*cols)
        hits.append(F.when(v.isNotNull() if r["op"] == "present" else _OPS[r["op"]](v, r["value"]), F.lit(r["label"])))
    return wide.select("entity_id", F.explode(F.array_compact(F.array(*hits))).alias("label"))


def membership(pairs: DataFrame, edges: DataFrame, exclusive: list[str]) -> DataFrame:
    """Whether a subject is a member of a target in any scope: a satisfied edge, unknown when an exclusive scope names several
    targets among which it is, unsatisfied when every scope names one other target, else unknown. Edges: src, scope, dst."""
    w = Window.partitionBy("src", "scope")
    e = edges.select("src", "scope", "dst").distinct().withColumn("n", F.count(F.lit(1)).over(w))
    j = pairs.join(e, pairs["subject"] == e["src"], "left").withColumn("hit", F.col("dst") == F.col("target"))
    g = j.groupBy("subject", "target").agg(F.max(F.when(F.col("hit"), 1).otherwise(0)).alias("hit"), F.max(F.when(F.col("hit") & F.col("scope").isin(exclusive) & (F.col("n") > 1), 1).otherwise(0)).alias("torn"), F.min(F.when((F.col("n") == 1) & ~F.col("hit"), 1).otherwise(0)).alias("elsewhere"))
    state = F.when(F.col("subject") == F.col("target"), SATISFIED).when(F.col("torn") == 1, UNKNOWN).when(F.col("hit") == 1, SATISFIED).when(F.col("elsewhere") == 1, UNSATISFIED).otherwise(UNKNOWN)
    return g.select("subject", "target", state.alias("state"))


def required_evidence(facts: DataFrame, preferences: list[str], least: float = 0.6) -> DataFrame:
    """Entities with confident evidence for every required key."""
    ok = facts.filter(F.col("fact_key").isin(preferences) & (F.col("confidence") >= least))
    return ok.groupBy("entity_id").agg(F.count_distinct("fact_key").alias("n")).filter(F.col("n") == len(preferences)).select("entity_id")


def reject_images(df: DataFrame, patterns: str, least_px: int, ratio: float) -> Column:
    """C17: the first reason to reject an image, or null."""
    return F.when(F.col("url").rlike(patterns), "pattern").when((F.col("width") < least_px) | (F.col("height") < least_px), "size").when((F.col("width") > F.col("height") * ratio) | (F.col("height") > F.col("width") * ratio), "aspect")


def privacy_ok(c: Column, names: list[str] = ()) -> Column:
    """Neither contact data nor an identifier, an account or a known name, in any case."""
    return ~is_private(c, names)


def compliance_scan(df: DataFrame, column: str, forbidden: list[str], longest: int) -> DataFrame:
    """Rows that break a rule, with the reason."""
    words = F.col(column).rlike("(?i)\\b(" + "|".join(forbidden) + ")\\b")
    return df.withColumn("reason", F.when(words, "forbidden").when(F.length(column) > longest, "too long")).filter("reason IS NOT NULL")
