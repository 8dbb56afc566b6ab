"""Evidence scores, policy scores and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geo import decay
from ..plans.picks import best_row
from ..plans.walk import walk_groups
from .aggregates import at_rank


def evidence_score(value: Column, direction: Column, thresholds: Column, weight: Column) -> Column:
    """Full weight beyond the first threshold, half beyond the second, else 0; direction 'higher' or 'lower'; weight 0 to 2."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(2.0), weight))
    sign = F.when(direction == "lower", -1).otherwise(1)
    full, half = F.element_at(thresholds, 1), F.element_at(thresholds, 2)
    return F.when(value * sign >= full * sign, w).when(value * sign >= half * sign, w / 2).otherwise(0.0)


def risk_score(text: Column, number: Column, concern: Column, bands: tuple[float, float], weight: float, risky: list[str], fine: list[str]) -> Column:
    """R2: a concern annotation, then numeric bands (w, w/2, -w), then the first risk or positive phrase; null without data."""
    has = lambda ws: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in ws])
    low, high = bands
    banded = F.when(number <= low, weight).when(number <= high, weight / 2).otherwise(-weight)
    return F.when(concern, -weight).when(number.isNotNull(), banded).when(has(risky), -weight).when(has(fine), weight)


def with_no_data_penalty(score: Column, penalty: float = 1.2, neutral: bool = False) -> Column:
    """R2: an entity without any evidence."""
    return F.coalesce(score, F.lit(0.0 if neutral else -penalty))


def review_score(rating: Column, n: Column, weights: tuple[float, float] = (0.75, 0.25), divisor: float = 8.0) -> Column:
    """The weighted mean of rating / 5 and ln(1 + n) / ``divisor``, each kept between 0 and 1; null or not a number counts 0."""
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)))
    return (share(rating / 5) * weights[0] + share(F.log1p(n) / divisor) * weights[1]) / F.lit(sum(weights))


def value_score(kind: Column, text: Column, number: Column) -> Column:
    """The share, from 0 to 1, of a typed value: bool, numeric and score by their value, text and tags 0.5 unless empty; null counts 0."""
    filled = F.when(F.trim(text) != "", 0.5).otherwise(0.0)
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
    return F.when(kind == "bool", F.when(F.lower(text) == "true", 1.0).otherwise(0.0)).when(kind.isin("numeric", "score"), within).otherwise(filled)


def access_score(facts: DataFrame, keys: list[str], distance_keys: list[str] = (), full_km: float = 0.5, zero_km: float = 5.0) -> DataFrame:
    """The best value score times confidence over the access keys, in any case; at least 0. Numbers of ``distance_keys`` are km: 1 up to ``full_km``, 0 from ``zero_km`` on."""
    key = F.lower("fact_key")
    km = F.when(key.isin([k.lower() for k in distance_keys]), F.col("value_number"))
    score = F.when(km.isNotNull(), decay(km, full_km, zero_km)).otherwise(value_score(F.col("value_type"), F.col("value_text"), F.col("value_number")))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return facts.filter(key.isin([k.lower() for k in keys])).groupBy("entity_id").agg(F.max(score * sure).alias("access"))


def evidence_floor(positive: Column, risks: Column, constraints: Column) -> Column:
    """0.6 positive in [0.2, 0.45]; 0.1 with risks only; 0.01 with constraints only; else 0."""
    return F.when(positive > 0, F.greatest(F.lit(0.2), F.least(F.lit(0.45), 0.6 * positive))).when(risks > 0, 0.1).when(constraints > 0, 0.01).otherwise(0.0)


def multi_place_score(near: DataFrame) -> DataFrame:
    """Per subject the mean over categories of the best decayed distance."""
    best = near.groupBy("left_id", "category").agg(F.max(1 / (1 + F.col("km"))).alias("s"))
    return best.groupBy("left_id").agg(F.count(F.lit(1)).alias("categories"), F.round(F.avg("s"), 6).alias("score"))


def policy_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Price against the area's upper median (1, 0.75, 0.45, 0.2 at 0.85, 1, 1.12), coverage, presence, risk: the weighted mean
    over observed signals only. Rows: id, area, price, coverage, present (0/1), risk (0/1), any of them null. The median is the value
    at its rank among counted prices, so that no task sorts an area."""
    median = at_rank(df, ["area"], "price", {"median": F.floor(F.col("n") / 2) + 1}).select("area", "median")
    ratio = F.col("price") / F.col("median")
    signals = {"price": F.when(ratio <= 0.85, 1.0).when(ratio <= 1.0, 0.75).when(ratio <= 1.12, 0.45).when(ratio.isNotNull(), 0.2), "coverage": F.col("coverage"), "present": F.col("present").cast("double"), "risk": 1.0 - F.col("risk").cast("double")}
    top = reduce(lambda a, b: a + b, [F.coalesce(s * weights[k], F.lit(0.0)) for k, s in signals.items()])
    all_w = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), weights[k]).otherwise(0.0) for k, s in signals.items()])
    return df.join(median, "area", "left").select("id", F.round(F.when(all_w > 0, top / all_w), 6).alias("score"))


def transparency(parts: dict[str, tuple[Column, float]]) -> Column:
    """0 to 100: the weighted share of components (0 to 1, null counts 0)."""
    total = sum(w for _, w in parts.values())
    return reduce(lambda a, b: a + b, [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))) * w for c, w in parts.values()]) * 100 / total


def recall_candidates(channels: dict[str, DataFrame], caps: dict[str, int], n: int) -> DataFrame:
    """Candidates (anchor, candidate, score) of each channel, the best of each once, capped by channel, united; the ``n`` best by
    summed score, ties by candidate."""
    parts = []
    for name, df in channels.items():
        best = df.groupBy("anchor", "candidate").agg(F.max("score").alias("score"))
        w = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "candidate")
        parts.append(best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= caps[name]).select("anchor", "candidate", "score", F.lit(name).alias("channel")))
    merged = reduce(DataFrame.unionByName, parts).groupBy("anchor", "candidate").agg(F.round(F.sum("score"), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("channels"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "candidate"))).filter(F.col("rank") <= n)


def pick_branches(candidates: DataFrame, lenses: list[str], least: float, fill: int, limit: int) -> DataFrame:
    """Per anchor and lens the unused candidate of an unused group with the largest gain of at least ``least``; then the best
    others up to ``fill``. Each pick depends on those before: one call an anchor, over its few recalled candidates."""

    def choose(group):
        rows = list(group)
        used, groups, taken = set(), set(), 0
        for n, lens in enumerate(lenses):
            pool = [r for r in rows if r[1] not in used and r[3] not in groups and r[4 + n] is not None and r[4 + n] >= least]
            if pool and taken < limit:
                r = min(pool, key=lambda r: (-r[4 + n], -r[2], r[1]))
                used.add(r[1])
                groups.add(r[3])
                taken += 1
                yield r[0], taken, lens, r[1]
        for r in rows:
            if taken >= fill:
                break
            if r[1] not in used:
                used.add(r[1])
                taken += 1
                yield r[0], taken, "fallback", r[1]

    kind = candidates.schema
    schema = StructType.fromDDL(f"anchor {kind['anchor'].dataType.simpleString()}, position long, lens string, candidate {kind['candidate'].dataType.simpleString()}")
    return walk_groups(candidates.select("anchor", "candidate", "score", "grp", *lenses), "anchor", [F.col("score").desc(), F.col("candidate")], choose, schema)


def contrast(pairs: DataFrame) -> DataFrame:
    """The difference of unit prices in percent, and of evidence."""
    return pairs.withColumn("price_percent", F.floor((F.col("b_price") / F.col("a_price") - 1) * 10000 + 0.5) / 100).withColumn("evidence_delta", F.col("b_evidence") - F.col("a_evidence"))


RELAXED = {"exact": "exact", "wider": "wider budget", "adjacent": "adjacent area", "other": "other area"}


def relaxed_sets(df: DataFrame, area: str | list[str], low: float, high: float, adjacent: list[str], widen: float, labels: dict[str, str] = RELAXED) -> DataFrame:
    """Exact matches, the same places with a wider budget, adjacent areas, other areas: each row in its first set only. ``area`` names one or more places;
    a set without an entry in ``labels`` is not shown, and its rows may fall into a later one. A null area is another area."""
    here = F.coalesce(F.col("area").isin([area] if isinstance(area, str) else list(area)), F.lit(False))
    inside = F.col("price").between(low, high)
    sets = {"exact": here & inside, "wider": here & F.col("price").between(low / widen, high * widen), "adjacent": F.col("area").isin(list(adjacent)) & inside, "other": ~here & inside}
    shown = [F.when(test, labels[name]) for name, test in sets.items() if name in labels]
    return df.withColumn("relaxation", F.coalesce(*shown)).filter("relaxation IS NOT NULL")


def hybrid_recall(channels: dict[str, DataFrame], required: list[str] = ()) -> DataFrame:
    """The tagged union of channels (query_id, id); a required channel is an intersection."""
    tagged = reduce(DataFrame.unionByName, [df.select("query_id", "id", F.lit(name).alias("channel")) for name, df in channels.items()])
    g = tagged.groupBy("query_id", "id").agg(F.collect_set("channel").alias("c"))
    ok = F.lit(True)
    for r in required:
        ok = ok & F.array_contains("c", r)
    return g.filter(ok).select("query_id", "id", F.array_join(F.sort_array("c"), "+").alias("channels"))


def recall_counts(channels: dict[str, DataFrame], required: list[str] = ()) -> DataFrame:
    """(query_id, channel, hits, additions, kept): the ids of each channel (query_id, id), those that no channel named before it gave, and those that the required
    channels leave. Ids count once, whatever their rows; a query without ids in a channel has no row for it."""
    names = list(channels)
    tagged = reduce(DataFrame.unionByName, [df.select("query_id", "id", F.lit(n).alias("n")) for n, df in enumerate(channels.values())])
    met = tagged.groupBy("query_id", "id").agg(F.collect_set("n").alias("found"))  # at most one of each channel
    stays = F.array_size(F.array_except(F.array(*[F.lit(names.index(r)) for r in required]).cast("array<int>"), "found")) == 0
    each = met.select("query_id", F.array_min("found").alias("first"), stays.alias("stays"), F.explode("found").alias("n"))
    counts = each.groupBy("query_id", "n").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("n") == F.col("first")).alias("additions"), F.count_if("stays").alias("kept"))
    return counts.select("query_id", F.element_at(F.array(*map(F.lit, names)), F.col("n") + 1).alias("channel"), "hits", "additions", "kept")


def geography_match(df: DataFrame, scope: DataFrame, near: DataFrame) -> DataFrame:
    """Exact (the asked cell), same locality, or nearby cells with hops and km, else null."""
    j = df.join(scope.select("query_id", F.col("cell").alias("asked"), F.col("locality").alias("asked_locality")), "query_id").join(near.select(F.col("seed").alias("asked"), "cell", "hops", "km"), ["asked", "cell"], "left")
    match = F.when(F.col("cell") == F.col("asked"), "exact").when(F.col("locality") == F.col("asked_locality"), "locality").when(F.col("hops").isNotNull(), "nearby")
    return j.select("query_id", "id", match.alias("match"), F.when(match == "nearby", F.col("hops")).alias("hops"), F.when(match == "nearby", F.col("km")).alias("km"))
