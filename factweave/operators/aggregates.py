"""Aggregations over facts, entities, edges and checks. Quantiles follow exact rank conventions, never approximations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import BROADCAST_LIMIT, cut, sized_join, split_join
from ..plans.picks import best_row, in_order


def owner_aggregate(projects: DataFrame) -> DataFrame:
    """A1: per (owner, status) counts and areas, then per owner with its statuses in order."""
    by_status = projects.groupBy("owner", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    return by_status.groupBy("owner").agg(F.sum("n").alias("projects"), F.sum("area").alias("area"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "status", "n"))), " ").alias("statuses"))


def portfolio(rows: DataFrame) -> DataFrame:
    """A2: per builder distinct projects, registered, delayed, with complaints, and the most revocations."""
    return rows.groupBy("builder").agg(F.count_distinct("project").alias("projects"), F.count_distinct(F.when(F.col("registered"), F.col("project"))).alias("registered"), F.count_distinct(F.when(F.col("delayed"), F.col("project"))).alias("delayed"), F.count_distinct(F.when(F.col("complaints") > 0, F.col("project"))).alias("with_complaints"), F.max("revocations").alias("revocations"))


def fact_coverage(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """A3: per entity type and key the entities that have the key, of all of the type."""
    total = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("total"))
    have = facts.select("entity_id", "fact_key").distinct().join(entities.select("entity_id", "entity_type"), "entity_id").groupBy("entity_type", "fact_key").agg(F.count(F.lit(1)).alias("covered"))
    return have.join(total, "entity_type").withColumn("share", F.round(F.col("covered") / F.col("total"), 6))


def graph_stats(entities: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """A4: counts of nodes, edges and facts by type."""
    count = lambda df, kind, col: df.groupBy(F.col(col).alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(entities, "node", "entity_type").unionByName(count(edges, "edge", "edge_type")).unionByName(count(facts, "fact", "fact_key"))


def embedding_stats(df: DataFrame, kind: str, vector: str) -> DataFrame:
    """A5: rows, rows with a vector, and distinct lengths, by type."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(vector).isNotNull()).alias("embedded"), F.count_distinct(F.size(vector)).alias("lengths"))


def fact_profile(facts: DataFrame, confident: float = 0.6, examples: int = 5) -> DataFrame:
    """Per key rows, confident rows, confidence range and mean, sources, types, entities, and the first example ids.

    Entities are reduced to distinct (key, entity) first, so no task holds a key's entities; only the examples are gathered.
    """
    told = facts.groupBy("fact_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= confident).alias("confident"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("confidence"), 6).alias("mean"),
        F.count_distinct("source_type").alias("sources"), F.count_distinct("value_type").alias("types"),
    )
    owned = facts.filter("entity_id is not null").select(F.col("fact_key").alias("key"), "entity_id").distinct()
    counts = owned.groupBy("key").agg(F.count(F.lit(1)).alias("entities"))
    first = owned.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("entity_id"))).filter(F.col("rank") <= examples)
    first = first.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("entity_id")), " ").alias("examples"))
    for side in (counts, first):
        told = told.join(side, told["fact_key"].eqNullSafe(side["key"]), "left").drop("key")
    return told.withColumn("entities", F.coalesce("entities", F.lit(0))).withColumn("examples", F.coalesce("examples", F.lit("")))


def at_rank(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Count, and the values at exact 1-based ranks given as expressions of ``n``; no sampling.

    Equal values are counted first and dealt by ranges of (group, value). A range goes on from the counts of the ranges before it,
    so that no task sorts a whole group. Null values are left out; null groups are a group.
    """
    keys = [f"key{i}" for i in range(len(by))]
    counted = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("value")).filter("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    dealt = cut(counted.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()), "ranks-dealt")
    group = Window.partitionBy(*[f"of_{k}" for k in keys])
    held = dealt.groupBy(*[F.col(k).alias(f"of_{k}") for k in [*keys, "part"]]).agg(F.sum("c").alias("held"))
    before = F.coalesce(F.sum("held").over(group.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cut(held.select("*", before.alias("before"), F.sum("held").over(group).alias("n")), "ranks-held")
    inside = F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("value"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.col("part") == F.col("of_part"))
    placed = sized_join(dealt.withColumn("inside", inside), held, same, "inner", held.count() * 64).withColumn("upto", F.col("before") + F.col("inside"))
    found = [F.max(F.when((r <= F.col("upto")) & (r > F.col("upto") - F.col("c")), F.col("value"))).alias(name) for name, r in ranks.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *found).withColumnsRenamed(dict(zip(keys, by)))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, median, p95 and greatest at nearest rank round((n - 1) q)."""
    rank = lambda q: F.floor((F.col("n") - 1) * F.lit(q) + 0.5) + 1
    return at_rank(df, by, value, {"least": rank(0.0), "median": rank(0.5), "p95": rank(0.95), "greatest": rank(1.0)})


def degree_stats(edges: DataFrame) -> DataFrame:
    """The distribution of degrees, both ends counted, by edge type."""
    ends = edges.select("edge_type", F.explode(F.array("src", "dst")).alias("node"))
    return distribution(ends.groupBy("edge_type", "node").agg(F.count(F.lit(1)).alias("degree")), ["edge_type"], "degree")


def cell_sizes(zones: DataFrame) -> DataFrame:
    """The distribution of bounding-box areas in square degrees."""
    return distribution(zones.select(F.lit("all").alias("scope"), F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 6).alias("area")), ["scope"], "area")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Element n / 2 of the sorted values."""
    return at_rank(df, by, value, {"median": F.floor(F.col("n") / 2) + 1})


def quality_report(df: DataFrame, key: str, kind: str, known: list[str]) -> DataFrame:
    """A10: per kind rows, rows of repeated ids, and whether the kind is known."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return df.join(repeated, key).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copies") > 1).alias("repeated")).withColumn("known", F.col(kind).isin(known))


def reason_counts(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Rows per reason of an array column."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Ends of a middle in one list, and paths of one task.
LISTED, PATHS = 256, 1 << 20


def compose_coverage(membership: DataFrame, occupancy: DataFrame) -> DataFrame:
    """(a, b) then (b, c) gives (a, c); confidence is the least over all paths, and the middles are counted.

    A path is not a row of a shuffle: lists of at most ``LISTED`` ends go with each (a, b) to the task of ``a``, where they are opened and counted. Ends travel as
    numbers where a table of their names is small enough to broadcast, and a list of one confidence has it once. Tasks follow the number of paths, so that the pairs of
    each fit its memory.
    """
    first = membership.dropna(subset=["b"]).groupBy("a", "b").agg(F.min("confidence").alias("m"))
    ends = cut(occupancy.dropna(subset=["b"]).groupBy("b", "c").agg(F.min("confidence").alias("o")), "compose-ends")
    names = cut(ends.select(F.col("c").alias("name")).distinct(), "compose-names")
    numbered = names.agg(F.coalesce(F.sum(F.coalesce(F.length(F.col("name").cast("string")), F.lit(0)) + 48), F.lit(0))).first()[0] <= BROADCAST_LIMIT
    if numbered:
        names = cut(in_order(names, [F.col("name")], "number").withColumn("number", F.col("number").cast("int")), "compose-numbers")
        ends = ends.join(F.broadcast(names), F.col("c").eqNullSafe(F.col("name"))).select("b", F.col("number").alias("c"), "o")
    ends = ends.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("b").orderBy("c")) - 1) / LISTED))
    lists = ends.groupBy("b", "part").agg(F.collect_list(F.struct("c", "o")).alias("l")).select("b", F.transform("l", lambda e: e["c"]).alias("cs"), F.transform("l", lambda e: e["o"]).alias("os"))
    lists = cut(lists.withColumn("os", F.when(F.size(F.array_distinct("os")) == 1, F.slice("os", 1, 1)).otherwise(F.col("os"))), "compose-lists")
    first = cut(first, "compose-first")
    paths = first.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(lists.groupBy("b").agg(F.sum(F.size("cs")).alias("k")).hint("merge"), "b").agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0))).first()[0]
    met = split_join(first, lists, ["b"]).select("a", "cs", F.transform("os", lambda o: F.least("m", o)).alias("os")).repartition(int(min(20000, max(8, paths // PATHS + 1))), "a")
    each = met.select("a", "os", F.posexplode("cs").alias("at", "c")).select("a", "c", F.get("os", F.when(F.size("os") > 1, F.col("at")).otherwise(0)).alias("confidence"))
    pairs = each.groupBy("a", "c").agg(F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("inputs"))
    return pairs.join(F.broadcast(names), F.col("c") == F.col("number")).select("a", F.col("name").alias("c"), "confidence", "inputs") if numbered else pairs


def fact_counts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts per entity, zero where there are none."""
    return entities.join(facts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).cast("long").alias("facts"))


def token_df(docs: DataFrame, doc: str, tokens: str, most_docs: int = 3, most_share: float = 0.15) -> DataFrame:
    """Documents per token; distinctive: in one document, or in few and in a small share."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    df = docs.select(doc, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(total)).withColumn("distinctive", (F.col("df") == 1) | ((F.col("df") <= most_docs) & (F.col("df") <= F.col("total") * most_share))).drop("total")


def ngram_counts(docs: DataFrame, tokens: str, most: int = 3) -> DataFrame:
    """Counts of 1- to ``most``-grams."""
    t = F.col(tokens)

    def of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, each).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))
    return docs.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def theme_scores(counts: DataFrame, themes: DataFrame) -> DataFrame:
    """The summed counts of each theme's terms."""
    return counts.join(themes, counts["gram"] == themes["term"]).groupBy("theme").agg(F.sum("n").alias("score"), F.count(F.lit(1)).alias("terms"))


def unmapped_terms(counts: DataFrame, themes: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """The most frequent terms that no theme has."""
    return counts.join(themes, counts["gram"] == themes["term"], "left_anti").filter(F.col("n") >= least).orderBy(F.col("n").desc(), "gram").limit(most)


def confidence_score(facts: DataFrame, official: str) -> DataFrame:
    """0.5 * (has the official source) + 0.25 * min(n / 25, 1) + 0.25 * best match; label by 0.7 and 0.4."""
    scored = facts.groupBy("entity_id").agg(F.max(F.when(F.col("source_type") == official, 1.0).otherwise(0.0)).alias("s"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("m"))
    scored = scored.withColumn("score", F.round(0.5 * F.col("s") + 0.25 * F.least(F.col("n") / 25, F.lit(1.0)) + 0.25 * F.col("m"), 6))
    return scored.select("entity_id", "score", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low").alias("label"))


def rank_metrics(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per mode recall at 1, 3 and 5 and the mean reciprocal rank of the first wanted result."""
    first = wanted.join(results, ["mode", "query_id", "id"], "left").groupBy("mode", "query_id").agg(F.min("rank").alias("rank"))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return first.groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def check_summary(checks: DataFrame) -> DataFrame:
    """Passed and failed by layer, by category, by mode and in all, in one pass over grouping sets."""
    checks.createOrReplaceTempView("factweave_checks")
    return checks.sparkSession.sql("SELECT layer, category, mode, count_if(passed) AS passed, count_if(NOT passed) AS failed FROM factweave_checks GROUP BY GROUPING SETS ((layer), (category), (mode), ())")


def failure_bucket(checks: DataFrame, layers: list[str]) -> DataFrame:
    """The first failing layer of each case, by priority."""
    at = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    return checks.filter(~F.col("passed") & (at > 0)).groupBy("case_id").agg(F.min_by("layer", at).alias("bucket"))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percentiles at index ceil((n - 1) p)."""
    rank = lambda p: F.ceil((F.col("n") - 1) * F.lit(p)) + 1
    return at_rank(df, by, value, {"p50": rank(0.5), "p95": rank(0.95), "p99": rank(0.99)})


def searchable_text(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Keys and values of all facts of an entity in order; blank for internal entities."""
    joined = facts.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "fact_key", "value_text"))), " ").alias("text"))
    return entities.join(joined, "entity_id", "left").select("entity_id", F.when(F.col("visibility") == "internal", "").otherwise(F.coalesce("text", F.lit(""))).alias("searchable_text"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One SHA-256 over all rows, whatever their order. Rows that repeat count each time; an empty table has one, too.

    Each row's digest is read as eight numbers of 32 bits. Their sums and the row count, which partial aggregation takes at any size
    and skew, are digested.
    """
    rows = df.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("d"))
    words = [F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"s{k}") for k, w in enumerate(words)])
    return sums.select(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("fingerprint"))


def summarize_entities(docs: DataFrame, by: str) -> DataFrame:
    """Per entity evidence count, languages, mean of a rating, positives, concerns and the longest text's length."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("evidence"), F.array_join(F.sort_array(F.collect_set("lang")), " ").alias("langs"), F.round(F.avg("rating"), 6).alias("rating"), F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == 0).alias("concern"), F.max("n_chars").alias("longest"))


def quarterly_series(claims: DataFrame, predicates: list[str]) -> DataFrame:
    """One point per filing quarter with its predicates side by side, in an ordered list per registration."""
    points = claims.groupBy("registration", "quarter").pivot("predicate", predicates).agg(F.sum("value"))
    text = F.concat_ws("/", F.col("quarter"), *[F.when(F.col(p).isNotNull(), F.format_string("%.2f", F.col(p))).otherwise("-") for p in predicates])
    return points.groupBy("registration").agg(F.count(F.lit(1)).alias("points"), F.array_join(F.sort_array(F.collect_list(text)), " ").alias("series"))


def assemble_events(claims: DataFrame, mandatory: list[str]) -> DataFrame:
    """The claims of one event as one row; events without every mandatory field are dropped."""
    return claims.groupBy("event_id").pivot("predicate", mandatory).agg(F.max("value")).dropna(subset=mandatory)


def reconcile(claims: DataFrame, left: str, right: str) -> DataFrame:
    """All differences between two predicates of a registration with the same unit; matching when the only one is 0."""
    side = lambda p, c: claims.filter(F.col("predicate") == p).select("registration", "unit", F.col("value").alias(c))
    diffs = side(left, "l").join(side(right, "r"), ["registration", "unit"]).groupBy("registration", "unit").agg(F.sort_array(F.collect_set(F.round(F.col("l") - F.col("r"), 2))).alias("d"))
    return diffs.select("registration", "unit", F.size("d").cast("long").alias("differences"), ((F.size("d") == 1) & (F.element_at("d", 1) == 0)).alias("matching"))


def evidence_snapshot(df: DataFrame, by: list[str]) -> DataFrame:
    """Facts, gaps and mean confidence of a section."""
    return df.groupBy(*by).agg(F.count("value_text").alias("facts"), F.count_if(F.col("value_number").isNull()).alias("gaps"), F.round(F.avg("confidence"), 6).alias("confidence"))


def price_band(df: DataFrame, by: list[str]) -> DataFrame:
    """Least and greatest price of a collection, with the price where a bound is missing."""
    return df.groupBy(*by).agg(F.min(F.coalesce("price_min", "price")).alias("low"), F.max(F.coalesce("price_max", "price")).alias("high"))


def latest_by_source(df: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """The latest row of each source."""
    return best_row(df, [by], [F.col(at), F.col(tie)], descending=True)


def label_summary(labels: DataFrame, by: str) -> DataFrame:
    """Attention count, the gravest tone, and primary labels in order."""
    return labels.groupBy(by).agg(F.count_if(F.col("severity") >= 2).alias("attention"), F.max("severity").alias("severity"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("primary"), F.col("label")))), " ").alias("primary_labels"))


def group_by_lens(hits: DataFrame) -> DataFrame:
    """Themes of each lens, in order."""
    return hits.groupBy("lens").agg(F.array_join(F.sort_array(F.collect_set("theme")), " ").alias("themes"), F.count(F.lit(1)).alias("hits"))


def card_signals(facts: DataFrame, counted: list[str], best: list[str]) -> DataFrame:
    """Per entity and configured key a count, or the best number; kept if above zero."""
    n = facts.filter(F.col("fact_key").isin(counted)).groupBy("entity_id", "fact_key").agg(F.count(F.lit(1)).cast("double").alias("signal"))
    v = facts.filter(F.col("fact_key").isin(best)).groupBy("entity_id", "fact_key").agg(F.max("value_number").alias("signal"))
    return n.unionByName(v).filter("signal > 0")


def evidence_sections(facts: DataFrame, config: DataFrame) -> DataFrame:
    """Configured (section, fact_key, required) with the distinct items of each entity; declared but missing keys are listed."""
    have = facts.select("entity_id", "fact_key", "value_text").distinct().groupBy("entity_id", "fact_key").agg(F.count(F.lit(1)).alias("items"))
    slots = facts.select("entity_id").distinct().join(F.broadcast(config))
    full = slots.join(have, ["entity_id", "fact_key"], "left")
    return full.groupBy("entity_id", "section").agg(F.sum(F.coalesce("items", F.lit(0))).cast("long").alias("items"), F.count_if(F.col("items").isNull()).alias("missing")).filter("items > 0")


def registry_sections(facts: DataFrame) -> DataFrame:
    """Per (entity, key, shown value) the most confident row (ties: the smallest number), counted by section."""
    best = best_row(facts, ["entity_id", "fact_key", "value_text"], [-F.col("confidence"), F.col("fact_no")])
    return best.groupBy("entity_id", F.col("fact_key").alias("section")).agg(F.count(F.lit(1)).alias("shown"), F.max("confidence").alias("confidence"), F.min("fact_no").alias("first"))


def media_report(images: DataFrame, by: str, hero_kind: str) -> DataFrame:
    """Candidates, approved, rejected, by kind, and whether the hero is missing."""
    return images.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("reject_reason").isNull()).alias("approved"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.count_distinct("kind").alias("kinds"), (F.count_if((F.col("kind") == hero_kind) & F.col("reject_reason").isNull()) == 0).alias("missing_hero"))


def thin_entities(df: DataFrame, entities: DataFrame, by: str, n: int) -> DataFrame:
    """Entities with fewer than ``n`` records, those with none included."""
    return entities.select(by).join(df.groupBy(by).agg(F.count(F.lit(1)).alias("records")), by, "left").select(by, F.coalesce("records", F.lit(0)).cast("long").alias("records")).filter(F.col("records") < n)


def rollup_themes(counts: DataFrame, mapping: DataFrame, n: int) -> DataFrame:
    """Fine themes summed to coarse ones per entity, the ``n`` greatest by (sum, name)."""
    coarse = counts.filter("n > 0").join(F.broadcast(mapping), "theme").groupBy("entity_id", "coarse").agg(F.sum("n").alias("n"))
    return coarse.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("n").desc(), "coarse"))).filter(F.col("rank") <= n)
