"""Rankings, dedup and best-of picks over fact tables. Every pick has a total order."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.cut import cut
from ..plans.picks import best_row, pick
from ..plans.walk import walk_groups


def _tier(trust: dict[str, int], column: str) -> Column:
    """The rank of a source, unknown ones last."""
    rank = F.lit(len(trust))
    for source, tier in trust.items():
        rank = F.when(F.col(column) == source, F.lit(tier)).otherwise(rank)
    return rank


def compact_facts(facts: DataFrame) -> DataFrame:
    """Per (entity, key, source, url) the most confident row, then the largest (value, skill, fact_no)."""
    return best_row(facts, ["entity_id", "fact_key", "source_type", "source_url"], [F.col("confidence"), F.coalesce("value_text", F.lit("")), F.col("skill_id"), F.col("fact_no")], descending=True)


def resolve_facts(facts: DataFrame, trust: dict[str, int], key_trust: dict[tuple[str, str], int] | None = None, cap: float = 0.9, multi_value: list[str] = (), caps: dict[str, float] | None = None) -> DataFrame:
    """Per (entity, key) the best source for the key, then the best tier, then capped confidence, confidence, largest tuple.

    ``trust`` ranks sources (lower is better, unknown last); ``key_trust`` overrides it for (fact_key, source). A key of ``multi_value`` keeps one fact for each
    (source, url, skill), where a fact without a url stands for its value. ``caps`` bounds the confidence of single sources, in place of ``cap`` for all.
    """
    tier = _tier(trust, "source_type")
    special = F.lit(None).cast("int")
    for (key, source), rank in (key_trust or {}).items():
        special = F.when((F.col("fact_key") == key) & (F.col("source_type") == source), F.lit(rank)).otherwise(special)
    special = F.coalesce(special, F.lit(1 << 20))
    bound = F.lit(cap)
    if caps is not None:
        bound = F.lit(None).cast("double")
        for source, most in caps.items():
            bound = F.when(F.col("source_type") == source, F.lit(most)).otherwise(bound)
    order = [-special, -tier, F.least("confidence", bound), F.col("confidence"), F.coalesce("value_text", F.lit("")), F.col("fact_no")]
    if not multi_value:
        return best_row(facts, ["entity_id", "fact_key"], order, descending=True)
    repeated = F.when(F.col("fact_key").isin(list(multi_value)), F.struct("source_type", F.coalesce("source_url", "value_text").alias("told"), "skill_id"))
    return best_row(facts.withColumn("repeated", repeated), ["entity_id", "fact_key", "repeated"], order, descending=True).drop("repeated")


def current_facts(facts: DataFrame) -> DataFrame:
    """Per (entity, key, source, url, skill) the highest version, confidence, then the largest tuple."""
    return best_row(facts, ["entity_id", "fact_key", "source_type", "source_url", "skill_id"], [F.col("version"), F.col("confidence"), F.coalesce("value_text", F.lit("")), F.col("fact_no")], descending=True)


def dedupe_annotations(annotations: DataFrame, by: list[str], fields: list[str], ordinal: str) -> DataFrame:
    """Per key the row with most of ``fields`` filled; the first by ``ordinal`` wins ties."""
    filled = sum((F.when(F.col(f).isNotNull() & (F.col(f) != ""), 1).otherwise(0) for f in fields), F.lit(0))
    return best_row(annotations, by, [-filled, F.col(ordinal)])


def best_fact(facts: DataFrame, trust: dict[str, int], hidden_prefixes: tuple[str, ...] = (), hidden_below: int = 0) -> DataFrame:
    """Per (entity, key) the best visible fact by trust, then the smallest stable key (source, url, value, fact_no).

    Keys that begin with a hidden prefix are visible only from sources ranked above ``hidden_below``.
    """
    tier = _tier(trust, "source_type")
    shown = F.lit(True)
    for p in hidden_prefixes:
        shown = shown & (~F.col("fact_key").startswith(p) | (tier < hidden_below))
    return best_row(facts.filter(shown), ["entity_id", "fact_key"], [tier, F.col("source_type"), F.col("source_url"), F.coalesce("value_text", F.lit("")), F.col("fact_no")])


def latest_valid(facts: DataFrame, key: str, valid: Column) -> DataFrame:
    """Per entity the most confident fact of ``key`` that passes ``valid``, then the latest, then the largest number."""
    return best_row(facts.filter((F.col("fact_key") == key) & F.coalesce(valid, F.lit(False))), ["entity_id"], [F.col("confidence"), F.col("learned_on"), F.col("fact_no")], descending=True)


def resolve_coordinates(coordinates: DataFrame, sources: list[str]) -> DataFrame:
    """Latitude and longitude of the same observation, from allowed sources in order, then by the lesser confidence.

    ``coordinates``: entity_id, observation_id, axis ('lat' or 'lon'), value, source_type, confidence.
    """
    axis = lambda name: F.max(F.when(F.col("axis") == name, F.col("value")))
    pairs = coordinates.filter(F.col("source_type").isin(sources)).groupBy("entity_id", "observation_id", "source_type").agg(axis("lat").alias("lat"), axis("lon").alias("lon"), F.min("confidence").alias("confidence")).dropna(subset=["lat", "lon"])
    return best_row(pairs, ["entity_id"], [F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source_type")), -F.col("confidence"), F.col("observation_id")])


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def pick_option(options: DataFrame, by: str, trust: dict[str, int]) -> DataFrame:
    """The representative option per property: source trust, then the smallest observation, then the smallest listing."""
    tier = _tier(trust, "kind")
    return best_row(options, [by], [tier, F.col("seen_on"), F.col("listing_id")])


def numeric_fact(facts: DataFrame, keys: list[str], mode: str = "first") -> DataFrame:
    """Per entity the first, least or greatest numeric fact of ``keys``: key order, confidence, then fact_no break ties."""
    at = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("fact_key"))
    value = {"first": F.lit(0.0), "min": F.col("value_number"), "max": -F.col("value_number")}[mode]
    return best_row(facts.filter(F.col("fact_key").isin(keys) & F.col("value_number").isNotNull() & ~F.isnan("value_number")), ["entity_id"], [value, at, -F.col("confidence"), F.col("fact_no")])


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The best row per (subject, preference): source rank, key rank, then highest score and confidence, then key and display."""
    return best_row(evidence, ["subject", "preference"], [F.col("source_rank"), F.col("key_rank"), -F.col("score"), -F.col("confidence"), F.col("fact_key"), F.col("display")])


def curate_gallery(images: DataFrame, by: str, kind_order: list[str], frames: int) -> DataFrame:
    """Hero by kind order, then the best of each kind, then the rest by quality; at most ``frames``, exactly one hero."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kind_order]), F.col("kind")), F.lit(0)), F.lit(len(kind_order) + 1))
    w = lambda *p: Window.partitionBy(*p).orderBy(F.col("quality").desc(), F.col("image_id"))
    ranked = images.withColumn("kind_rank", at).withColumn("in_kind", F.row_number().over(w(by, "kind")))
    overall = Window.partitionBy(by).orderBy(F.when(F.col("in_kind") == 1, 0).otherwise(1), F.when(F.col("in_kind") == 1, F.col("kind_rank")), F.col("quality").desc(), F.col("image_id"))
    return ranked.withColumn("position", F.row_number().over(overall)).filter(F.col("position") <= frames).withColumn("is_hero", F.col("position") == 1).drop("kind_rank", "in_kind")


def rank_reviews(reviews: DataFrame, by: str, n: int) -> DataFrame:
    """By helpfulness, recency, order; if the first ``n`` praise but hold no concern, the last slot goes to the best concern."""
    order = [F.col("helpful").desc(), F.col("learned_on").desc(), F.col("ordinal")]
    ranked = reviews.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("concern_rank", F.row_number().over(Window.partitionBy(by, "tone").orderBy(*order)))
    head = F.col("rank") <= n
    w = Window.partitionBy(by)
    swap = F.max((head & (F.col("tone") == "positive")).cast("int")).over(w).cast("boolean") & ~F.max((head & (F.col("tone") == "concern")).cast("int")).over(w).cast("boolean") & F.max((F.col("tone") == "concern").cast("int")).over(w).cast("boolean")
    rising = (F.col("tone") == "concern") & (F.col("concern_rank") == 1)
    ranked = ranked.withColumn("swap", swap).withColumn("slot", F.when(F.col("swap") & rising, F.lit(n)).otherwise(F.col("rank")))
    return ranked.filter((F.col("slot") <= n) & ~(F.col("swap") & (F.col("rank") == n) & ~rising)).drop("rank", "concern_rank", "swap")


def diversify(ranked: DataFrame, query: str, group: str, n: int, run: int) -> DataFrame:
    """The first ``n`` rows of each query with at most ``run`` of one group in a row, their order otherwise kept.

    Each pick depends on those before it, so a query's candidates are walked in one function call: the first ``n`` rows of each of
    its groups, as no pick goes beyond them, and only the ``n + 1`` groups that come first, as at most one of them is blocked at a time.
    """

    at = ranked.columns.index(group)

    def walk(rows):
        waiting, out = list(rows), []
        while waiting and len(out) < n:
            tail = out[-run:]
            k = next((k for k, r in enumerate(waiting) if not (len(tail) == run and all(g == r[at] for g in tail))), 0)
            row = waiting.pop(k)
            out.append(row[at])
            yield *row, len(out)

    by_group = Window.partitionBy(query, group)
    head = ranked.withColumn("__nth", F.row_number().over(by_group.orderBy("rank"))).filter(F.col("__nth") <= n).withColumn("__first", F.min("rank").over(by_group))
    head = head.withColumn("__group", F.dense_rank().over(Window.partitionBy(query).orderBy("__first"))).filter(F.col("__group") <= n + 1).select(*ranked.columns)
    return walk_groups(head, query, [F.col("rank")], walk, StructType(head.schema.fields + [StructField("position", LongType())]))


def diversify_all(ranked: DataFrame, query: str, group: str, n: int, run: int) -> DataFrame:
    """W14 with the rows after the first ``n``: those that were not picked follow in their order, so that no row is lost. Ranks are unique within a query; ``position`` counts from 1."""
    head = cut(diversify(ranked, query, group, n, run), "diversify")
    taken = head.select(F.col(query).alias("taken_query"), F.col("rank").alias("taken_rank"))
    rest = ranked.join(taken, F.col(query).eqNullSafe(F.col("taken_query")) & (F.col("rank") == F.col("taken_rank")), "left_anti")
    after = F.row_number().over(Window.partitionBy(query).orderBy("rank")) + n  # where rows are left, n were picked
    return head.unionByName(rest.withColumn("position", after.cast("long")))


def round_robin(ranked: DataFrame, n: int) -> DataFrame:
    """Rows (set_no, rank, id) in turns of the sets, each id once at its first turn, the first ``n``."""
    first = best_row(ranked, ["id"], [F.col("rank"), F.col("set_no")])
    return first.orderBy("rank", "set_no", "id").limit(n)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, excluded: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The best of each group without the excluded ids, then the ``n`` best groups."""
    rows = df.join(excluded.select(key), key, "left_anti") if excluded is not None else df
    return pick(rows, [group], order).orderBy(*order).limit(n)


def stable_first(facts: DataFrame, by: list[str], *hashed: str) -> DataFrame:
    """Per group the row whose SHA-256 of the ``hashed`` columns is least."""
    digest = F.sha2(F.concat_ws("|", *hashed), 256)
    return best_row(facts, by, [digest, F.col("fact_no")])


def dedupe_images(images: DataFrame) -> DataFrame:
    """One image per content hash, or per URL without its query string where the hash is missing; the smallest id stays."""
    return best_row(images.withColumn("identity", F.coalesce("content_sha256", F.regexp_replace("url", r"\?.*$", ""))), ["identity"], [F.col("image_id")])


def select_previews(docs: DataFrame, by: str, roles: list[str], per_role: int, total: int) -> DataFrame:
    """Per subject documents by role order, at most ``per_role`` of a role, one of each content hash, ``total`` in all;
    every row comes back with the reason it was left out (null: chosen). Joint caps are greedy: one call a subject."""

    role, content = docs.columns.index("role"), docs.columns.index("content_hash")

    def choose(rows):
        seen, used, chosen = set(), {}, 0
        for r in rows:
            why = "role" if r[role] not in roles else "content" if r[content] in seen else "role cap" if used.get(r[role], 0) >= per_role else "total cap" if chosen >= total else None
            if why is None:
                seen.add(r[content])
                used[r[role]] = used.get(r[role], 0) + 1
                chosen += 1
            yield *r, why

    turn = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role")), F.lit(0)), F.lit(len(roles) + 1))
    return walk_groups(docs, by, [turn, F.col("document_id")], choose, StructType(docs.schema.fields + [StructField("left_out", StringType())]))


def current_effects(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Each event with the effect of its last relation by (time, id); without one its effect is 'active'."""
    last = best_row(relations, ["event_id"], [F.col("at"), F.col("relation_id")], descending=True).select("event_id", "effect")
    return events.join(last, "event_id", "left").withColumn("effect", F.coalesce("effect", F.lit("active")))


def nearest_per_feature(df: DataFrame, entity: str, feature: str, distance: str, tie: str) -> DataFrame:
    """The nearest record of each (entity, feature)."""
    return best_row(df, [entity, feature], [F.col(distance), F.col(tie)])
