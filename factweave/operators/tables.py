"""Set operations, table maintenance, and sorts with explicit ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.picks import best_row, in_order


def merge_snapshots(*dfs: DataFrame) -> DataFrame:
    """The distinct union."""
    return reduce(DataFrame.unionByName, dfs).distinct()


def contradictions(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Keys whose rows differ in content."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*content)).alias("versions")).filter("versions > 1")


def replace_by_producer(base: dict[str, DataFrame], new: dict[str, DataFrame], producers: list[str], supported: str = "place") -> dict[str, DataFrame]:
    """What the producers (``skill_id``) contributed goes, and what only rested on it; then their new contributions come.

    Both sides have facts (entity_id, fact_key, skill_id), metadata (entity_id, fact_key), entities (entity_id, entity_type) and edges (src, dst), with any other columns. Of
    the base go the producers' facts, the metadata of keys that lost their last fact, entities of the type ``supported`` that lost their last fact, and the edges at these.
    Of the new side come the producers' facts only, the metadata and entities that have such a fact, and edges at one of these whose ends both exist
    in the end. Rows that both sides have are there once. A fact without a producer stays.
    """
    theirs = F.coalesce(F.col("skill_id").isin(producers), F.lit(False))
    key = ["entity_id", "fact_key"]
    support = base["facts"].groupBy(*key).agg(F.count_if(theirs).alias("gone"), F.count_if(~theirs).alias("left"))
    lost_keys = support.filter("gone > 0 AND left = 0").select(*key)
    lost = support.groupBy("entity_id").agg(F.sum("gone").alias("gone"), F.sum("left").alias("left")).filter("gone > 0 AND left = 0").select("entity_id")
    lost = base["entities"].filter(F.col("entity_type") == supported).join(lost, "entity_id", "left_semi").select("entity_id").distinct()
    at = lambda df, ids, end, how: df.join(ids.select(F.col("entity_id").alias(end)), end, how).select(*df.columns)

    facts = new["facts"].filter(theirs)
    ids = facts.select("entity_id").distinct()
    entities = base["entities"].join(lost, "entity_id", "left_anti"), new["entities"].join(ids, "entity_id", "left_semi")
    alive = entities[0].select("entity_id").unionByName(entities[1].select("entity_id")).distinct()
    edges = at(at(new["edges"], alive, "src", "left_semi"), alive, "dst", "left_semi")
    edges = at(edges, ids, "src", "left_semi").unionByName(at(edges, ids, "dst", "left_semi"))
    return {
        "facts": merge_snapshots(base["facts"].filter(~theirs), facts),
        "metadata": merge_snapshots(base["metadata"].join(lost_keys, key, "left_anti").select(*base["metadata"].columns), new["metadata"].join(facts.select(*key).distinct(), key, "left_semi").select(*base["metadata"].columns)),
        "entities": merge_snapshots(*[e.select(*base["entities"].columns) for e in entities]),
        "edges": merge_snapshots(at(at(base["edges"], lost, "src", "left_anti"), lost, "dst", "left_anti"), edges),
    }


def upsert(base: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """The new name where there is one, the least created and greatest updated time."""
    j = base.alias("b").join(canonical.alias("c"), F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
    return j.select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), F.coalesce("c.name", "b.name").alias("name"), F.least("b.created", "c.created").alias("created"), F.greatest("b.updated", "c.updated").alias("updated"))


def merge_candidates(required: list[DataFrame], optional: list[DataFrame], excluded: DataFrame | None, key: str = "id") -> DataFrame:
    """U4: the intersection of the required sets, united with nothing else if there are any; else the union of the optional; minus the excluded."""
    ids = reduce(lambda a, b: a.intersect(b), [d.select(key) for d in required]) if required else reduce(lambda a, b: a.unionByName(b), [d.select(key) for d in optional]).distinct()
    return ids.exceptAll(excluded.select(key).distinct()) if excluded is not None else ids


def merge_edges(base: DataFrame, derived: DataFrame) -> DataFrame:
    """An evidenced edge replaces an unevidenced duplicate."""
    both = base.withColumn("evidenced", F.lit(False)).unionByName(derived.withColumn("evidenced", F.lit(True)))
    return best_row(both, ["src", "edge_type", "dst"], [~F.col("evidenced"), -F.col("confidence")])


def carry_forward(previous: DataFrame, new: DataFrame, entity: str, source: str) -> DataFrame:
    """Previous rows stay unless the same upstream source of the entity was refreshed."""
    return previous.join(new.select(entity, source).distinct(), [entity, source], "left_anti").unionByName(new)


def admit_listings(df: DataFrame) -> DataFrame:
    """U8: finite positive price, area and bedrooms; price to the unit, area to a tenth."""
    ok = reduce(lambda a, b: a & b, [(F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")) for c in ("price", "area_sqft", "bhk")])
    return df.filter(ok).withColumn("price", F.floor(F.col("price") + 0.5)).withColumn("area_sqft", F.floor(F.col("area_sqft") * 10 + 0.5) / 10)


def needs_compaction(files: DataFrame, most_files: int = 24, most_rows: int = 5000, most_bytes: int = 64 << 20, hours: float = 24.0) -> DataFrame:
    """Per partition whether files, rows, bytes or age (hours) pass a limit; files have partition, rows, bytes, age_hours."""
    g = files.groupBy("partition").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("age_hours").alias("age_hours"))
    return g.withColumn("compact", (F.col("files") > most_files) | (F.col("rows") > most_rows) | (F.col("bytes") > most_bytes) | (F.col("age_hours") > hours))


def tier_rank(df: DataFrame, query: str, tiers: list[str], ties: list[Column]) -> DataFrame:
    """O1: rank by tiers in order, the greater first and missing ones last, then by ties."""
    w = Window.partitionBy(query).orderBy(*[F.col(t).desc_nulls_last() for t in tiers], *ties)
    return df.withColumn("rank", F.row_number().over(w))


def relative_topk(df: DataFrame, query: str, distance: str, tie: str, least_km: float = 5.0, times: float = 2.0, k: int = 128) -> DataFrame:
    """O2: within max(least_km, times * nearest), then the first ``k``."""
    near = df.groupBy(query).agg(F.min(distance).alias("__nearest"))
    kept = df.join(near, query).filter(F.col(distance) <= F.greatest(F.lit(least_km), F.col("__nearest") * times)).drop("__nearest")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(distance, tie))).filter(F.col("rank") <= k)


def cohort_sort(df: DataFrame, query: str, cohort: Column, previous: str) -> DataFrame:
    """O3: by cohort, and inside by the previous rank."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(cohort, previous)))


def config_order(spec: list[tuple[str, str]]) -> list[Column]:
    """Sort keys from (column, 'asc' or 'desc'), nulls last both ways."""
    return [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in spec]


def rank_shelves(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """A shelf per group value with its ``n`` best; shelves by distinct size, then name."""
    sizes = df.groupBy(group).agg(F.count_distinct("id").alias("size"))
    sizes = in_order(sizes, [F.col("size").desc(), F.col(group)], "shelf")
    top = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)
    return top.join(sizes, group)
