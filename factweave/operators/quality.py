"""Data quality, lineage and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_id


def validate_observations(facts: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """Q1: whether the recomputed content id equals the stated ``observation_id`` and the subject is the fact's entity."""
    same = content_id(prefix, *[F.col(c) for c in columns]) == F.col("observation_id")
    return facts.withColumn("valid", F.coalesce(same & (F.col("subject") == F.col("entity_id")), F.lit(False)))


def validate_derivations(edges: DataFrame) -> DataFrame:
    """Q2: inputs sorted and distinct, a finite value, a confidence from 0 to 1."""
    ok = (F.to_json("inputs") == F.to_json(F.sort_array(F.array_distinct("inputs")))) & (F.size("inputs") > 0) & ~F.isnan("value") & (F.abs("value") < float("inf")) & F.col("confidence").between(0, 1)
    return edges.withColumn("valid", F.coalesce(ok, F.lit(False)))


def quarantine(entities: DataFrame, facts: DataFrame, edges: DataFrame, required: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """Q3: (reasons, surviving edges). An entity needs every required key, and confident evidence; edges to the excluded go with them."""
    g = facts.groupBy("entity_id").agg(*[F.max((F.col("fact_key") == k).cast("int")).alias(k) for k in required], F.max("confidence").alias("best"))
    j = entities.join(g, "entity_id", "left")
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit(0)) == 0, F.lit(f"no {k}")) for k in required], F.when(F.coalesce("best", F.lit(0.0)) < least, "weak evidence")))
    out = j.select("entity_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)
    gone = out.select("entity_id")
    left = edges.join(gone, edges["src"] == gone["entity_id"], "left_anti")
    return out, left.join(gone, left["dst"] == gone["entity_id"], "left_anti")


def check_rules(entities: DataFrame, edges: DataFrame, parent: str, child_types: list[str]) -> DataFrame:
    """Q4: (rule, id) of what breaks: repeated ids, children without exactly one parent."""
    repeated = entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated id").alias("rule"), F.col("entity_id").alias("id"))
    parents = edges.filter(F.col("edge_type") == parent).groupBy("src").agg(F.count_distinct("dst").alias("n"))
    children = entities.filter(F.col("entity_type").isin(child_types)).join(parents, entities["entity_id"] == parents["src"], "left")
    wrong = children.filter(F.coalesce("n", F.lit(0)) != 1).select(F.lit("one parent").alias("rule"), F.col("entity_id").alias("id"))
    return repeated.unionByName(wrong)


def keys_differ(facts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q4: fact keys without metadata, and the reverse."""
    a, b = facts.select("fact_key").distinct(), metadata.select("fact_key").distinct()
    return a.join(b, "fact_key", "left_anti").select("fact_key", F.lit("no metadata").alias("side")).unionByName(b.join(a, "fact_key", "left_anti").select("fact_key", F.lit("no facts").alias("side")))


def capabilities(facts: DataFrame, metadata: DataFrame, least: float) -> DataFrame:
    """Q5: preferences (preference, fact_key) that some confident fact supports; the others with the reason."""
    g = facts.groupBy("fact_key").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"))
    j = metadata.join(g, "fact_key", "left").groupBy("preference").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return j.select("preference", F.when(F.col("n").isNull(), "no facts").when(F.col("best") < least, "weak").otherwise("supported").alias("state"))


def mine_gaps(wanted: DataFrame, facts: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """Q6: (entity_id, fact_key) wanted for which neither the entity nor what its edges lead to has a usable fact."""
    usable = facts.filter((F.col("confidence") >= least) & F.col("value_text").isNotNull() & (F.col("value_text") != "")).select("entity_id", "fact_key").distinct()
    near = edges.select(F.col("src").alias("entity_id"), "dst").join(usable.select(F.col("entity_id").alias("dst"), "fact_key"), "dst").select("entity_id", "fact_key")
    return wanted.join(usable.unionByName(near).distinct(), ["entity_id", "fact_key"], "left_anti")


def audit_failures(cases: DataFrame, facts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q7: whether the expected (entity_id, fact_key) is absent, present without metadata, or present."""
    f = facts.select("entity_id", "fact_key").distinct().withColumn("f", F.lit(True))
    m = metadata.select("fact_key").distinct().withColumn("m", F.lit(True))
    j = cases.join(f, ["entity_id", "fact_key"], "left").join(m, "fact_key", "left")
    return j.select("case_id", F.when(F.col("f").isNull(), "absent").when(F.col("m").isNull(), "without metadata").otherwise("present").alias("state"))


def check_media(facts: DataFrame, files: DataFrame, retired: str) -> DataFrame:
    """Q8: URLs inside texts that no file has, whose hash differs, or that begin with a retired prefix. ``files``: url, sha."""
    urls = facts.select("fact_no", "sha", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(https?://[^\s\"')]+)"), F.lit(1)))).alias("url"))
    j = urls.join(files.withColumnRenamed("sha", "file_sha"), "url", "left")
    state = F.when(F.col("url").startswith(retired), "retired").when(F.col("file_sha").isNull(), "missing").when(F.col("sha") != F.col("file_sha"), "hash differs")
    return j.select("fact_no", "url", state.alias("state")).filter("state IS NOT NULL")


def validate_geometry(df: DataFrame) -> DataFrame:
    """Q9: a closed ring with three distinct points or more inside the ranges; a stated distance within 15 % and 25 m of the measured."""
    r = F.col("ring")
    inside = F.forall(r, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    closed = F.element_at(r, 1) == F.element_at(r, -1)
    distance = F.abs(F.col("stated_m") - F.col("measured_m")) <= F.greatest(F.lit(25.0), F.col("measured_m") * 0.15 + 25)
    return df.select("id", F.when(~inside, "range").when(~closed, "open").when(F.size(F.array_distinct(r)) < 3, "points").when(~distance, "distance").otherwise("ok").alias("state"))


def validate_claims(claims: DataFrame, official: list[str]) -> DataFrame:
    """Q10: rejected (blank subject or predicate, confidence outside 0 to 1, page 0, blank quote), accepted from official sources with
    exact scope, else quarantined."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    bad = blank("subject") | blank("predicate") | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) | (F.col("page") == 0) | blank("quote")
    return claims.withColumn("state", F.when(bad, "rejected").when(F.col("source").isin(official) & F.col("exact"), "accepted").otherwise("quarantined"))


def freshness(manifests: DataFrame, now: Column, limits: dict[str, int]) -> DataFrame:
    """Q11: per asset the age in days of its oldest parseable watermark, else of its creation, against the limit of its cadence."""
    limit = reduce(lambda a, kv: F.when(F.col("cadence") == kv[0], kv[1]).otherwise(a), limits.items(), F.lit(None).cast("int"))
    oldest = F.array_min(F.transform("watermarks", lambda w: F.coalesce(F.to_date(F.try_to_timestamp(w, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(w, F.lit("yyyy-MM"))))))
    age = F.datediff(now, F.coalesce(oldest, F.col("created")))
    return manifests.select("asset", age.alias("age_days"), (age > limit).alias("stale"))


def admit(df: DataFrame, pattern: str, sources: list[str], cap: float, floor: float) -> DataFrame:
    """Q12: rows whose id matches, from allowed sources, with a capped confidence of at least ``floor``."""
    return df.filter(F.col("dst").rlike(pattern) & F.col("source_type").isin(sources)).withColumn("confidence", F.least("confidence", F.lit(cap))).filter(F.col("confidence") >= floor)


def ratio_check(baseline: DataFrame, candidate: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Q13: candidate >= floor(ratio * baseline) for every metric; a missing candidate counts 0."""
    j = baseline.withColumnRenamed("value", "baseline").join(candidate.withColumnRenamed("value", "candidate"), "metric", "left")
    return j.select("metric", "baseline", F.coalesce("candidate", F.lit(0)).cast("long").alias("candidate"), (F.coalesce("candidate", F.lit(0)) >= F.floor(F.col("baseline") * ratio)).alias("passed"))


def failure_ledger(df: DataFrame, codes: list[tuple[str, str, bool]]) -> DataFrame:
    """Q14: message prefix to (code, retryable), a digest id, one row per failed unit."""
    code = reduce(lambda a, c: F.when(F.col("message").startswith(c[0]), c[1]).otherwise(a), reversed(codes), F.lit("unknown"))
    retry = reduce(lambda a, c: F.when(F.col("message").startswith(c[0]), c[2]).otherwise(a), reversed(codes), F.lit(False))
    return df.select("unit", code.alias("code"), retry.alias("retryable"), content_id("failure:", F.col("unit"), F.col("message")).alias("failure_id"))
