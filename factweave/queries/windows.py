"""Queries of the ranking operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .registry import Tables, query

TRUST = {"registry": 0, "portal": 1, "review": 2, "forum": 3}
_TIER = "CASE source_type WHEN 'registry' THEN 0 WHEN 'portal' THEN 1 WHEN 'review' THEN 2 WHEN 'forum' THEN 3 ELSE 4 END"


@query("SELECT entity_id, fact_key, source_type, source_url, value_text, confidence, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key, source_type, source_url ORDER BY confidence DESC, value_text DESC, skill_id DESC, fact_no DESC) = 1")
def w1_compact_facts(t: Tables):
    return W.compact_facts(t.facts).select("entity_id", "fact_key", "source_type", "source_url", "value_text", "confidence", "fact_no")


@query(f"SELECT entity_id, fact_key, source_type, value_text, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key ORDER BY CASE WHEN fact_key = 'order_status' AND source_type = 'review' THEN 0 ELSE 9 END, {_TIER}, least(confidence, 0.9) DESC, confidence DESC, value_text DESC, fact_no DESC) = 1")
def w2_resolve_facts(t: Tables):
    return W.resolve_facts(t.facts, TRUST, {("order_status", "review"): 0}).select("entity_id", "fact_key", "source_type", "value_text", "fact_no")


_LOOSE = "(SELECT * REPLACE (CASE WHEN fact_no % 3 > 0 THEN source_url END AS source_url) FROM facts)"


@query(f"SELECT entity_id, fact_key, source_type, source_url, skill_id, value_text, fact_no FROM {_LOOSE} QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key, CASE WHEN fact_key = 'order_priority' THEN source_type END, CASE WHEN fact_key = 'order_priority' THEN coalesce(source_url, value_text) END, CASE WHEN fact_key = 'order_priority' THEN skill_id END ORDER BY CASE WHEN fact_key = 'order_status' AND source_type = 'review' THEN 0 ELSE 9 END, {_TIER}, CASE source_type WHEN 'review' THEN least(confidence, 0.6::DOUBLE) WHEN 'forum' THEN least(confidence, 0.4::DOUBLE) ELSE confidence END DESC, confidence DESC, value_text DESC, fact_no DESC) = 1")
def w2_multi_value_facts(t: Tables):
    """W2 where a key keeps several values, facts without a url stand for their value, and single sources have a cap."""
    loose = t.facts.withColumn("source_url", F.when(F.col("fact_no") % 3 > 0, F.col("source_url")))
    found = W.resolve_facts(loose, TRUST, {("order_status", "review"): 0}, multi_value=["order_priority"], caps={"review": 0.6, "forum": 0.4})
    return found.select("entity_id", "fact_key", "source_type", "source_url", "skill_id", "value_text", "fact_no")


@query("SELECT entity_id, fact_key, source_type, source_url, skill_id, version, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key, source_type, source_url, skill_id ORDER BY version DESC, confidence DESC, value_text DESC, fact_no DESC) = 1")
def w3_current_facts(t: Tables):
    return W.current_facts(t.facts).select("entity_id", "fact_key", "source_type", "source_url", "skill_id", "version", "fact_no")


@query("SELECT entity_id, fact_key, value_text, skill_id, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key ORDER BY (CASE WHEN value_number IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN skill_id <> '' THEN 1 ELSE 0 END) DESC, fact_no) = 1")
def w4_dedupe_annotations(t: Tables):
    rows = t.facts.withColumn("n", F.col("value_number").cast("string"))
    return W.dedupe_annotations(rows, ["entity_id", "fact_key"], ["n", "skill_id"], "fact_no").select("entity_id", "fact_key", "value_text", "skill_id", "fact_no")


@query(f"SELECT entity_id, fact_key, source_type, fact_no FROM facts WHERE NOT starts_with(fact_key, 'order_p') OR {_TIER} < 2 QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key ORDER BY {_TIER}, source_type, source_url, value_text, fact_no) = 1")
def w5_best_fact(t: Tables):
    return W.best_fact(t.facts, TRUST, ("order_p",), 2).select("entity_id", "fact_key", "source_type", "fact_no")


@query("SELECT entity_id, value_number, confidence, learned_on FROM facts WHERE fact_key = 'order_total' AND value_number BETWEEN 1000 AND 300000 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, learned_on DESC, fact_no DESC) = 1")
def w6_latest_valid(t: Tables):
    return W.latest_valid(t.facts, "order_total", F.col("value_number").between(1000, 300000)).select("entity_id", "value_number", "confidence", "learned_on")


_COORDINATES = """
    SELECT o_custkey AS entity_id, o_orderkey AS observation_id, 'lat' AS axis, o_totalprice AS value, o_orderpriority AS source_type, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence FROM {orders}
    UNION ALL SELECT o_custkey, o_orderkey, 'lon', o_totalprice / 2, o_orderpriority, CAST(o_orderkey % 90 AS DOUBLE) / 100 FROM {orders} WHERE o_orderkey % 3 <> 0"""


@query(f"""
    WITH c AS ({_COORDINATES.format(orders="orders")}),
    p AS (SELECT entity_id, observation_id, source_type, max(value) FILTER (axis = 'lat') AS lat, max(value) FILTER (axis = 'lon') AS lon, min(confidence) AS confidence FROM c WHERE source_type IN ('1-URGENT', '2-HIGH') GROUP BY ALL)
    SELECT entity_id, observation_id, lat, lon, confidence FROM p WHERE lat IS NOT NULL AND lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY source_type, confidence DESC, observation_id) = 1""")
def w7_resolve_coordinates(t: Tables):
    rows = t.spark.sql(_COORDINATES, orders=t.orders)
    return W.resolve_coordinates(rows, ["1-URGENT", "2-HIGH"]).select("entity_id", "observation_id", "lat", "lon", "confidence")


@query("SELECT entity_id, listing_id, price, row_number() OVER (PARTITION BY entity_id, kind ORDER BY price, area_sqft DESC, listing_id) AS rank FROM listings QUALIFY rank <= 5")
def w8_top_n(t: Tables):
    return W.top_n(t.listings, ["entity_id", "kind"], [F.col("price"), F.col("area_sqft").desc(), F.col("listing_id")], 5).select("entity_id", "listing_id", "price", F.col("rank").cast("long"))


@query("SELECT entity_id, listing_id, kind, seen_on FROM listings QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY CASE kind WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, seen_on, listing_id) = 1")
def w9_pick_option(t: Tables):
    return W.pick_option(t.listings, "entity_id", {"N": 0, "R": 1}).select("entity_id", "listing_id", "kind", "seen_on")


@query("""SELECT 'first' AS mode, entity_id, value_number FROM facts WHERE value_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, fact_no) = 1
    UNION ALL SELECT 'min', entity_id, min(value_number) FROM facts GROUP BY entity_id UNION ALL SELECT 'max', entity_id, max(value_number) FROM facts GROUP BY entity_id""")
def w10_numeric_fact(t: Tables):
    one = lambda m: W.numeric_fact(t.facts, ["order_total"], m).select(F.lit(m).alias("mode"), "entity_id", "value_number")
    return one("first").unionByName(one("min")).unionByName(one("max"))


@query(f"SELECT entity_id AS subject, skill_id AS preference, fact_key, confidence, display FROM (SELECT *, concat(value_text, ' ', fact_no) AS display, round(confidence * 0.5, 6) AS score FROM facts) QUALIFY row_number() OVER (PARTITION BY entity_id, skill_id ORDER BY {_TIER}, CASE fact_key WHEN 'order_total' THEN 0 ELSE 1 END, score DESC, confidence DESC, fact_key, display) = 1")
def w11_best_evidence(t: Tables):
    tier = F.expr(_TIER)
    rows = t.facts.select(F.col("entity_id").alias("subject"), F.col("skill_id").alias("preference"), tier.alias("source_rank"), F.when(F.col("fact_key") == "order_total", 0).otherwise(1).alias("key_rank"), F.round(F.col("confidence") * 0.5, 6).alias("score"), "confidence", "fact_key", F.concat("value_text", F.lit(" "), "fact_no").alias("display"))
    return W.best_evidence(rows).select("subject", "preference", "fact_key", "confidence", "display")


@query("""WITH i AS (SELECT entity_id, listing_id AS image_id, kind, price AS quality FROM listings),
    a AS (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY quality DESC, image_id) AS in_kind, CASE kind WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS kr FROM i)
    SELECT entity_id, image_id, position, position = 1 AS is_hero FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN in_kind = 1 THEN 0 ELSE 1 END, CASE WHEN in_kind = 1 THEN kr END NULLS FIRST, quality DESC, image_id) AS position FROM a) WHERE position <= 6""")
def w12_curate_gallery(t: Tables):
    images = t.listings.select("entity_id", F.col("listing_id").alias("image_id"), "kind", F.col("price").alias("quality"))
    return W.curate_gallery(images, "entity_id", ["N", "A"], 6).select("entity_id", "image_id", F.col("position").cast("long"), "is_hero")


@query("""WITH r AS (SELECT entity_id, CAST(confidence * 100 AS BIGINT) AS helpful, learned_on, fact_no AS ordinal, CASE source_type WHEN 'forum' THEN 'concern' WHEN 'model' THEN 'neutral' ELSE 'positive' END AS tone FROM facts WHERE fact_key = 'order_status'),
    k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY helpful DESC, learned_on DESC, ordinal) AS rn, row_number() OVER (PARTITION BY entity_id, tone ORDER BY helpful DESC, learned_on DESC, ordinal) AS cn FROM r),
    s AS (SELECT *, bool_or(rn <= 3 AND tone = 'positive') OVER (PARTITION BY entity_id) AND NOT bool_or(rn <= 3 AND tone = 'concern') OVER (PARTITION BY entity_id) AND bool_or(tone = 'concern') OVER (PARTITION BY entity_id) AS swap FROM k)
    SELECT entity_id, ordinal, tone, slot FROM (SELECT *, CASE WHEN swap AND tone = 'concern' AND cn = 1 THEN 3 ELSE rn END AS slot FROM s) WHERE slot <= 3 AND NOT (swap AND rn = 3 AND NOT (tone = 'concern' AND cn = 1))""")
def w13_rank_reviews(t: Tables):
    tone = F.when(F.col("source_type") == "forum", "concern").when(F.col("source_type") == "model", "neutral").otherwise("positive")
    rows = t.facts.filter("fact_key = 'order_status'").select("entity_id", F.expr("CAST(round(confidence * 100) AS BIGINT)").alias("helpful"), "learned_on", F.col("fact_no").alias("ordinal"), tone.alias("tone"))
    return W.rank_reviews(rows, "entity_id", 3).select("entity_id", "ordinal", "tone", F.col("slot").cast("long"))


@query()
def w14_diversify(t: Tables):
    """Greedy and order-dependent: tested against a plain loop."""
    ranked = W.top_n(t.listings.select("entity_id", "listing_id", "seller", "price"), ["entity_id"], [F.col("price").desc(), F.col("listing_id")], 30)
    return W.diversify(ranked, "entity_id", "seller", 10, 2).select("entity_id", "listing_id", "seller", "position")


@query()
def w14_diversify_all(t: Tables):
    """All listings of a part, the first ten of them with short runs: tested against a plain loop."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("price").desc(), "listing_id"))
    ranked = t.listings.select("entity_id", "listing_id", "seller", rank.alias("rank"))
    return W.diversify_all(ranked, "entity_id", "seller", 10, 2).select("entity_id", "listing_id", "seller", "position")


_SETS = "SELECT CAST(o_orderkey % 3 AS INT) AS set_no, CAST(row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY sum(o_totalprice) DESC, o_custkey) AS BIGINT) AS rank, o_custkey AS id FROM {orders} GROUP BY o_orderkey % 3, o_custkey"


@query(f"WITH s AS ({_SETS.format(orders='orders')}) SELECT id, rank, set_no FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, set_no) = 1) ORDER BY rank, set_no, id LIMIT 50")
def w15_round_robin(t: Tables):
    return W.round_robin(t.spark.sql(_SETS, orders=t.orders), 50).select("id", "rank", "set_no")


@query("""SELECT seller, listing_id, price FROM (SELECT * FROM listings WHERE listing_id NOT IN (SELECT concat('listing:', l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_discount > 0.08) QUALIFY row_number() OVER (PARTITION BY seller ORDER BY price DESC, listing_id) = 1) ORDER BY price DESC, listing_id LIMIT 20""")
def w16_top_per_group(t: Tables):
    return W.top_per_group(t.listings, "seller", [F.col("price").desc(), F.col("listing_id")], 20, t.listings.filter("discount > 0.08"), "listing_id").select("seller", "listing_id", "price")


@query("SELECT entity_id, channel, candidate, score, row_number() OVER (PARTITION BY entity_id, channel ORDER BY score DESC, candidate) AS rank FROM (SELECT entity_id, kind AS channel, seller AS candidate, max(price) AS score FROM listings GROUP BY ALL) QUALIFY rank <= 3")
def w17_cap_channels(t: Tables):
    best = t.listings.groupBy("entity_id", F.col("kind").alias("channel"), F.col("seller").alias("candidate")).agg(F.max("price").alias("score"))
    return W.top_n(best, ["entity_id", "channel"], [F.col("score").desc(), F.col("candidate")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT entity_id, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sha256(concat_ws('|', source_url, value_text, fact_no)), fact_no) = 1")
def w18_stable_first(t: Tables):
    return W.stable_first(t.facts, ["entity_id"], "source_url", "value_text", "fact_no").select("entity_id", "fact_no")


_IMAGES = "SELECT l_orderkey * 10 + l_linenumber AS image_id, concat('https://img.example/', l_partkey, '?v=', l_linenumber) AS url, CASE WHEN l_linenumber % 2 = 0 THEN concat('h', l_suppkey) END AS content_sha256 FROM {lineitem}"


@query(f"SELECT coalesce(content_sha256, regexp_replace(url, '\\?.*$', '')) AS identity, min(image_id) AS image_id FROM ({_IMAGES.format(lineitem='lineitem')}) GROUP BY 1")
def w19_dedupe_images(t: Tables):
    return W.dedupe_images(t.spark.sql(_IMAGES, lineitem=t.lineitem)).select("identity", "image_id")


@query()
def w20_select_previews(t: Tables):
    """Greedy joint caps: tested against a plain loop."""
    docs = t.listings.select(F.col("entity_id").alias("subject"), F.col("listing_id").alias("document_id"), F.col("kind").alias("role"), F.concat("seller", F.lit("/"), "bhk").alias("content_hash"))
    return W.select_previews(docs, "subject", ["N", "A"], 4, 6)


@query("SELECT o_orderkey AS event_id, coalesce((SELECT max(struct_pack(at := CAST(l_shipdate AS DATE), n := l_linenumber, effect := l_returnflag)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N').effect, 'active') AS effect FROM orders")
def w21_current_effects(t: Tables):
    relations = t.lineitem.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("relation_id"), F.to_date("l_shipdate").alias("at"), F.col("l_returnflag").alias("effect"))
    return W.current_effects(t.orders.select(F.col("o_orderkey").alias("event_id")), relations).select("event_id", "effect")


@query("SELECT entity_id, seller, listing_id, price FROM listings QUALIFY row_number() OVER (PARTITION BY entity_id, seller ORDER BY price, listing_id) = 1")
def w22_nearest_per_feature(t: Tables):
    return W.nearest_per_feature(t.listings.select("entity_id", "seller", "price", "listing_id"), "entity_id", "seller", "price", "listing_id")
