"""Queries of set operations, table maintenance and sorts."""

from pyspark.sql import functions as F

from ..operators import tables as U
from .registry import Tables, query


@query("SELECT DISTINCT entity_id, fact_key, value_text FROM facts")
def u1_merge_snapshots(t: Tables):
    f = t.facts.select("entity_id", "fact_key", "value_text")
    return U.merge_snapshots(f.filter("value_text > '3'"), f.filter("value_text <= '5'"))


@query("SELECT entity_id, fact_key, count(DISTINCT value_text) AS versions FROM facts GROUP BY ALL HAVING count(DISTINCT value_text) > 1")
def u1_contradictions(t: Tables):
    return U.contradictions(t.facts, ["entity_id", "fact_key"], ["value_text"])


@query("""WITH bf AS (SELECT entity_id, fact_key, skill_id, fact_no FROM facts WHERE fact_key <> 'order_status' OR fact_no % 3 = 0), nf AS (SELECT entity_id, fact_key, CASE WHEN fact_no % 2 = 0 THEN 'skill1' ELSE 'skill2' END AS skill_id, fact_no FROM facts WHERE fact_no % 7 = 0 AND value_number > 250000),
    be AS (SELECT entity_id, CASE WHEN entity_type = 'customer' THEN 'place' ELSE entity_type END AS entity_type FROM entities WHERE entity_id NOT LIKE '%9'), ne AS (SELECT entity_id, 'place' AS entity_type FROM entities WHERE entity_type = 'customer'), bd AS (SELECT src, dst FROM edges WHERE edge_type IN ('located_in', 'part_of')), nd AS (SELECT src, dst FROM edges WHERE edge_type IN ('located_in', 'bought')),
    kept AS (SELECT * FROM bf WHERE skill_id <> 'skill1'), came AS (SELECT * FROM nf WHERE skill_id = 'skill1'), lost AS (SELECT entity_id FROM be WHERE entity_type = 'place' AND entity_id IN (SELECT entity_id FROM bf) AND entity_id NOT IN (SELECT entity_id FROM kept)),
    e AS (SELECT * FROM be WHERE entity_id NOT IN (SELECT entity_id FROM lost) UNION SELECT * FROM ne WHERE entity_id IN (SELECT entity_id FROM came))
    SELECT 'facts' AS kind, concat_ws('|', entity_id, fact_key, skill_id, fact_no) AS row FROM (SELECT * FROM kept UNION SELECT * FROM came)
    UNION ALL SELECT 'metadata', concat_ws('|', entity_id, fact_key) FROM (SELECT entity_id, fact_key FROM kept UNION SELECT entity_id, fact_key FROM came)
    UNION ALL SELECT 'entities', concat_ws('|', entity_id, entity_type) FROM e
    UNION ALL SELECT 'edges', concat_ws('|', src, dst) FROM (SELECT * FROM bd WHERE src NOT IN (SELECT entity_id FROM lost) AND dst NOT IN (SELECT entity_id FROM lost)
        UNION SELECT * FROM nd WHERE src IN (SELECT entity_id FROM e) AND dst IN (SELECT entity_id FROM e) AND (src IN (SELECT entity_id FROM came) OR dst IN (SELECT entity_id FROM came)))""")
def u2_replace_by_producer(t: Tables):
    """U2 of one producer, with metadata, places and edges that lose their last support."""
    f = t.facts.select("entity_id", "fact_key", "skill_id", "fact_no", "value_number")
    facts = f.filter("fact_key <> 'order_status' OR fact_no % 3 = 0").drop("value_number")
    fresh = f.filter("fact_no % 7 = 0 AND value_number > 250000").withColumn("skill_id", F.when(F.col("fact_no") % 2 == 0, "skill1").otherwise("skill2")).drop("value_number")
    places = t.entities.select("entity_id", F.when(F.col("entity_type") == "customer", "place").otherwise(F.col("entity_type")).alias("entity_type"))
    base = {"facts": facts, "metadata": facts.select("entity_id", "fact_key").distinct(), "entities": places.filter("entity_id NOT LIKE '%9'"), "edges": t.edges.filter("edge_type IN ('located_in', 'part_of')").select("src", "dst")}
    new = {"facts": fresh, "metadata": fresh.select("entity_id", "fact_key").distinct(), "entities": places.filter("entity_type = 'place'"), "edges": t.edges.filter("edge_type IN ('located_in', 'bought')").select("src", "dst")}
    after = U.replace_by_producer(base, new, ["skill1"])
    parts = [df.select(F.lit(kind).alias("kind"), F.concat_ws("|", *df.columns).alias("row")) for kind, df in after.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH b AS (SELECT o_custkey AS id, 'old' AS name, min(CAST(o_orderdate AS DATE)) AS c, max(CAST(o_orderdate AS DATE)) AS u FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), n AS (SELECT c_custkey AS id, c_name AS name, DATE '1996-01-01' AS c, DATE '1996-06-01' AS u FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(b.id, n.id) AS id, coalesce(n.name, b.name) AS name, CAST(least(b.c, n.c) AS STRING) AS created, CAST(greatest(b.u, n.u) AS STRING) AS updated FROM b FULL JOIN n ON b.id = n.id""")
def u3_upsert(t: Tables):
    day = F.to_date("o_orderdate").cast("string")
    base = t.orders.filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("id")).agg(F.lit("old").alias("name"), F.min(day).alias("created"), F.max(day).alias("updated"))
    return U.upsert(base, t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("1996-01-01").alias("created"), F.lit("1996-06-01").alias("updated")), "id")


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u4_merge_candidates(t: Tables):
    ids = t.orders.withColumnRenamed("o_custkey", "id")
    return U.merge_candidates([ids.filter("o_orderstatus = 'F'"), ids.filter("o_orderpriority LIKE '1%'")], [], t.customer.filter("c_acctbal < 0").withColumnRenamed("c_custkey", "id"))


@query("SELECT src, edge_type, dst, edge_type = 'located_in' AS evidenced, max(CASE WHEN edge_type = 'located_in' THEN 1 ELSE confidence END) AS confidence FROM edges GROUP BY src, edge_type, dst")
def u5_merge_edges(t: Tables):
    return U.merge_edges(t.edges, t.edges.filter("edge_type = 'located_in'").withColumn("confidence", F.lit(1.0))).select("src", "edge_type", "dst", "evidenced", "confidence")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem")
def u6_dedupe_rows(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_tax").dropDuplicates()


@query("""WITH p AS (SELECT l_partkey AS e, l_suppkey AS s, 'old' AS v FROM lineitem WHERE l_linenumber <= 3), n AS (SELECT l_partkey AS e, l_suppkey AS s, 'new' AS v FROM lineitem WHERE l_linenumber = 5) SELECT v, count(*) AS n FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.e = p.e AND n.s = p.s) UNION ALL SELECT * FROM n) GROUP BY 1""")
def u7_carry_forward(t: Tables):
    rows = lambda cond, v: t.lineitem.filter(cond).select(F.col("l_partkey").alias("e"), F.col("l_suppkey").alias("s"), F.lit(v).alias("v"))
    return U.carry_forward(rows("l_linenumber <= 3", "old"), rows("l_linenumber = 5", "new"), "e", "s").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT listing_id, CAST(floor(price + 0.5::DOUBLE) AS BIGINT) AS price, area_sqft, bhk, count(*) AS n FROM listings WHERE price > 0 AND area_sqft > 0 AND bhk > 0 GROUP BY ALL")
def u8_admit_listings(t: Tables):
    return U.admit_listings(t.listings).groupBy("listing_id", "price", "area_sqft", "bhk").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS partition, count(*) AS files, sum(l_linenumber * 10) AS rows, CAST(sum(CAST(l_quantity AS BIGINT) * 1000000) AS BIGINT) AS bytes, max(l_tax * 100) AS age_hours, count(*) > 600 OR sum(l_linenumber * 10) > 25000 OR sum(CAST(l_quantity AS BIGINT) * 1000000) > 16000000000 OR max(l_tax * 100) > 24 AS compact FROM lineitem GROUP BY 1")
def u9_needs_compaction(t: Tables):
    files = t.lineitem.select(F.col("l_suppkey").alias("partition"), (F.col("l_linenumber") * 10).alias("rows"), (F.col("l_quantity").cast("long") * 1000000).alias("bytes"), (F.col("l_tax") * 100).alias("age_hours"))
    return U.needs_compaction(files, 600, 25000, 16_000_000_000, 24.0)


@query("SELECT entity_id, fact_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY value_number DESC NULLS LAST, confidence DESC, fact_no) AS rank FROM facts)")
def o1_tier_rank(t: Tables):
    return U.tier_rank(t.facts, "entity_id", ["value_number", "confidence"], [F.col("fact_no")]).select("entity_id", "fact_no", F.col("rank").cast("long"))


@query("SELECT entity_id, listing_id, area_sqft, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY area_sqft, listing_id) AS rank FROM (SELECT *, min(area_sqft) OVER (PARTITION BY entity_id) AS m FROM listings) WHERE area_sqft <= greatest(5, m * 2)) WHERE rank <= 4")
def o2_relative_topk(t: Tables):
    return U.relative_topk(t.listings, "entity_id", "area_sqft", "listing_id", 5.0, 2.0, 4).select("entity_id", "listing_id", "area_sqft", F.col("rank").cast("long"))


@query("SELECT entity_id, fact_no, row_number() OVER (PARTITION BY entity_id ORDER BY CASE source_type WHEN 'registry' THEN 0 WHEN 'portal' THEN 1 ELSE 2 END, fact_no) AS position FROM facts")
def o3_cohort_sort(t: Tables):
    cohort = F.when(F.col("source_type") == "registry", 0).when(F.col("source_type") == "portal", 1).otherwise(2)
    return U.cohort_sort(t.facts, "entity_id", cohort, "fact_no").select("entity_id", "fact_no", F.col("position").cast("long"))


@query("SELECT entity_id, fact_no, row_number() OVER (PARTITION BY entity_id ORDER BY value_number ASC NULLS LAST, confidence DESC NULLS LAST, fact_no ASC) AS position FROM facts")
def o4_config_sort(t: Tables):
    from pyspark.sql import Window

    order = U.config_order([("value_number", "asc"), ("confidence", "desc"), ("fact_no", "asc")])
    return t.facts.select("entity_id", "fact_no", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)).cast("long").alias("position"))


@query("SELECT seller, listing_id, size, shelf, rank FROM (SELECT seller, listing_id, row_number() OVER (PARTITION BY seller ORDER BY price DESC, listing_id) AS rank FROM listings) JOIN (SELECT seller, size, row_number() OVER (ORDER BY size DESC, seller) AS shelf FROM (SELECT seller, count(DISTINCT entity_id) AS size FROM listings GROUP BY 1)) USING (seller) WHERE rank <= 5")
def o5_rank_shelves(t: Tables):
    return U.rank_shelves(t.listings.withColumnRenamed("entity_id", "id"), "seller", [F.col("price").desc(), F.col("listing_id")], 5).select("seller", "listing_id", "size", F.col("shelf").cast("long"), F.col("rank").cast("long"))


@query("SELECT entity_id, listing_id, row_number() OVER (PARTITION BY entity_id ORDER BY bhk DESC, kind, listing_id, price) AS position FROM listings")
def o6_label_order(t: Tables):
    from pyspark.sql import Window

    order = U.config_order([("bhk", "desc"), ("kind", "asc"), ("listing_id", "asc"), ("price", "asc")])
    return t.listings.select("entity_id", "listing_id", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)).cast("long").alias("position"))
