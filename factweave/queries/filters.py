"""Queries of the predicates."""

from pyspark.sql import functions as F

from ..operators import filters as C
from ..operators import spatial as S
from .registry import Tables, query

_A, _B = "CASE WHEN l_linenumber % 4 = 0 THEN 1 WHEN l_discount > 0.05 THEN 3 WHEN l_linenumber = 5 THEN 2 ELSE 0 END", "CASE WHEN l_tax IS NULL OR l_linenumber = 3 THEN 2 WHEN l_tax > 0.04 THEN 3 ELSE 0 END"


@query(f"""SELECT a, b, CASE WHEN a = 0 OR b = 0 THEN 0 WHEN a = 1 OR b = 1 THEN 1 WHEN a = 2 OR b = 2 THEN 2 ELSE 3 END AS both, CASE WHEN a = 3 OR b = 3 THEN 3 WHEN a = 1 OR b = 1 THEN 1 WHEN a = 2 OR b = 2 THEN 2 ELSE 0 END AS either, CASE a WHEN 3 THEN 0 WHEN 0 THEN 3 ELSE a END AS neither, count(*) AS n FROM (SELECT {_A} AS a, {_B} AS b FROM lineitem) GROUP BY ALL""")
def c1_four_state(t: Tables):
    s = t.lineitem.select(F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.withColumns({"both": C.and4(a, b), "either": C.or4(a, b), "neither": C.not4(a)}).groupBy("a", "b", "both", "either", "neither").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT listing_id, count(*) AS n FROM listings WHERE bhk >= 2 AND (kind = 'R' OR price < 20000) AND NOT (area_sqft > 40) GROUP BY 1")
def c2_constraint_filter(t: Tables):
    tree = {"and": [{"field": "bhk", "op": "gte", "value": 2}, {"any": [{"field": "kind", "op": "eq", "value": "R"}, {"field": "price", "op": "lt", "value": 20000}]}, {"not": {"field": "area_sqft", "op": "gt", "value": 40}}]}
    return t.listings.filter(C.constraint(tree)).groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity_id, min(price) AS low, max(price) AS high FROM listings GROUP BY 1 HAVING max(price) >= 10000 AND min(price) <= 12000")
def c3_budget_overlap(t: Tables):
    return C.budget_overlap(t.listings.groupBy("entity_id").agg(F.min("price").alias("low"), F.max("price").alias("high")), "low", "high", 10000, 12000)


@query("SELECT fact_key, CASE WHEN value_number IS NULL THEN 1 WHEN value_number < 100000 THEN 3 ELSE 0 END AS cheap, CASE WHEN source_type = 'registry' THEN 3 ELSE 0 END AS official, CASE WHEN source_type <> 'registry' OR value_number >= 100000 THEN 0 WHEN value_number IS NULL THEN 1 ELSE 3 END AS all_terms, count(*) AS n FROM facts GROUP BY ALL")
def c4_evaluate_terms(t: Tables):
    return C.evaluate_terms(t.facts, {"cheap": F.col("value_number") < 100000, "official": F.col("source_type") == "registry"}).groupBy("fact_key", "cheap", "official", "all_terms").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN l_linenumber = 7 THEN 1 WHEN l_returnflag = 'A' THEN 2 WHEN l_quantity * CASE l_returnflag WHEN 'N' THEN 1 ELSE 10 END <= 100.001 THEN 3 ELSE 0 END AS state, count(*) AS n FROM lineitem GROUP BY 1")
def c5_numeric_constraint(t: Tables):
    state = C.numeric_constraint(F.when(F.col("l_linenumber") != 7, F.col("l_quantity")), F.col("l_returnflag"), {"N": 1.0, "R": 10.0}, "max", 100.0)
    return t.lineitem.select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE lower(p_type) IN ('steel', 'brass') OR (length(p_type) >= 4 AND (contains(lower(p_type), 'steel') OR contains('steel', lower(p_type)) OR contains(lower(p_type), 'brass') OR contains('brass', lower(p_type))))")
def c6_area_filter(t: Tables):
    return t.part.filter(C.area_matches(F.col("p_type"), "Steel", ("Brass",))).select("p_partkey")


@query("SELECT fact_key, source_type, count(*) AS n, max(least(confidence, 0.8)) AS top FROM facts WHERE (fact_key <> 'order_total' OR source_type IN ('registry', 'portal')) AND least(confidence, 0.8) >= 0.3 GROUP BY ALL")
def c7_admit_source(t: Tables):
    return C.admit_source(t.facts, {"order_total": ["registry", "portal"]}, 0.8, 0.3).groupBy("fact_key", "source_type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))


@query("SELECT fact_key, source_type, count(*) AS n FROM facts WHERE NOT starts_with(fact_key, 'order_p') OR source_type = 'registry' GROUP BY ALL")
def c8_visible_facts(t: Tables):
    return C.visible_facts(t.facts, ["order_p"], ["registry"]).groupBy("fact_key", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT fact_no FROM facts WHERE value_text <> '' AND source_url <> '' AND (value_number > 0 OR confidence > 0)")
def c9_requirements(t: Tables):
    return t.facts.filter(C.requirements(["value_text", "skill_id"], ["source_url"], ["value_number", "confidence"])).filter("value_text <> ''").select("fact_no")


@query("""SELECT id, km FROM (SELECT id, round(2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km, CAST(split_part(id, ':', 2) AS INT) AS k FROM (SELECT id, pow(sin((radians(13.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(13.0)) * pow(sin(radians(77.6 - lon) / 2), 2) AS h FROM subjects)) WHERE contains(id, 'customer') AND NOT contains(id, '7') AND km <= 12 AND (km <= 5 OR k % 10 >= 4)""")
def c10_nearby_filter(t: Tables):
    from ..functions.geo import haversine_km

    df = t.subjects.select("id", F.col("id").alias("name"), F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(13.0), F.lit(77.6)), 6).alias("km"), (F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 10).alias("reviews"))
    return C.nearby_filter(df, ["customer"], ["7"], 12.0, 5.0, 4).select("id", "km")


@query("SELECT CASE WHEN l_quantity <= 10 AND l_tax >= 0.06 THEN 'high' WHEN l_quantity <= 25 AND l_tax >= 0.02 THEN 'medium' WHEN l_quantity <= 40 THEN 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def c11_severity_band(t: Tables):
    return t.lineitem.select(C.severity_band(F.col("l_quantity"), F.col("l_tax"), [(10, 0.06, "high"), (25, 0.02, "medium"), (40, 0.0, "low")]).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT listing_id, count(*) AS n FROM listings WHERE area_sqft > 0 AND price / area_sqft * (1 + 0.35::DOUBLE) >= 1000 AND price / area_sqft * (1 - 0.35::DOUBLE) <= 1100 GROUP BY 1")
def c12_plausible_price(t: Tables):
    ok = C.plausible_price(F.col("price"), F.col("price"), F.col("area_sqft"), F.lit(1000.0), F.lit(1100.0))
    return t.listings.filter(ok).groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT o_custkey AS k, max(o_totalprice) AS t, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f FROM orders GROUP BY 1) SELECT concat('customer:', k) AS entity_id, label FROM (SELECT k, 'rich' AS label FROM w WHERE t > 300000 UNION ALL SELECT k, 'has closed' FROM w WHERE f IS NOT NULL UNION ALL SELECT k, 'mostly closed' FROM w WHERE t > 0 AND f / t > 0.5)""")
def c13_label_rules(t: Tables):
    facts = t.orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("entity_id"), F.explode(F.array(F.struct(F.lit("total").alias("k"), F.col("o_totalprice").alias("v")), F.struct(F.lit("closed").alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("v")))).alias("s")).select("entity_id", F.col("s.k").alias("fact_key"), F.col("s.v").alias("value_number"))
    return C.label_rules(facts, [{"facts": ["total"], "op": "gt", "value": 300000, "label": "rich"}, {"facts": ["closed"], "op": "present", "label": "has closed"}, {"facts": ["closed", "total"], "ratio": True, "op": "gt", "value": 0.5, "label": "mostly closed"}])


@query("SELECT event_id FROM events WHERE event_type IS NOT NULL AND value > 10 AND value <= 60")
def c14_shelf_filter(t: Tables):
    nested = t.events.select("event_id", F.struct("event_type", "value").alias("card"))
    return nested.filter(C.constraint({"and": [{"field": "card.event_type", "op": "exists", "value": True}, {"field": "card.value", "op": "gt", "value": 10}, {"field": "card.value", "op": "lte", "value": 60}]})).select("event_id")


@query("""WITH p AS (SELECT concat('part:', p_partkey) AS subject, concat('supplier:', p_partkey % 40) AS target FROM part), e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM edges WHERE edge_type = 'supplied_by')
    SELECT subject, target, CASE WHEN bool_or(coalesce(dst = target, FALSE)) AND max(n) > 1 THEN 1 WHEN bool_or(coalesce(dst = target, FALSE)) THEN 3 WHEN max(n) = 1 THEN 0 ELSE 1 END AS state FROM p LEFT JOIN e ON src = subject GROUP BY ALL""")
def c15_membership(t: Tables):
    pairs = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("subject"), F.concat(F.lit("supplier:"), F.col("p_partkey") % 40).alias("target"))
    return C.membership(pairs, t.edges.filter("edge_type = 'supplied_by'").withColumnRenamed("edge_type", "scope"), ["supplied_by"])


@query("SELECT entity_id FROM facts WHERE fact_key IN ('order_total', 'order_status') AND confidence >= 0.95 GROUP BY 1 HAVING count(DISTINCT fact_key) = 2")
def c16_required_evidence(t: Tables):
    return C.required_evidence(t.facts, ["order_total", "order_status"], 0.95)


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'pattern' WHEN l_quantity < 5 OR l_linenumber * 10 < 5 THEN 'size' WHEN l_quantity > l_linenumber * 10 * 3 OR l_linenumber * 10 > l_quantity * 3 THEN 'aspect' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def c17_reject_images(t: Tables):
    df = t.lineitem.select(F.concat(F.lit("https://img.example/"), "l_returnflag", F.lit(".png")).alias("url"), F.col("l_quantity").alias("width"), (F.col("l_linenumber") * 10).alias("height"))
    return df.select(C.reject_images(df, r"/R\.png$", 5, 3).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PRIVATE = (r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"(?i)\b[a-z]{5}[0-9]{4}[a-z]\b", r"(?i)\b(account|a/c)\s*(no\.?|number)?\s*[:#-]?\s*[a-z0-9-]{6,}\b", r"(^|[^0-9])\+?[0-9][0-9 ()-]{7,}[0-9]", "(?i)anil rao")


@query(f"""SELECT doc_id, {' AND '.join(f"NOT regexp_matches(x, '{p}')" for p in _PRIVATE)} AS ok FROM (SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' ANIL  RAO' WHEN 1 THEN ' anil rao' WHEN 2 THEN ' pan ABCDE1234F' ELSE ' Anil' END) AS x FROM documents)""")
def c18_privacy_ok(t: Tables):
    """C18 on the documents, some with a name or an identifier behind them."""
    more = F.when(F.col("doc_id") % 4 == 0, " ANIL  RAO").when(F.col("doc_id") % 4 == 1, " anil rao").when(F.col("doc_id") % 4 == 2, " pan ABCDE1234F").otherwise(" Anil")
    return t.documents.select("doc_id", C.privacy_ok(F.concat("text", more), ["Anil Rao"]).alias("ok"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(idiot|worthless)\b') THEN 'forbidden' ELSE 'too long' END AS reason FROM documents WHERE regexp_matches(text, '(?i)\b(idiot|worthless)\b') OR length(text) > 5000")
def c19_compliance_scan(t: Tables):
    return C.compliance_scan(t.documents, "text", ["idiot", "worthless"], 5000).select("doc_id", "reason")
