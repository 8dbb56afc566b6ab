"""Queries of projections and scalar functions."""

from pyspark.sql import functions as F

from ..functions import geo, text as X, values as V
from ..operators import unpivot as U
from ..operators import windows as W
from .registry import Tables, query

_VALUES = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'boolean' WHEN 3 THEN 'tags' ELSE 'score' END AS value_type, CASE WHEN l_linenumber % 5 = 1 THEN l_returnflag END AS value_text, CASE WHEN l_linenumber % 5 = 0 AND l_orderkey % 9 <> 0 THEN l_quantity + 0.25 END AS value_number, CASE WHEN l_linenumber % 5 = 2 THEN l_discount > 0.05 END AS value_bool, CASE WHEN l_linenumber % 5 = 3 THEN array(l_returnflag, l_linestatus) END AS value_tags, CASE WHEN l_linenumber % 5 = 4 THEN l_quantity / 100 END AS value_score, CASE WHEN l_linenumber % 5 = 4 THEN 'fine' END AS value_score_explanation FROM {lineitem}"
_DUCK = _VALUES.format(lineitem="lineitem").replace("array(l_returnflag, l_linestatus)", "[l_returnflag, l_linestatus]").replace("l_quantity + 0.25", "l_quantity + 0.25::DOUBLE")
_N = "regexp_replace(format('{{:.6f}}', {0}), '\\.?0+$', '')"


@query(f"""SELECT k, n, CASE value_type WHEN 'number' THEN 'numeric' WHEN 'boolean' THEN 'bool' ELSE value_type END AS value_type, CASE value_type WHEN 'number' THEN {_N.format('value_number')} WHEN 'boolean' THEN CAST(value_bool AS STRING) WHEN 'tags' THEN array_to_string(value_tags, ' ') WHEN 'score' THEN concat_ws(' ', {_N.format('value_score')}, value_score_explanation) ELSE value_text END AS value_text, count(*) AS c FROM ({_DUCK}) GROUP BY ALL""")
def p1_encode_value(t: Tables):
    out = V.encode_value(t.spark.sql(_VALUES, lineitem=t.lineitem)).withColumn("value_text", F.when((F.col("value_type") != "numeric") | F.col("value_number").isNotNull(), F.col("value_text")))
    return out.groupBy("k", "n", "value_type", "value_text").agg(F.count(F.lit(1)).alias("c"))


@query(f"SELECT CASE WHEN value_type = 'number' AND value_number IS NULL THEN 'rejected' ELSE 'valid' END AS state, count(*) AS n FROM ({_DUCK}) GROUP BY 1")
def p2_decode_value(t: Tables):
    ok, bad = V.decode_value(t.spark.sql(_VALUES, lineitem=t.lineitem))
    one = lambda df, s: df.groupBy(F.lit(s).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return one(ok, "valid").unionByName(one(bad, "rejected"))


@query(f"SELECT value_type, count(coalesce(value_number, value_score)) AS numbers, CAST(sum(CASE WHEN value_type = 'tags' THEN 2 WHEN value_type = 'text' THEN 1 ELSE 0 END) AS BIGINT) AS tags FROM ({_DUCK}) GROUP BY 1")
def p3_coercions(t: Tables):
    df = t.spark.sql(_VALUES, lineitem=t.lineitem)
    tags = F.when(F.col("value_type").isin("tags", "text"), F.size(V.as_tags())).otherwise(0)
    return df.groupBy("value_type").agg(F.count(V.as_number(df)).alias("numbers"), F.sum(tags).alias("tags"))


@query("""WITH b AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key ORDER BY source_type, source_url, value_text, fact_no) = 1)
    SELECT entity_id, coalesce(max(value_number) FILTER (fact_key = 'order_total'), 0) AS order_total, coalesce(max(value_text) FILTER (fact_key = 'order_status'), '') AS order_status, 'none' AS order_owner FROM b GROUP BY 1""")
def p4_project_entity(t: Tables):
    return U.project_entity(W.best_fact(t.facts, {}), {"order_total": ("number", 0.0), "order_status": ("text", ""), "order_owner": ("text", "none")})


@query("SELECT DISTINCT entity_id, bhk FROM (SELECT entity_id, CASE WHEN bhk > 0 THEN bhk END AS bhk, max(bhk) OVER (PARTITION BY entity_id) AS top FROM listings) WHERE bhk IS NOT NULL OR top = 0")
def p5_representative_rows(t: Tables):
    return U.representative_rows(t.listings.select("entity_id", F.concat(F.when(F.col("bhk") % 2 == 0, "listing_").otherwise("pricing_"), F.col("bhk").cast("string"), F.lit("bhk")).alias("fact_key")).withColumn("fact_key", F.replace("fact_key", F.lit("_0bhk"), F.lit("_none"))))


@query("""WITH l AS (SELECT * FROM listings WHERE price > 0 AND area_sqft > 0 AND bhk > 0) SELECT entity_id, fact_key, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT entity_id, 'listing_price' AS fact_key, price AS v FROM l UNION ALL SELECT entity_id, 'listing_area', area_sqft FROM l UNION ALL SELECT entity_id, 'price_per_sqft', floor(price / area_sqft) FROM l UNION ALL SELECT entity_id, 'bedrooms', bhk FROM l UNION ALL SELECT entity_id, concat('listing_', bhk, 'bhk'), price FROM l) GROUP BY ALL""")
def p6_listing_facts(t: Tables):
    return U.listing_facts(t.listings).groupBy("entity_id", "fact_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_number"), 2).alias("total"))


@query("SELECT fact_key, count(*) AS n, round(sum(v), 2) AS total, 0.68 AS confidence FROM (SELECT 'rent_monthly' AS fact_key, price AS v FROM listings UNION ALL SELECT 'rent_yearly', price * 12 FROM listings UNION ALL SELECT 'rent_deposit', price * 2 FROM listings UNION ALL SELECT 'rent_area', area_sqft FROM listings) GROUP BY 1".replace("0.68 AS", "0.68::DOUBLE AS"))
def p7_rent_facts(t: Tables):
    return U.rent_facts(t.listings).groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_number"), 2).alias("total"), F.max("confidence").alias("confidence"))


@query("SELECT entity_id, count(*) AS n FROM (SELECT entity_id FROM facts UNION ALL SELECT concat('alias:', entity_id) FROM facts WHERE entity_id LIKE '%7') GROUP BY 1")
def p8_review_facts(t: Tables):
    aliases = t.entities.filter("entity_id LIKE 'customer:%7'").select("entity_id", F.concat(F.lit("alias:"), "entity_id").alias("alias"))
    return U.with_alias_copies(t.facts, aliases).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('supplier:', s_suppkey) AS entity_id, k AS fact_key, CASE k WHEN 'station_name' THEN s_name WHEN 'line' THEN concat('line ', s_nationkey) ELSE 'open' END AS value_text FROM supplier, (VALUES ('station_name'), ('line'), ('status')) AS v(k) WHERE NOT (k = 'status' AND s_acctbal < 0)")
def p9_station_facts(t: Tables):
    keys = {"station_name": F.col("s_name"), "line": X.normalize_name(F.concat(F.lit("Line-"), F.col("s_nationkey").cast("string"))), "status": F.when(F.col("s_acctbal") >= 0, "open")}
    return U.unpivot(t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), "*"), "id", keys, "transit", 0.8).select("entity_id", "fact_key", "value_text")


@query("SELECT entity_id, fact_key, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT concat('part:', l_partkey) AS entity_id, 'access' AS fact_key, l_quantity AS v FROM lineitem UNION ALL SELECT concat('supplier:', l_suppkey), 'access_of', l_quantity FROM lineitem) GROUP BY ALL")
def p10_access_facts(t: Tables):
    rows = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("a"), F.concat(F.lit("supplier:"), "l_suppkey").alias("b"), "l_quantity", "l_discount")
    return U.two_sided_facts(rows, "a", "b", "access", F.col("l_quantity"), F.col("l_discount")).groupBy("entity_id", "fact_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_number"), 2).alias("total"))


@query("SELECT entity_id, fact_key, value_number FROM (SELECT zone_id AS entity_id, 'within' AS fact_key, round(x0, 4) AS value_number FROM zones UNION ALL SELECT concat('region:', CAST(split_part(zone_id, ':', 2) AS INT) % 5), 'within_of', round(x0, 4) FROM zones)")
def p11_structure_facts(t: Tables):
    rows = t.zones.withColumn("parent", F.concat(F.lit("region:"), F.split_part("zone_id", F.lit(":"), F.lit(2)).cast("int") % 5))
    return U.two_sided_facts(rows, "zone_id", "parent", "within", F.round("x0", 4), F.lit(0.9)).select("entity_id", "fact_key", "value_number")


@query("SELECT concat('part:', p_partkey) AS entity_id, k AS fact_key, CASE k WHEN 'brand' THEN p_brand WHEN 'kind' THEN p_type ELSE CAST(p_size AS STRING) END AS value_text FROM part, (VALUES ('brand'), ('kind'), ('size')) AS v(k)")
def p12_registry_facts(t: Tables):
    keys = {"brand": F.col("p_brand"), "kind": F.col("p_type"), "size": F.col("p_size")}
    return U.unpivot(t.part.withColumn("id", F.concat(F.lit("part:"), "p_partkey")), "id", keys, "registry", 0.95).select("entity_id", "fact_key", "value_text")


@query("SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS normalized, min(p_type) AS name, count(*) AS seeds, concat('area:', sha256(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')))[1:16]) AS entity_id FROM part GROUP BY 1")
def p13_seed_facts(t: Tables):
    return U.seed_areas(t.part.select(F.col("p_type").alias("area")))


@query("""SELECT event_id, key AS predicate, value FROM (SELECT event_id, unnest([struct_pack(key := 'event_type', value := event_type), struct_pack(key := 'user_id', value := CAST(user_id AS STRING))], recursive := true) FROM events)""")
def p14_detail_claims(t: Tables):
    made = t.events.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("j"))
    return U.parse_json_claims(made, "event_id", "j", "event_type string, user_id long, missing string", ["event_type", "user_id", "missing"])


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS lo, l_extendedprice * 1.5::DOUBLE AS hi FROM lineitem WHERE l_discount < 0.05")
def p15_parse_inventory(t: Tables):
    hi = F.when(F.col("l_discount") < 0.05, F.col("l_extendedprice") * 1.5).otherwise(F.col("l_extendedprice") * 0.5)
    payload = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.to_json(F.struct(F.col("l_extendedprice").alias("lo"), hi.alias("hi"))).alias("payload"))
    return payload.select("k", "n", F.from_json("payload", "lo double, hi double").alias("j")).select("k", "n", "j.*").filter("lo > 0 AND hi >= lo")


@query("""SELECT p_partkey AS k, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE p_size % 2 WHEN 0 THEN 'registry' ELSE 'other_source' END AS source, p_name AS stripped, sha256(upper(p_brand)) AS registration FROM part""")
def p16_names(t: Tables):
    """P16 normalisation, P17 slug, P18 source codes, P19 phase suffix, P41 registration identity."""
    source = F.when(F.col("p_size") % 2 == 0, " State-Registry ").otherwise("Other  source")
    return t.part.select(F.col("p_partkey").alias("k"), X.normalize_name(F.col("p_type")).alias("name"), X.slug(F.col("p_brand")).alias("slug"), X.normalize_source(source, {"state_registry": "registry"}).alias("source"), X.strip_phase(F.concat("p_name", F.lit(" (Phase-III)"))).alias("stripped"), X.registration_id(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))).alias("registration"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 10000000 WHEN 1 THEN 100000 WHEN 2 THEN 1000 ELSE 1 END AS amount,
    CASE l_linenumber % 5 WHEN 0 THEN l_quantity * 1000 + 4 WHEN 1 THEN l_quantity * 100 WHEN 4 THEN NULL ELSE l_quantity END AS lo,
    CASE l_linenumber % 5 WHEN 0 THEN l_quantity * 1000 + 482 WHEN 1 THEN (l_quantity + 1) * 100 WHEN 2 THEN l_quantity WHEN 3 THEN l_quantity + 2 END AS hi,
    CASE l_linenumber % 5 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / 1000 WHEN 4 THEN 0 END AS km,
    CASE l_linenumber % 4 WHEN 0 THEN greatest(l_quantity, 110) WHEN 1 THEN greatest(l_quantity, 1) WHEN 2 THEN (l_quantity * 1000 + 1) / 1000 END AS top FROM lineitem""")
def p20_quantities(t: Tables):
    """P20 money, P21 ranges, P22 distances, P46 the highest tag: with thousands separators, crores, signs, mixed units and what can't be read."""
    more = lambda x: F.round(F.col("l_quantity") + x).cast("long").cast("string")
    q, n = more(0), F.col("l_linenumber")

    def pick(*texts):  # only the text that is picked is made
        made = None
        for i, x in enumerate(texts):
            x = F.lit(x) if isinstance(x, str) else x
            made = F.when(n % len(texts) == i, x) if made is None else made.when(n % len(texts) == i, x)
        return made

    money = F.concat(q, pick(" Cr", " lakh", "k", ""))
    far = pick(F.concat(F.lit("about "), q, F.lit(" km away")), F.concat(q, F.lit(" metres")), F.concat(q, F.lit(" km or 5 m")), F.concat(F.lit("-"), q, F.lit(" km")), "0 km")
    between = X.parse_range(pick(F.concat(q, F.lit(",004-"), q, F.lit(",482")), F.concat(q, F.lit("-"), more(1), F.lit(" Cr")), q, F.concat(F.lit("from "), q, F.lit(" by 3 to "), more(2)), "on request"), 100.0)
    tags = pick(F.concat(q, F.lit("kV;110000")), F.concat(q, F.lit(";1")), F.concat(F.lit("low; "), q, F.lit("001 ")), "unknown")
    return t.lineitem.select(F.col("l_orderkey").alias("k"), n.alias("n"), X.parse_amount(money).alias("amount"), between["lo"].alias("lo"), between["hi"].alias("hi"), X.parse_distance_km(far).alias("km"), X.max_tag_value(tags).alias("top"))


_AMOUNT = "CASE WHEN {0} >= 1e7 THEN concat(regexp_replace(format('{{:.2f}}', {0} / 1e7), '\\.?0+$', ''), ' Cr') WHEN {0} >= 1e5 THEN concat(regexp_replace(format('{{:.2f}}', {0} / 1e5), '\\.?0+$', ''), ' L') ELSE format('{{:.0f}}', {0}) END"


@query(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN {_AMOUNT.format('v')} ELSE concat({_AMOUNT.format('v')}, ' - ', {_AMOUNT.format('(v * 20)')}) END AS shown, concat('Priced ', regexp_replace(format('{{:.1f}}', v), '\\.?0+$', '')) AS rendered FROM (SELECT o_orderkey, floor(o_totalprice) + 0.2::DOUBLE AS v FROM orders)")
def p23_display(t: Tables):
    """P23 amounts and ranges, P24 templates."""
    v = F.floor("o_totalprice") + F.lit(0.2)
    return t.orders.select(F.col("o_orderkey").alias("k"), X.display_range(v, F.when(F.col("o_orderkey") % 2 == 0, v).otherwise(v * 20)).alias("shown"), X.render(F.lit("Priced {value}"), v).alias("rendered"))


@query("SELECT o_orderkey AS k, concat('fact:', sha256(concat_ws(chr(31), o_custkey, o_orderstatus))) AS id FROM orders")
def p25_content_id(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("k"), X.content_id("fact:", F.col("o_custkey"), F.col("o_orderstatus")).alias("id"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 2 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING)[1:7], '-01') END AS day FROM orders")
def p26_parse_time(t: Tables):
    d = F.to_date("o_orderdate").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(d, F.lit("T10:00:00Z"))).when(F.col("o_orderkey") % 4 == 1, d).when(F.col("o_orderkey") % 4 == 2, F.substring(d, 1, 7)).otherwise("soon")
    return t.orders.select(F.col("o_orderkey").alias("k"), F.to_date(X.parse_time(raw)).cast("string").alias("day"))


_SIGNED = r"\nResidential Address: 5 Hill\n Signed by Anil\nANIL RAO and anil, PAN abcde1234f, A/c no: 12AB-778, Anilrao\nSignature by X"


def _redacted(c: str) -> str:
    """The rules one by one, names longest first."""
    rules = [(r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "[mail]"), (r"(?i)\b[a-z]{5}[0-9]{4}[a-z]\b", "[identifier]"), (r"(?i)\b(account|a/c)\s*(no\.?|number)?\s*[:#-]?\s*[a-z0-9-]{6,}\b", "[account]"), (r"(^|[^0-9])\+?[0-9][0-9 ()-]{7,}[0-9]", r"\1[phone]"), ("(?i)anil rao", "[name]"), ("(?i)anil", "[name]"), (r"(?im)^[ \t]*((residential )?address[ \t]*:|(signed|signature)[ \t]*(by)?[ \t]*:?).*$", "[line]")]
    for pattern, instead in rules:
        c = f"regexp_replace({c}, '{pattern}', '{instead}', 'g')"
    return c


@query(f"SELECT doc_id, sha256({_redacted(f"concat(text, '{_SIGNED}')".replace(chr(92) + 'n', "', chr(10), '"))}) AS redacted FROM documents")
def p27_redact(t: Tables):
    """P27 on the documents, each with an address, signatures, names in another order and case, and identifiers behind it."""
    text = F.concat("text", F.lit(_SIGNED.replace("\\n", "\n")))
    return t.documents.select("doc_id", F.sha2(X.redact(text, ["Anil", "Anil Rao"]), 256).alias("redacted"))


@query("SELECT count(*) AS n, fact_key FROM facts WHERE fact_key LIKE 'order\\_%' ESCAPE '\\' AND fact_key LIKE '%t%' GROUP BY fact_key")
def p31_key_matches(t: Tables):
    return t.facts.filter(X.key_matches(F.col("fact_key"), "order_*") & X.key_matches(F.col("fact_key"), "*t*")).groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, round(2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km, round(greatest(0, least(1, (20 - 2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))) / 15)), 6) AS near, round(0.5 + 0.5 * lat / (1 + abs(lat)), 6) AS sat FROM (SELECT *, pow(sin((radians(13.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(13.0)) * pow(sin(radians(77.6 - lon) / 2), 2) AS h FROM subjects)""")
def p32_distances(t: Tables):
    """P32 great-circle distance, P33 decay, P34 saturation."""
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(13.0), F.lit(77.6))
    return t.subjects.select("id", F.round(km, 6).alias("km"), F.round(geo.decay(km, 5.0, 20.0), 6).alias("near"), F.round(V.saturate(F.col("lat")), 6).alias("sat"))


@query("""SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def p35_cosine(t: Tables):
    a = t.embeddings.select("vec_id", "embedding")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query()
def p36_hash_embed(t: Tables):
    """The hash is Spark's own; tested for length 1 and equal vectors of equal texts."""
    return V.hash_embed(t.documents.select("doc_id", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("tokens")), "doc_id", "tokens")


@query("SELECT src, CASE edge_type WHEN 'located_in' THEN 'in_area' WHEN 'part_of' THEN 'in_area' ELSE edge_type END AS edge_type, dst FROM edges WHERE edge_type <> 'bought'")
def p37_map_edge_types(t: Tables):
    kinds = t.spark.createDataFrame([("located_in", "in_area"), ("part_of", "in_area")], "edge_type string, serving string")
    return t.edges.filter("edge_type <> 'bought'").join(kinds, "edge_type", "left").select("src", F.coalesce("serving", "edge_type").alias("edge_type"), "dst")


@query("SELECT l_orderkey AS k, l_linenumber AS n, round((r - 2.5) / 2.5, 6) AS score, CASE WHEN (r - 2.5) / 2.5 >= 0.4 THEN 'positive' WHEN (r - 2.5) / 2.5 <= -0.2 THEN 'concern' ELSE 'mixed' END AS band FROM (SELECT *, l_quantity / 10 AS r FROM lineitem)")
def p39_sentiment(t: Tables):
    score, band = V.sentiment(F.col("l_quantity") / 10)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(score, 6).alias("score"), band.alias("band"))


@query("SELECT p_partkey AS k, CASE WHEN p_type LIKE '%STEEL%' THEN 'metal' WHEN p_brand LIKE '%1%' THEN 'first' WHEN p_name LIKE '%a%' THEN 'named' ELSE 'other' END AS x FROM part".replace("x FROM", "role FROM"))
def p45_classify_documents(t: Tables):
    made = t.part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_type").contains("STEEL"), "m").alias("label"), F.when(F.col("p_brand").contains("1"), "f").alias("field"), F.when(F.col("p_name").contains("a"), "n").alias("link"))
    return U.classify_documents(made, {"metal": "^m$", "first": "^f$", "named": "^n$"}, ["label", "field", "link"]).select("k", "role")


@query("""WITH i AS (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 'floor plan' WHEN 1 THEN 'Location' WHEN 2 THEN 'logo' WHEN 3 THEN 'Tower' ELSE '' END AS alt, l_quantity * 20 AS w, l_linenumber * 100 AS h FROM lineitem), k AS (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'map' WHEN 2 THEN 'logo' WHEN 3 THEN 'exterior' ELSE 'photo' END AS kind FROM i)
    SELECT kind, count(*) AS n, round(sum(round(least(1, least(1, w * h / 1000000) * 0.8::DOUBLE + CASE WHEN l_returnflag = 'N' THEN 0.2::DOUBLE ELSE 0 END), 6)), 3) AS quality, round(max(CASE WHEN kind = 'logo' THEN 0 ELSE CASE WHEN kind = 'exterior' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN length(alt) > 0 THEN 0.2::DOUBLE ELSE 0 END END), 6) AS relevance FROM k GROUP BY 1""")
def p38_score_images(t: Tables):
    alt = F.element_at(F.array(F.lit("floor plan"), F.lit("Location"), F.lit("logo"), F.lit("Tower"), F.lit("")), F.col("l_linenumber") % 5 + 1)
    images = t.lineitem.select(F.lit("https://x.example/1.jpg").alias("url"), alt.alias("alt"), (F.col("l_quantity") * 20).alias("width"), (F.col("l_linenumber") * 100).alias("height"), F.when(F.col("l_returnflag") == "N", "official").otherwise("other").alias("source"))
    return U.score_images(images).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quality"), 3).alias("quality"), F.max("relevance").alias("relevance"))


@query("WITH m AS (SELECT concat('part:', l_partkey) AS entity_id, string_agg(u, ' ' ORDER BY g, u) AS value_text FROM (SELECT l_partkey, l_linenumber AS g, concat('img', l_orderkey) AS u FROM lineitem) GROUP BY l_partkey) SELECT entity_id, value_text FROM m UNION ALL SELECT concat('alias:', entity_id), value_text FROM m WHERE entity_id LIKE '%5'")
def p40_media_facts(t: Tables):
    images = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.col("l_linenumber").alias("gallery_order"), F.concat(F.lit("img"), "l_orderkey").alias("image_url"))
    aliases = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("entity_id")).filter("entity_id LIKE '%5'").withColumn("alias", F.concat(F.lit("alias:"), "entity_id"))
    return U.media_facts(images, aliases).select("entity_id", "value_text")


@query("SELECT o_orderkey AS k, concat('record:', sha256(concat_ws(chr(31), o_custkey, o_orderstatus, o_orderpriority))) AS record_id FROM orders WHERE o_orderkey % 4 <> 0")
def p42_source_records(t: Tables):
    rows = t.orders.withColumn("label", F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise("x"))
    return U.source_records(rows, ["label", "o_orderstatus"], ["o_custkey", "o_orderstatus", "o_orderpriority"]).select(F.col("o_orderkey").alias("k"), "record_id")


@query("SELECT concat('part:', l_partkey) AS entity_id, concat('pricing_', l_linenumber, 'bhk') AS fact_key, l_quantity * 100 AS low, (l_quantity + 5) * 100 AS high, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 AND (l_quantity + 5) / (l_linenumber * 10) * 1.35::DOUBLE >= 1 AND l_quantity / (l_linenumber * 10) * 0.65::DOUBLE <= 1.5 GROUP BY ALL")
def p44_pricing_facts(t: Tables):
    q = F.format_string("%.0f", F.col("l_quantity"))
    price = F.when(F.col("l_linenumber") == 7, "on request").otherwise(F.concat(q, F.lit("-"), F.format_string("%.0f", F.col("l_quantity") + 5), F.lit(" Cr")))
    conf = F.array(F.struct(F.col("l_linenumber").alias("bhk"), price.alias("price"), (F.col("l_linenumber") * 10.0).alias("area")))
    payloads = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.lit(100.0).alias("rate_low"), F.lit(150.0).alias("rate_high"), F.to_json(F.struct(conf.alias("configurations"))).alias("payload"))
    return U.pricing_facts(payloads).groupBy("entity_id", "fact_key", "low", "high").agg(F.count(F.lit(1)).alias("n"))
