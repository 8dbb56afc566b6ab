"""Queries of scores and recommendations."""

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import recall as C
from ..operators import scoring as R
from ..operators import spatial as S
from .joins import _KM, _pairs  # noqa: F401
from .registry import Tables, query


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity >= 40 THEN least(2, l_tax * 30) WHEN l_quantity >= 20 THEN least(2, l_tax * 30) / 2 ELSE 0 END ELSE CASE WHEN l_quantity <= 10 THEN least(2, l_tax * 30) WHEN l_quantity <= 30 THEN least(2, l_tax * 30) / 2 ELSE 0 END END AS score FROM lineitem")
def r1_evidence_score(t: Tables):
    up = F.col("l_returnflag") == "N"
    score = R.evidence_score(F.col("l_quantity"), F.when(up, "higher").otherwise("lower"), F.when(up, F.array(F.lit(40.0), F.lit(20.0))).otherwise(F.array(F.lit(10.0), F.lit(30.0))), F.col("l_tax") * 30)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), score.alias("score"))


@query("""SELECT entity_id, coalesce(max(CASE WHEN confidence > 0.95 THEN -1.5 WHEN value_number <= 50000 THEN 1.5 WHEN value_number <= 150000 THEN 0.75 WHEN value_number IS NOT NULL THEN -1.5 WHEN contains(lower(value_text), 'urgent') THEN -1.5 WHEN contains(lower(value_text), 'low') THEN 1.5 END), -1.2) AS score FROM entities LEFT JOIN facts USING (entity_id) WHERE entity_type IN ('customer', 'nation') GROUP BY 1""")
def r2_risk_score(t: Tables):
    score = R.risk_score(F.col("value_text"), F.col("value_number"), F.col("confidence") > 0.95, (50000, 150000), 1.5, ["urgent"], ["low"])
    j = t.entities.filter("entity_type IN ('customer', 'nation')").join(t.facts, "entity_id", "left")
    return j.groupBy("entity_id").agg(F.max(score).alias("s")).select("entity_id", R.with_no_data_penalty(F.col("s")).alias("score"))


_CLAMPED = "greatest(0, least(1, coalesce({}, 0)))"


@query(f"""SELECT s_suppkey, round(0.75::DOUBLE * {_CLAMPED.format("rating / 5")} + 0.25::DOUBLE * {_CLAMPED.format("ln(1 + n) / 8")}, 6) AS score
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 < 6 THEN CAST(s_suppkey % 9 - 1 AS DOUBLE) END AS rating, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * s_suppkey * s_suppkey END AS n FROM supplier)""")
def r3_review_score(t: Tables):
    """R3 with ratings and counts that are missing or out of range."""
    rating, n = F.when(F.col("s_suppkey") % 7 < 6, (F.col("s_suppkey") % 9 - 1).cast("double")), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey") * F.col("s_suppkey") * F.col("s_suppkey"))
    return t.supplier.select("s_suppkey", F.round(R.review_score(rating, n), 6).alias("score"))


@query("""SELECT entity_id, round(max(confidence * CASE WHEN fact_key = 'order_total' AND version = 0 THEN greatest(0, least(1, (5 - value_number / 50000) / 4.5::DOUBLE)) WHEN fact_key = 'order_total' AND version = 1 THEN least(1, value_number / 400000)
    WHEN fact_key = 'order_total' AND version = 2 THEN CASE WHEN value_number > 200000 THEN 1 ELSE 0 END WHEN fact_key = 'order_total' THEN -1 ELSE CASE WHEN version = 3 THEN 0 ELSE 0.5::DOUBLE END END), 6) AS access
    FROM facts WHERE fact_key IN ('order_total', 'order_status') AND NOT (fact_key = 'order_total' AND version = 3) GROUP BY 1""")
def r4_access_score(t: Tables):
    """R4 over facts of every kind: distances, shares, truth values, texts and empty texts."""
    total, v = F.col("fact_key") == "order_total", F.col("version")
    facts = t.facts.select(
        "entity_id", "confidence", F.when(total, F.concat(F.lit("Access_"), v)).otherwise(F.col("fact_key")).alias("fact_key"), F.when(total & (v == 2), "bool").otherwise(F.col("value_type")).alias("value_type"),
        F.when(total, (F.col("value_number") > 200000).cast("string")).when(v == 3, "  ").otherwise(F.col("value_text")).alias("value_text"),
        F.when(total, F.when(v == 0, F.col("value_number") / 50000).when(v == 1, F.col("value_number") / 400000).otherwise(-1.0)).alias("value_number"),
    )
    return R.access_score(facts, ["access_0", "ACCESS_1", "access_2", "order_status"], ["access_0"]).withColumn("access", F.round("access", 6))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount > 0.03 THEN greatest(0.2::DOUBLE, least(0.45::DOUBLE, 0.6::DOUBLE * (l_discount * 10))) WHEN l_tax > 0.04 THEN 0.1 WHEN l_linenumber > 2 THEN 0.01 ELSE 0 END AS floor FROM lineitem")
def r5_evidence_floor(t: Tables):
    positive = F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 10).otherwise(0.0)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), R.evidence_floor(positive, F.when(F.col("l_tax") > 0.04, 1).otherwise(0), F.when(F.col("l_linenumber") > 2, 1).otherwise(0)).alias("floor"))


@query(f"SELECT left_id, count(*) AS categories, round(avg(s), 6) AS score FROM (SELECT left_id, category, max(1 / (1 + km)) AS s FROM {_pairs('5.0', more=', category')} GROUP BY ALL) GROUP BY 1")
def r6_multi_place_score(t: Tables):
    near = S.knn_join(t.subjects, t.places, 1, within=5.0, by="category").withColumn("km", F.round("km", 6))  # a category's best is its nearest
    return R.multi_place_score(near)


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS area, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal + 2000 END AS price, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 END AS coverage, CASE WHEN s_suppkey % 2 = 0 THEN 1 END AS present, CASE WHEN s_suppkey % 5 = 0 THEN 1 END AS risk FROM supplier),
    m AS (SELECT area, price AS median FROM (SELECT area, price, row_number() OVER (PARTITION BY area ORDER BY price) AS r, count(*) OVER (PARTITION BY area) AS n FROM s WHERE price IS NOT NULL) WHERE r = CAST(floor(n / 2) AS INT) + 1),
    g AS (SELECT id, CASE WHEN price / median <= 0.85 THEN 1.0::DOUBLE WHEN price / median <= 1 THEN 0.75::DOUBLE WHEN price / median <= 1.12 THEN 0.45::DOUBLE WHEN price IS NOT NULL THEN 0.2::DOUBLE END AS p, coverage AS c, present AS e, 1 - risk AS k FROM s LEFT JOIN m USING (area))
    SELECT id, round(CASE WHEN p IS NOT NULL OR c IS NOT NULL OR e IS NOT NULL OR k IS NOT NULL THEN (coalesce(p * 0.4::DOUBLE, 0) + coalesce(c * 0.3::DOUBLE, 0) + coalesce(e * 0.2::DOUBLE, 0) + coalesce(k * 0.1::DOUBLE, 0)) / (CASE WHEN p IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN e IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN k IS NULL THEN 0 ELSE 0.1::DOUBLE END) END, 6) AS score FROM g""")
def r7_policy_score(t: Tables):
    k = F.col("s_suppkey")
    rows = t.supplier.select(k.alias("id"), F.col("s_nationkey").alias("area"), F.when(k % 7 != 0, F.col("s_acctbal") + 2000).alias("price"), F.when(k % 3 == 0, 0.5).alias("coverage"), F.when(k % 2 == 0, 1).alias("present"), F.when(k % 5 == 0, 1).alias("risk"))
    return R.policy_score(rows, {"price": 0.4, "coverage": 0.3, "present": 0.2, "risk": 0.1})


@query("SELECT p_partkey, round((least(1, p_size / 50) * 2 + CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END) * 100 / 3, 6) AS score FROM part")
def r8_transparency(t: Tables):
    return t.part.select("p_partkey", F.round(R.transparency({"size": (F.col("p_size") / 50, 2.0), "brand": (F.when(F.col("p_brand").endswith("1"), 1.0), 1.0)}), 6).alias("score"))


def _channels(t: Tables):
    """Each channel with its best candidates only: the ten lowest ids of an area, as all score alike there, and the twenty nearest within 8 km by the score as it is rounded."""
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("area"), F.array(F.lit("")).alias("alike"))
    same = C.equal_value(s, s, "area", 10).select("anchor", "candidate", F.lit(0.5).alias("score"))
    places = t.places.select(F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("id"), "lat", "lon")
    share = lambda km: F.round(1 - km / 8, 6)
    near = S.knn_join(places, places, 21, within=8.0, order=lambda km: -share(km), slack=1e-5).filter("left_id <> right_id")
    return {"area": same, "near": near.select(F.col("left_id").alias("anchor"), F.col("right_id").alias("candidate"), share(F.col("km")).alias("score"))}


_CH = f"""a AS (SELECT x.s_suppkey AS anchor, y.s_suppkey AS candidate, 0.5::DOUBLE AS score FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey), n AS (SELECT CAST(split_part(left_id, ':', 2) AS BIGINT) AS anchor, CAST(split_part(right_id, ':', 2) AS BIGINT) AS candidate, round(1 - raw / 8, 6) AS score FROM (SELECT a.id AS left_id, b.id AS right_id, {_KM} AS raw FROM (SELECT id, lat, lon FROM places) a, (SELECT id, lat, lon FROM places) b, (SELECT 0) z(q) , LATERAL (SELECT pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h) WHERE a.id <> b.id) WHERE raw <= 8),
    u AS (SELECT *, 'area' AS channel FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate) <= 10) UNION ALL SELECT *, 'near' FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate) <= 20)),
    rc AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate) AS rank FROM (SELECT anchor, candidate, round(sum(score), 6) AS score, string_agg(channel, '+' ORDER BY channel) AS channels FROM u GROUP BY ALL) QUALIFY rank <= 12)"""


@query(f"WITH {_CH} SELECT anchor, candidate, score, channels, rank FROM rc")
def r9_recall_candidates(t: Tables):
    return R.recall_candidates(_channels(t), {"area": 10, "near": 20}, 12).withColumn("rank", F.col("rank").cast("long"))


_OFFERS = """SELECT concat('part:', p_partkey) AS id, p_type AS area, CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS builder, CASE WHEN p_partkey % 13 > 0 THEN CAST(floor(p_retailprice * 100) AS BIGINT) ELSE 0 END AS price, 12.8 + CAST(p_partkey * 37 % 997 AS DOUBLE) / 2500 AS lat, 77.4 + CAST(p_partkey * 91 % 1009 AS DOUBLE) / 2500 AS lon,
    concat(p_name, ' ', p_type) AS text, p_partkey % 2 AS listing, CASE p_partkey % 3 WHEN 0 THEN 'Flat' WHEN 1 THEN 'apartment' ELSE 'villa' END AS kind, p_partkey % 100 = 0 AS asked FROM {part}"""
_LOWEST = "QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY i.id) <= {}"
_PAIR = "FROM a JOIN i ON a.id <> i.id AND a.listing = i.listing AND a.grp = i.grp"
_OFFER_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: len(x) >= 2)"
_OFFER_KM = _KM.replace("a.", "p.").replace("b.", "q.")


@query(f"""WITH i AS (SELECT *, CASE WHEN kind = 'villa' THEN 'villa' ELSE 'flat' END AS grp FROM ({_OFFERS.format(part="part")})), a AS (SELECT * FROM i WHERE asked),
    area AS (SELECT a.id AS anchor, i.id AS candidate, 0.4::DOUBLE AS score, 'area' AS channel, true AS recall {_PAIR} AND lower(a.area) = lower(i.area) {_LOWEST.format(40)}),
    builder AS (SELECT a.id, i.id, 0.3::DOUBLE, 'builder', true {_PAIR} AND lower(a.builder) = lower(i.builder) {_LOWEST.format(30)}),
    price AS (SELECT a.id, i.id, 0.2::DOUBLE, 'price', false {_PAIR} AND a.price > 0 AND i.price > 0 AND i.price BETWEEN ceil(a.price * 0.9::DOUBLE) AND floor(a.price * 1.1::DOUBLE) {_LOWEST.format(60)}),
    e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'supplied_by'),
    shared AS (SELECT DISTINCT x.src AS anchor, y.src AS candidate FROM e x JOIN e y USING (dst)),
    neighbor AS (SELECT a.id, i.id, 0.5::DOUBLE, 'neighbor', true {_PAIR} JOIN shared ON anchor = a.id AND candidate = i.id {_LOWEST.format(30)}),
    far AS (SELECT p.id AS pid, q.id AS qid, {_OFFER_KM} AS km FROM a p JOIN i q ON p.id <> q.id, LATERAL (SELECT pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2) AS h)),
    nearest AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY pid ORDER BY km, qid) <= 40),
    spatial AS (SELECT a.id, i.id, 0.4::DOUBLE * round(1 - km / 8, 6), 'spatial', true {_PAIR} JOIN nearest ON pid = a.id AND qid = i.id AND km < 8),
    k AS (SELECT id, len({_OFFER_TOKENS}) AS length, unnest({_OFFER_TOKENS}) AS token FROM i), tf AS (SELECT id, length, token, count(*) AS tf FROM k GROUP BY ALL), c AS (SELECT count(*) AS docs, avg(len({_OFFER_TOKENS})) AS mean FROM i),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT DISTINCT id AS q, token FROM k WHERE id IN (SELECT id FROM a)), terms AS (SELECT q, count(*) AS terms FROM s GROUP BY 1),
    hit AS (SELECT q, id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM s JOIN tf USING (token) JOIN df USING (token) JOIN terms USING (q), c GROUP BY q, id HAVING count(*) = max(terms)),
    top AS (SELECT *, greatest(1, max(score) OVER (PARTITION BY q)) AS most FROM (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 30)),
    lexical AS (SELECT a.id, i.id, 0.2::DOUBLE * round(score / most, 6), 'lexical', true {_PAIR} JOIN top ON top.q = a.id AND top.id = i.id),
    u AS (SELECT * FROM area UNION ALL SELECT * FROM builder UNION ALL SELECT * FROM price UNION ALL SELECT * FROM neighbor UNION ALL SELECT * FROM spatial UNION ALL SELECT * FROM lexical)
    SELECT anchor, candidate, round(sum(score), 6) AS score, string_agg(channel, '+' ORDER BY channel) AS channels, row_number() OVER (PARTITION BY anchor ORDER BY round(sum(score), 6) DESC, candidate) AS rank FROM u GROUP BY anchor, candidate HAVING bool_or(recall) QUALIFY rank <= 80""")
def r9_recall_channels(t: Tables):
    """R9 by all six channels, of which the price band can't admit; anchors are the parts whose id is divisible by 100, against all."""
    offers = t.spark.sql(_OFFERS, part=t.part)
    channels = [
        C.Channel("area", "area", 0.4, 40), C.Channel("builder", "builder", 0.3, 30), C.Channel("price", "price", 0.2, 60, recall=False, low=0.9, high=1.1),
        C.Channel("neighbor", "neighbor", 0.5, 30, edge_types=("supplied_by",)), C.Channel("spatial", "spatial", 0.4, 40, km=8.0), C.Channel("lexical", "lexical", 0.2, 30),
    ]
    found = C.recall(offers.filter("asked"), offers, channels, 80, t.edges, [F.col("listing"), C.type_group(F.col("kind"), [["flat", "apartment"]])])
    return found.withColumn("rank", F.col("rank").cast("long"))


@query()
def r10_pick_branches(t: Tables):
    """Greedy across lenses: tested against a plain loop."""
    c = R.recall_candidates(_channels(t), {"area": 10, "near": 20}, 12)
    c = c.select("anchor", "candidate", "score", (F.col("candidate") % 6).alias("grp"), (F.col("score") - 0.4).alias("closer"), ((F.col("candidate") % 10) / 10).alias("cheaper"))
    return R.pick_branches(c, ["closer", "cheaper"], 0.2, 3, 5)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, floor(((b.s_acctbal + 2000) / (a.s_acctbal + 2000) - 1) * 10000 + 0.5::DOUBLE) / 100 AS price_percent, b.s_suppkey % 9 - a.s_suppkey % 9 AS evidence_delta FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def r11_contrast(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + 2000).alias("price"), (F.col("s_suppkey") % 9).alias("evidence"))
    pairs = s.select(F.col("id").alias("a"), F.col("price").alias("a_price"), F.col("evidence").alias("a_evidence"), (F.col("id") + 1).alias("b")).join(s.select(F.col("id").alias("b"), F.col("price").alias("b_price"), F.col("evidence").alias("b_evidence")), "b")
    return R.contrast(pairs).select("a", "b", "price_percent", "evidence_delta")


@query("SELECT listing_id, kind, CASE WHEN kind = 'N' AND price BETWEEN 20000 AND 30000 THEN 'exact' WHEN kind = 'N' AND price BETWEEN 20000 / 1.25::DOUBLE AND 30000 * 1.25::DOUBLE THEN 'wider budget' WHEN kind = 'R' AND price BETWEEN 20000 AND 30000 THEN 'adjacent area' ELSE 'other area' END AS relaxation FROM listings WHERE price BETWEEN 20000 AND 30000 OR (kind = 'N' AND price BETWEEN 20000 / 1.25::DOUBLE AND 30000 * 1.25::DOUBLE)")
def r12_relaxed_sets(t: Tables):
    return R.relaxed_sets(t.listings.withColumn("area", F.col("kind")), "N", 20000.0, 30000.0, ["R"], 1.25).select("listing_id", "kind", "relaxation")


def _branches(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus")
    return {"structured": o.filter("o_orderstatus = 'F'"), "lexical": o.filter("o_orderpriority LIKE '1%'"), "spatial": o.filter("id % 2 = 0")}


@query("""WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS id, 'lexical' AS channel FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, o_orderkey, 'spatial' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 'structured' FROM orders WHERE o_orderstatus = 'F')
    SELECT query_id, id, string_agg(channel, '+' ORDER BY channel) AS channels FROM c GROUP BY ALL HAVING bool_or(channel = 'spatial')""")
def r13_hybrid_recall(t: Tables):
    return R.hybrid_recall(_branches(t), ["spatial"])


@query("""WITH c AS (SELECT o_custkey AS q, o_orderkey AS id, 2 AS n, 'lexical' AS channel FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, o_orderkey, 3, 'spatial' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1, 'structured' FROM orders WHERE o_orderstatus = 'F')
    SELECT q AS query_id, channel, count(*) AS hits, count(*) FILTER (n = first) AS additions, count(*) FILTER (last = 3) AS kept FROM (SELECT *, min(n) OVER (PARTITION BY q, id) AS first, max(n) OVER (PARTITION BY q, id) AS last FROM c) GROUP BY ALL""")
def r13_recall_counts(t: Tables):
    return R.recall_counts(_branches(t), ["spatial"])


@query("SELECT listing_id, kind, bhk, CASE WHEN bhk IN (1, 3) AND price BETWEEN 20000 AND 30000 THEN 'as asked' WHEN bhk IN (1, 3) THEN 'stretch' ELSE 'beyond' END AS relaxation FROM listings WHERE price BETWEEN 20000 AND 30000 OR (bhk IN (1, 3) AND price BETWEEN 20000 / 1.25::DOUBLE AND 30000 * 1.25::DOUBLE)")
def r12_relaxed_areas(t: Tables):
    """R12 over several places, with labels of one's own and adjacent places not told apart."""
    rows = t.listings.withColumn("area", F.col("bhk").cast("string"))
    return R.relaxed_sets(rows, ["1", "3"], 20000.0, 30000.0, ["2"], 1.25, {"exact": "as asked", "wider": "stretch", "other": "beyond"}).select("listing_id", "kind", "bhk", "relaxation")


@query("""SELECT o_custkey AS query_id, o_orderkey AS id, CASE WHEN cell = asked THEN 'exact' WHEN cell % 5 = asked % 5 THEN 'locality' WHEN abs(cell - asked) <= 2 THEN 'nearby' END AS match, CASE WHEN cell <> asked AND cell % 5 <> asked % 5 AND abs(cell - asked) <= 2 THEN abs(cell - asked) END AS hops, CASE WHEN cell <> asked AND cell % 5 <> asked % 5 AND abs(cell - asked) <= 2 THEN abs(cell - asked) * 1.5::DOUBLE END AS km FROM (SELECT *, o_orderkey % 25 AS cell, o_custkey % 25 AS asked FROM orders)""")
def r14_geography_match(t: Tables):
    df = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 25).alias("cell"), (F.col("o_orderkey") % 25 % 5).alias("locality"))
    scope = t.orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_custkey") % 25).alias("cell"), (F.col("o_custkey") % 25 % 5).alias("locality")).distinct()
    near = t.nation.select(F.col("n_nationkey").cast("long").alias("seed"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d")).select("seed", (F.col("seed") + F.col("d")).alias("cell"), F.abs("d").cast("long").alias("hops"), (F.abs("d") * 1.5).alias("km"))
    return R.geography_match(df, scope, near)
