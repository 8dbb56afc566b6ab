"""Queries of the graph operators."""

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import spatial as S
from ..plans.cut import cut
from .registry import Tables, query


def _regions(t: Tables):
    return t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))


def _customers(t: Tables):
    return t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("node"))


_BOTH = "(SELECT src, edge_type, dst FROM edges UNION ALL SELECT dst, edge_type, src FROM edges)"


@query(f"SELECT DISTINCT src AS node, edge_type, dst AS neighbor FROM {_BOTH} WHERE src LIKE 'nation:%'")
def g1_neighbors(t: Tables):
    return G.neighbors(t.edges, t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("node")))


@query("SELECT DISTINCT src AS node, dst AS target FROM edges WHERE edge_type IN ('located_in', 'bought') AND src LIKE 'customer:%'")
def g2_targets_out(t: Tables):
    return G.targets_out(t.edges, _customers(t), ["located_in", "bought"])


@query("""WITH a AS (SELECT DISTINCT src AS anchor, dst AS node FROM edges WHERE edge_type = 'supplied_by'), b AS (SELECT DISTINCT anchor, dst AS node FROM a JOIN edges ON src = node AND edge_type = 'located_in'), c AS (SELECT DISTINCT anchor, dst AS node FROM b JOIN edges ON src = node AND edge_type = 'part_of')
    SELECT anchor, 1 AS step, node FROM a UNION ALL SELECT anchor, 2, node FROM b UNION ALL SELECT anchor, 3, node FROM c""")
def g3_walk(t: Tables):
    return G.walk(t.edges, t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("node")), ["supplied_by", "located_in", "part_of"])


_REACH = """RECURSIVE r(anchor, node, depth) AS (SELECT DISTINCT {start}, {start}, 0 FROM {src} UNION SELECT anchor, e.dst, depth + 1 FROM r JOIN {edges} e ON e.src = r.node WHERE depth < {depth})"""


@query("WITH " + _REACH.format(start="concat('part:', p_partkey)", src="part", edges="(SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('supplied_by', 'located_in'))", depth=3) + " SELECT anchor, node, min(depth) AS depth FROM r GROUP BY ALL")
def g4_bfs(t: Tables):
    return G.bfs(t.edges, t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("node")), ["supplied_by", "located_in"], 3)


@query("WITH " + _REACH.format(start="concat('part:', p_partkey)", src="part", edges="(SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('supplied_by', 'located_in', 'part_of'))", depth=2)
    + ", n AS (SELECT anchor, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT DISTINCT anchor, depth + 1 AS depth, src, edge_type, dst FROM n JOIN edges ON src = node AND edge_type IN ('supplied_by', 'located_in', 'part_of')")
def g4_walk_edges(t: Tables):
    return G.walk_edges(t.edges, t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("node")), ["supplied_by", "located_in", "part_of"], 3)


@query("""WITH e AS (SELECT src, dst, min(edge_type) AS rel FROM (SELECT src, dst, edge_type FROM edges WHERE edge_type IN ('part_of', 'located_in') UNION ALL SELECT dst, src, edge_type FROM edges WHERE edge_type IN ('part_of', 'located_in')) GROUP BY ALL), p AS (SELECT concat('customer:', c_custkey) AS a, concat('region:', c_custkey % 5) AS b FROM customer),
    h1 AS (SELECT a, b, dst AS n1, rel AS r1 FROM p JOIN e ON src = a), h2 AS (SELECT a, b, n1, r1, dst AS n2, rel AS r2 FROM h1 JOIN e ON src = n1)
    SELECT a, b, 2 AS hops, min(concat(a, '>', n1, '>', n2)) AS path, arg_min(concat(r1, '>', r2), concat(a, '>', n1, '>', n2)) AS relations FROM h2 WHERE n2 = b GROUP BY ALL""")
def g5_shortest_path(t: Tables):
    pairs = t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("a"), F.concat(F.lit("region:"), F.col("c_custkey") % 5).alias("b"))
    return G.shortest_path(t.edges.filter("edge_type IN ('part_of', 'located_in')"), pairs, 2)


@query("WITH " + _REACH.format(start="concat('region:', r_regionkey)", src="region", edges="(SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE edge_type <> 'bought' UNION ALL SELECT dst, src FROM edges WHERE edge_type <> 'bought'))", depth=2) + " SELECT anchor, node, min(depth) AS depth FROM r GROUP BY ALL")
def g6_subgraph(t: Tables):
    return G.bfs(t.edges.filter("edge_type <> 'bought'"), _regions(t), None, 2, directed=False)


_UP = """RECURSIVE u(node, ancestor) AS (SELECT src, dst FROM edges WHERE edge_type IN ('located_in', 'part_of') UNION SELECT node, dst FROM u JOIN edges ON src = ancestor AND edge_type IN ('located_in', 'part_of'))"""


@query(f"WITH {_UP} SELECT node, ancestor FROM u")
def g7_closure(t: Tables):
    return G.closure(t.edges, ["located_in", "part_of"])


@query(f"""WITH {_UP}, p AS (SELECT concat('customer:', c_custkey) AS a, concat('nation:', c_custkey % 25) AS b FROM customer UNION ALL SELECT concat('nation:', n_nationkey), concat('nation:', n_nationkey * 3 % 25) FROM nation)
    SELECT a, b, CASE WHEN a = b THEN 'same' WHEN EXISTS (SELECT 1 FROM u WHERE (node = a AND ancestor = b) OR (node = b AND ancestor = a)) THEN 'contained' WHEN abs(CAST(split_part(a, ':', 2) AS INT) - CAST(split_part(b, ':', 2) AS INT)) = 1 AND a LIKE 'nation%' THEN 'adjacent'
        WHEN EXISTS (SELECT 1 FROM u x JOIN u y ON x.ancestor = y.ancestor WHERE x.node = a AND y.node = b) THEN 'shared ancestor' END AS why FROM p""")
def g8_scopes_connected(t: Tables):
    nation = lambda k: F.concat(F.lit("nation:"), k)
    pairs = t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("a"), nation(F.col("c_custkey") % 25).alias("b")).unionByName(t.nation.select(nation(F.col("n_nationkey")).alias("a"), nation(F.col("n_nationkey") * 3 % 25).alias("b")))
    beside = t.nation.select(nation(F.col("n_nationkey")).alias("a"), F.explode(F.array(F.col("n_nationkey") - 1, F.col("n_nationkey") + 1)).alias("k")).select("a", nation(F.col("k")).alias("b"))
    return G.scopes_connected(pairs, G.closure(t.edges, ["located_in", "part_of"]), beside)


_TWINS = "(SELECT a.id AS a, b.id AS b FROM subjects a JOIN subjects b ON a.id < b.id AND abs(a.lat - b.lat) < 0.004 AND abs(a.lon - b.lon) < 0.004 AND pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) < 0.000009)"


@query(f"WITH RECURSIVE p AS {_TWINS}, r(node, other) AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT r.node, q.b FROM r JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) q ON q.a = r.other) SELECT node, least(node, min(other)) AS root FROM r GROUP BY node")
def g9_canonicalize(t: Tables):
    """Subjects at one place are one component: each place's least id stands for it in the pairs, so that copies don't meet all others."""
    place = F.struct(F.min("id").alias("id"), "lat", "lon")
    at = t.subjects.groupBy("lat", "lon").agg(place.alias("id")).select("id", "lat", "lon")
    near = S.radius_join(at, at, 0.5).filter("left_id.id < right_id.id AND pow(left_id.lat - right_id.lat, 2) + pow(left_id.lon - right_id.lon, 2) < 0.000009")
    copies = t.subjects.join(at.select(F.col("id.id").alias("a"), "lat", "lon"), ["lat", "lon"]).filter("a < id").select("a", F.col("id").alias("b"))
    return G.canonicalize(near.select(F.col("left_id.id").alias("a"), F.col("right_id.id").alias("b")).unionByName(copies))


@query("""WITH p AS (SELECT src, dst, CAST(split_part(dst, ':', 2) AS INT) % 4 AS provider FROM edges WHERE edge_type = 'supplied_by'), b AS (SELECT src AS a, dst AS b, CAST(split_part(dst, ':', 2) AS INT) % 4 AS provider FROM edges WHERE edge_type = 'supplied_by' UNION SELECT dst, src, CAST(split_part(src, ':', 2) AS INT) % 4 FROM edges WHERE edge_type = 'supplied_by'),
    m AS (SELECT a, provider FROM b GROUP BY ALL HAVING count(*) > 1) SELECT a AS id FROM m UNION SELECT b.b FROM b JOIN m USING (a, provider)""")
def g10_ambiguous(t: Tables):
    pairs = cut(t.edges.filter("edge_type = 'supplied_by'").select(F.col("src").alias("a"), F.col("dst").alias("b")), "ambiguous-pairs")
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    return G.ambiguous(pairs, ids.select(F.col("a").alias("id"), (F.split_part("a", F.lit(":"), F.lit(2)).cast("int") % 4).alias("provider")))


@query("""WITH m AS (SELECT concat('root', l_partkey) AS root, concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) AS id, concat('name', l_partkey % 300) AS name, l_returnflag AS category, l_linestatus AS source, l_discount AS confidence FROM lineitem),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY root ORDER BY CASE source WHEN 'O' THEN 1 ELSE 2 END, confidence DESC, id, name, category) = 1), s AS (SELECT name, count(DISTINCT category) AS c FROM m GROUP BY 1), n AS (SELECT root, category, CASE WHEN c > 1 THEN concat(name, ' (', category, ')') ELSE name END AS name FROM b JOIN s USING (name))
    SELECT root, name, concat('canonical:', sha256(concat_ws('|', category, name))[1:16]) AS entity_id FROM n""")
def g11_canonical_entities(t: Tables):
    m = t.lineitem.select(F.concat(F.lit("root"), "l_partkey").alias("root"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"), F.concat(F.lit("name"), F.col("l_partkey") % 300).alias("name"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("source"), F.col("l_discount").alias("confidence"))
    return G.canonical_entities(m, ["O"])


@query("""WITH RECURSIVE adj AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(1 + a.n_nationkey % 3 AS DOUBLE) AS km FROM nation a JOIN nation b ON abs(a.n_nationkey - b.n_nationkey) IN (1, 5)),
    r(seed, cell, hops, km) AS (SELECT r_regionkey, r_regionkey, 0, 0::DOUBLE FROM region UNION SELECT seed, b, hops + 1, r.km + adj.km FROM r JOIN adj ON a = cell WHERE hops < 3 AND r.km + adj.km <= 6)
    SELECT seed, cell, hops, min(km) AS km FROM (SELECT *, min(hops) OVER (PARTITION BY seed, cell) AS h FROM r) WHERE hops = h GROUP BY ALL""")
def g12_expand_cells(t: Tables):
    n = t.nation.select(F.col("n_nationkey").alias("a"))
    adjacent = n.withColumn("b", F.explode(F.array(*[F.col("a") + d for d in (-5, -1, 1, 5)]))).join(n.select(F.col("a").alias("b")), "b").withColumn("km", (1 + F.col("a") % 3).cast("double"))
    return G.expand_cells(t.region.select(F.col("r_regionkey").alias("seed")), adjacent, 3, 6.0)


@query("""WITH RECURSIVE d AS (SELECT c_custkey AS id, [c_custkey // 2, c_custkey // 3] AS inputs FROM customer WHERE c_custkey > 20), lost(id) AS (SELECT id FROM (SELECT id, unnest(inputs) AS i FROM d) WHERE i NOT IN (SELECT id FROM d) AND NOT (i <= 20 AND i % 4 <> 0) UNION SELECT x.id FROM (SELECT id, unnest(inputs) AS i FROM d) x JOIN lost ON lost.id = x.i)
    SELECT id FROM d WHERE id NOT IN (SELECT id FROM lost)""")
def g13_evidence_closed(t: Tables):
    derived = t.customer.filter("c_custkey > 20").select(F.col("c_custkey").alias("id"), F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3")).alias("inputs"))
    available = t.customer.filter("c_custkey <= 20 AND c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id")).unionByName(t.customer.sparkSession.range(0).toDF("id"))
    return G.evidence_closed(derived, available).select("id")


_LINES = "SELECT c_custkey AS k, concat('line:', c_custkey) AS line_id, concat('street ', c_custkey % 7) AS name, 12.8 + CAST(floor(c_custkey / 20) AS DOUBLE) * 0.02 AS lat, 77.4 + CAST(c_custkey % 20 AS DOUBLE) * 0.02 AS lon FROM {customer} WHERE c_custkey % 13 <> 0"
_KM = "2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))"


@query(f"""WITH l AS ({_LINES.format(customer='customer')}), r AS (SELECT *, CAST(floor(k / 20) AS INT) AS line, k - row_number() OVER (PARTITION BY CAST(floor(k / 20) AS INT) ORDER BY k) AS root FROM l), v AS (SELECT *, lon + nth * 0.01::DOUBLE AS vlon FROM r, (VALUES (0), (1), (2)) AS t(nth)),
    d AS (SELECT id, v.*, {_KM} AS km FROM (SELECT p.id, v.*, pow(sin(radians(v.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(v.lat)) * pow(sin(radians(vlon - p.lon) / 2), 2) AS h FROM places p JOIN v ON abs(v.lat - p.lat) < 0.1) v),
    s AS (SELECT id, line, root, name, km FROM d WHERE km <= 2.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(km, 9), line_id) = 1),
    i AS (SELECT DISTINCT d.id, d.line_id, s.name, s.km, d.nth + x AS nth FROM d JOIN s USING (id, line, root), (VALUES (-1), (0), (1)) AS o(x) WHERE d.km <= 6 AND d.nth + x BETWEEN 0 AND 2)
    SELECT id AS anchor_id, line_id, name, round(km, 6) AS seed_km, count(*) AS n, min(nth) AS first, max(nth) AS last FROM i GROUP BY ALL HAVING count(*) >= 2""")
def g14_stitch_lines(t: Tables):
    """Streets of lines end to end, with gaps; each supplier's nearest street, clipped around it."""
    lines = t.spark.sql(_LINES, customer=t.customer).select("line_id", "name", F.array(*[F.struct("lat", (F.col("lon") + i * 0.01).alias("lon")) for i in range(3)]).alias("points"))
    found = G.stitch_lines(lines, t.places)
    at = lambda f: f(F.transform("points", lambda p: p["at"])).cast("int")
    return found.select("anchor_id", "line_id", "name", F.round("seed_km", 6).alias("seed_km"), F.size("points").cast("long").alias("n"), at(F.array_min).alias("first"), at(F.array_max).alias("last"))


_PHASED = "SELECT concat(p_brand, ' ', p_size, CASE WHEN p_partkey % 3 = 0 THEN ' Phase II' WHEN p_partkey % 3 = 1 THEN ' Phase-2' ELSE '' END) AS name FROM {part}"


@query(f"""WITH p AS (SELECT name, trim(regexp_replace(lower(trim(regexp_replace(name, '(?i)[\\s,(-]*phase[\\s-]*([0-9]+|[ivx]+)\\)?\\s*$', ''))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ({_PHASED.format(part='part')}))
    SELECT slug, min(name) AS name, count(*) AS phases, count(DISTINCT name) AS aliases FROM p GROUP BY 1""")
def g15_canonical_nodes(t: Tables):
    return G.canonical_nodes(t.spark.sql(_PHASED, part=t.part))


@query("""SELECT k AS relation_id, 0 AS ring_no, 'outer' AS role, true AS closed, 0 AS polygon_no, 5 AS points, CAST(64 + 16 * (k % 5) + (k % 5) * (k % 5) AS DOUBLE) AS area FROM (SELECT c_custkey AS k FROM customer)
    UNION ALL SELECT c_custkey, 1, 'outer', true, 1, 4, 8.0 FROM customer UNION ALL SELECT c_custkey, 2, 'outer', false, NULL, 3, 0.0 FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 2 END, 'inner', true, CASE WHEN c_custkey % 3 <> 0 THEN 0 END, 5, 4.0 FROM customer""")
def g16_assemble_rings(t: Tables):
    """A relation a customer: a square in four ways, a triangle in two, a way that stays open, and a hole in two ways, within the square or outside."""
    k, size = F.col("k"), 8 + F.col("k") % 5
    p = lambda x, y: F.struct(F.lit(0.0 + x if isinstance(x, (int, float)) else x).cast("double").alias("x"), F.lit(0.0 + y if isinstance(y, (int, float)) else y).cast("double").alias("y"))
    way = lambda role, *points: F.struct(F.lit(role).alias("role"), F.array(*points).alias("points"))
    far = F.when(k % 3 == 0, 50).otherwise(0)
    hole = lambda x, y: p(far + x, F.lit(y))
    members = [
        way("outer", p(0, 0), p(size, 0)), way("Outer", p(size, size), p(size, 0)), way("outer", p(size, size), p(0, size)), way(None, p(0, 0), p(0, size)), way("outer", p(20, 0), p(24, 0), p(22, 4)), way("outer", p(20, 0), p(22, 4)),
        F.when(k % 4 == 0, way("outer", p(30, 0), p(31, 0), p(31, 5))), way("inner", hole(2, 2), hole(4, 2), hole(4, 4)), way("inner", hole(2, 2), hole(2, 4), hole(4, 4)), way("label", p(1, 1), p(2, 2)),
    ]
    ways = t.customer.select(F.col("c_custkey").alias("k")).select(k.alias("relation_id"), F.posexplode(F.array(*members)).alias("way_id", "m")).filter("m IS NOT NULL").select("relation_id", "way_id", "m.role", "m.points")
    return G.assemble_rings(ways).drop("ring")
