"""Walks, closures and components over edge tables (src, edge_type, dst, confidence). Loops are bounded or run to a fixpoint, cut each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geo import close_km
from ..plans.cut import BROADCAST_LIMIT, cut, sized_join
from ..plans.fixpoint import components
from ..plans.picks import best_row
from ..plans.walk import walk_groups


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "edge_type", "dst").unionByName(edges.select(F.col("dst").alias("src"), "edge_type", F.col("src").alias("dst")))


def neighbors(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """G1: neighbours of ``nodes`` (node) in both directions, optionally over one relation."""
    e = both_ways(edges if relation is None else edges.filter(F.col("edge_type") == relation))
    return e.join(nodes, e["src"] == nodes["node"], "left_semi").select(F.col("src").alias("node"), "edge_type", F.col("dst").alias("neighbor")).distinct()


def targets_out(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Distinct targets over edge types."""
    e = edges.filter(F.col("edge_type").isin(types))
    return e.join(nodes, e["src"] == nodes["node"], "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("target")).distinct()


def walk(edges: DataFrame, anchors: DataFrame, hops: list[str]) -> DataFrame:
    """The i-th hop follows the i-th edge type; every step is a row (anchor, step, node)."""
    here = anchors.select(F.col("node").alias("anchor"), "node")
    steps = []
    for i, kind in enumerate(hops):
        e = edges.filter(F.col("edge_type") == kind).select("src", "dst")
        here = here.join(e, here["node"] == e["src"]).select("anchor", F.col("dst").alias("node")).distinct()
        steps.append(here.select("anchor", F.lit(i + 1).alias("step"), "node"))
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    return found


def bfs(edges: DataFrame, anchors: DataFrame, types: list[str] | None, depth: int, directed: bool = True) -> DataFrame:
    """(anchor, node, depth) of everything within ``depth`` hops, each node at its least depth."""
    e = edges if types is None else edges.filter(F.col("edge_type").isin(types))
    e = cut((e.select("src", "dst") if directed else both_ways(e).select("src", "dst")).distinct(), "bfs-edges")
    fronts, _ = _hops(e, anchors, depth)
    return reduce(DataFrame.unionByName, fronts)


def _leaving(e: DataFrame, front: DataFrame) -> tuple[DataFrame, int]:
    """The edges that leave the nodes of ``front``, and their size in memory. Many walks meet in few nodes, whose edges are then a small table."""
    nodes = cut(front.select(F.col("node").alias("src")).distinct(), "hop-nodes")
    n_bytes = nodes.agg(F.coalesce(F.sum(F.length("src") + 48), F.lit(0))).first()[0]
    left = sized_join(e, nodes, ["src"], "left_semi", n_bytes)
    size = left.agg(F.coalesce(F.sum(F.length(F.concat_ws("", *e.columns)) + 48), F.lit(0))).first()[0]
    return (cut(left, "hop-edges") if size <= BROADCAST_LIMIT else left), size


def _hops(e: DataFrame, anchors: DataFrame, depth: int) -> tuple[list[DataFrame], list[tuple[DataFrame, int]]]:
    """For each depth that is met the rows (anchor, node, depth), each node at its least depth; and for each but the last that is asked the edges that leave it, with their size.

    What a hop finds is told from what was met before by the least depth of each pair: one aggregation, without a sort or a join.
    """
    fronts, taken = [cut(anchors.select(F.col("node").alias("anchor"), "node", F.lit(0).alias("depth")), "bfs-0")], []
    for d in range(1, depth + 1):
        taken.append(_leaving(e, fronts[-1]))
        step = _along(fronts[-1], *taken[-1]).select("anchor", F.col("dst").alias("node"), F.lit(d).alias("depth"))
        # an anchor is all that was met before the first hop
        met = step.filter(~F.col("node").eqNullSafe(F.col("anchor"))) if d == 1 else reduce(DataFrame.unionByName, fronts, step)
        fronts.append(cut(met.groupBy("anchor", "node").agg(F.min("depth").alias("depth")).filter(F.col("depth") == d), "bfs-front"))
        if fronts[-1].isEmpty():
            break
    return fronts, taken


def _along(front: DataFrame, e: DataFrame, size: int) -> DataFrame:
    """The rows of ``front`` with the edges that leave their nodes."""
    return sized_join(front, e, front["node"] == e["src"], "inner", size)


def walk_edges(edges: DataFrame, anchors: DataFrame, types: list[str], depth: int) -> DataFrame:
    """(anchor, depth, src, edge_type, dst): each edge of ``types`` once that a walk of at most ``depth`` hops from the anchor meets, also those that lead back
    to nodes met before; ``depth`` is the hop that takes it. No types or no depth give nothing."""
    e = edges.filter(F.col("edge_type").isin(list(types))).select("src", "edge_type", "dst").distinct()
    if depth < 1:
        return anchors.limit(0).select(F.col("node").alias("anchor"), F.lit(1).alias("depth")).join(e, F.lit(False))
    e = cut(e, "walk-edges")
    fronts, taken = _hops(e, anchors, depth - 1)
    taken += [_leaving(e, front) for front in fronts[len(taken):]]
    return reduce(DataFrame.unionByName, [_along(f, *t).select("anchor", (F.col("depth") + 1).alias("depth"), "src", "edge_type", "dst") for f, t in zip(fronts, taken)])


def shortest_path(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """(a, b, hops, path, relations) of the shortest undirected path of at most ``hops``; of equal ones the least path, and of parallel edges
    the least relation. A node is zero hops, and no relation, from itself. One path a node and pair is kept at each hop, so that the frontier stays within nodes times pairs; the last hop only
    looks for the edge to the target, so that no hub is opened for it."""
    e = cut(both_ways(edges).groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type")), "path-edges")
    start = pairs.select("a", "b", F.col("a").alias("node"), F.array("a").alias("path"), F.array().cast("array<string>").alias("relations"))
    front = cut(start.distinct(), "path-0")
    found = front.filter("a = b").select("a", "b", F.lit(0).alias("hops"), F.col("a").cast("string").alias("path"), F.lit("").alias("relations"))
    front = seen = front.filter("a <> b")
    longer = lambda node: F.min(F.struct(F.concat("path", F.array(node)).alias("path"), F.concat("relations", F.array("edge_type")).alias("relations"))).alias("p")
    for h in range(1, hops + 1):
        met = front.join(e.select(F.col("src").alias("node"), F.col("dst").alias("b"), "edge_type"), ["node", "b"]).groupBy("a", "b").agg(longer("b"))
        met = cut(met.select("a", "b", F.lit(h).alias("hops"), F.array_join("p.path", ">").alias("path"), F.array_join("p.relations", ">").alias("relations")), "path-met")
        found = found.unionByName(met)
        if h == hops:
            break
        step = front.join(met.select("a", "b"), ["a", "b"], "left_anti").join(e, F.col("node") == F.col("src"))
        step = step.groupBy("a", "b", F.col("dst").alias("node")).agg(longer("dst")).select("a", "b", "node", "p.*")
        front = cut(step.join(seen.select("a", "b", "node"), ["a", "b", "node"], "left_anti"), "path-step")
        seen = seen.unionByName(front)
    return found


def closure(edges: DataFrame, types: list[str]) -> DataFrame:
    """(node, ancestor) over containment types, to the fixpoint; path lengths double each round."""
    pairs = cut(edges.filter(F.col("edge_type").isin(types)).select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).distinct(), "closure-0")
    n = pairs.count()
    while True:
        far = pairs.select("node", F.col("ancestor").alias("mid")).join(pairs.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor")
        pairs = cut(pairs.unionByName(far).distinct(), "closure")
        m = pairs.count()
        if m == n:
            return pairs
        n = m


def scopes_connected(pairs: DataFrame, ancestors: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Why two scopes are connected: same, contained, adjacent, sharing an ancestor, or null. ``adjacent`` has both directions."""
    up = ancestors.select("node", "ancestor")
    c1 = pairs.join(up, (pairs["a"] == up["node"]) & (pairs["b"] == up["ancestor"]), "left_semi").select("a", "b")
    c2 = pairs.join(up, (pairs["b"] == up["node"]) & (pairs["a"] == up["ancestor"]), "left_semi").select("a", "b")
    shared = pairs.join(up.select(F.col("node").alias("a"), F.col("ancestor").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("ancestor").alias("x")), ["b", "x"]).select("a", "b").distinct()
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    j = pairs.join(flag(c1.unionByName(c2), "contained"), ["a", "b"], "left").join(flag(adjacent.select("a", "b"), "adjacent"), ["a", "b"], "left").join(flag(shared, "shared"), ["a", "b"], "left")
    return j.select("a", "b", F.when(F.col("a") == F.col("b"), "same").when(F.col("contained"), "contained").when(F.col("adjacent"), "adjacent").when(F.col("shared"), "shared ancestor").alias("why"))


def canonicalize(pairs: DataFrame) -> DataFrame:
    """Components of compatible records: (node, root)."""
    return components(pairs)


def ambiguous(pairs: DataFrame, providers: DataFrame) -> DataFrame:
    """Nodes with two or more neighbours of one provider, and those neighbours."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("b").distinct()  # dealt as the join needs it
    near = both.join(providers.select(F.col("id").alias("b"), "provider"), "b")
    many = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a", "provider"))).filter("n > 1")
    other = F.when(F.col("a").isNotNull() & F.col("provider").isNotNull(), F.col("b")).otherwise(F.col("a"))
    return many.select(F.explode(F.array("a", other)).alias("id")).distinct()


def canonical_entities(members: DataFrame, sources: list[str]) -> DataFrame:
    """A component's name from its best member by source order, confidence, id; a suffix where a name spans categories; a digest id."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    best = best_row(members, ["root"], [at, -F.col("confidence"), F.col("id")])
    spans = members.groupBy("name").agg(F.count_distinct("category").alias("categories"))
    named = best.join(spans, "name").withColumn("name", F.when(F.col("categories") > 1, F.concat("name", F.lit(" ("), "category", F.lit(")"))).otherwise(F.col("name")))
    return named.select("root", "name", F.concat(F.lit("canonical:"), F.substring(F.sha2(F.concat_ws("|", "category", "name"), 256), 1, 16)).alias("entity_id"))


def expand_cells(seeds: DataFrame, adjacent: DataFrame, hops: int, km: float) -> DataFrame:
    """Cells reached from seeds (seed) over ``adjacent`` (a, b, km) within ``hops`` and ``km``: fewest hops, then least km."""
    front = cut(seeds.select("seed", F.col("seed").alias("cell"), F.lit(0).alias("hops"), F.lit(0.0).alias("km")), "expand-0")
    seen = front
    for h in range(1, hops + 1):
        step = front.join(adjacent.select(F.col("a").alias("cell"), "b", F.col("km").alias("d")), "cell").withColumn("km", F.col("km") + F.col("d")).filter(F.col("km") <= km)
        step = step.groupBy("seed", F.col("b").alias("cell")).agg(F.min("km").alias("km")).join(seen.select("seed", "cell"), ["seed", "cell"], "left_anti")
        front = cut(step.select("seed", "cell", F.lit(h).alias("hops"), "km"), "expand")
        seen = seen.unionByName(front)
    return seen


def evidence_closed(derived: DataFrame, available: DataFrame) -> DataFrame:
    """Derived rows (id, inputs array) whose whole chain of inputs survives; rows with a missing input fall, round by round."""
    alive = cut(derived, "evidence-0")
    n = alive.count()
    while n:
        known = available.select("id").unionByName(alive.select("id")).distinct()
        lost = alive.select("id", F.explode("inputs").alias("input")).join(known, F.col("input") == known["id"], "left_anti").select("id").distinct()
        alive = cut(alive.join(lost, "id", "left_anti"), "evidence")
        m = alive.count()
        if m == n:
            break
        n = m
    return alive


#: Latitudes that are places; a line may run on beyond them in its numbers, but is nowhere there.
ON_GLOBE = "lat BETWEEN -90 AND 90"


def line_roots(lines: DataFrame, join_km: float = 0.15) -> DataFrame:
    """(line_id, root): lines whose ends come within ``join_km`` of each other, directly or over others, have one root. Lines have line_id and ``points`` of structs (lat, lon)."""
    from .spatial import radius_join

    ends = lines.filter(F.size("points") > 0).select("line_id", F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("p"))
    ends = cut(ends.select(F.col("line_id").alias("id"), "p.lat", "p.lon"), "line-ends")
    placed = ends.filter(ON_GLOBE)
    met = radius_join(placed, placed, join_km).filter("left_id < right_id").select("left_id", "right_id").distinct()
    alone = ends.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"))
    return components(met.unionByName(alone), "left_id", "right_id").select(F.col("node").alias("line_id"), "root")


def stitch_lines(lines: DataFrame, anchors: DataFrame, match_km: float = 2.5, radius_km: float = 6.0, join_km: float = 0.15, most: int | None = None) -> DataFrame:
    """(anchor_id, line_id, name, seed_km, points): for each anchor (id, lat, lon) the corridor of its nearest line.

    The seed is the line (line_id, name, points) with the vertex nearest to the anchor, within ``match_km``, ties by id. Its corridor is every line of its root
    (``line_roots``), under the seed's name, clipped to the vertices within ``radius_km`` of the anchor and one neighbour on either side, in order and once each, if it
    keeps two vertices or more; of those the first ``most`` by id, where it is given. Anchors without a seed give no rows. Pairs of anchors and vertices meet by cells;
    vertices beyond the poles meet no anchor.
    """
    from .spatial import radius_join

    vertices = cut(lines.select("line_id", F.posexplode("points").alias("at", "p")).select("line_id", "at", "p.lat", "p.lon"), "line-vertices")
    placed = lambda df, *ids: df.filter(ON_GLOBE).select(F.struct(*ids, "lat", "lon").alias("id"), "lat", "lon")
    reach = max(match_km, radius_km)
    met = radius_join(placed(anchors, "id"), placed(vertices, "line_id", "at"), reach + 1e-6).drop("km")
    km = close_km(*[F.col(f"{side}_id.{c}") for side in ("left", "right") for c in ("lat", "lon")])
    near = met.select(F.col("left_id.id").alias("left_id"), F.col("right_id.line_id").alias("line_id"), F.col("right_id.at").alias("at"), km.alias("km"))
    near = cut(near.filter(F.col("km") <= reach), "line-near")
    roots = cut(line_roots(lines, join_km), "line-roots")
    line_bytes, vertex_bytes = roots.count() * 160, vertices.count() * 160
    seed = best_row(near.filter(F.col("km") <= match_km).select("left_id", "line_id", "km"), ["left_id"], [F.round("km", 9), F.col("line_id")])
    seed = sized_join(sized_join(seed, lines.select("line_id", "name"), ["line_id"], "inner", line_bytes), roots, ["line_id"], "inner", line_bytes)
    seed = cut(seed.select("left_id", "name", F.col("km").alias("seed_km"), "root"), "line-seeds")
    inside = sized_join(sized_join(near.filter(F.col("km") <= radius_km), roots, ["line_id"], "inner", line_bytes), seed, ["left_id", "root"], "inner", seed.count() * 200)
    kept = inside.select("left_id", "line_id", "name", "seed_km", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at")).distinct()
    whole = sized_join(kept, vertices, ["line_id", "at"], "inner", vertex_bytes)
    clipped = whole.groupBy("left_id", "line_id", "name", "seed_km").agg(F.array_sort(F.collect_list(F.struct("at", "lat", "lon"))).alias("points")).filter(F.size("points") >= 2)
    if most is not None:
        clipped = clipped.withColumn("n", F.row_number().over(Window.partitionBy("left_id").orderBy("line_id"))).filter(F.col("n") <= most)
    return clipped.select(F.col("left_id").alias("anchor_id"), "line_id", "name", "seed_km", "points")


def canonical_nodes(projects: DataFrame) -> DataFrame:
    """Nodes by slug without the phase suffix; a name is an alias only if one node has it."""
    from ..functions.text import slug, strip_phase

    p = projects.withColumn("slug", slug(strip_phase(F.col("name"))))
    nodes = p.groupBy("slug").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("phases"))
    alias = p.select("name", "slug").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("n = 1").groupBy("slug").agg(F.count(F.lit(1)).alias("aliases"))
    return nodes.join(alias, "slug", "left").select("slug", "name", "phases", F.coalesce("aliases", F.lit(0)).cast("long").alias("aliases"))


def _joined(ways: list[list[tuple]]) -> list[list[tuple]]:
    """Ways joined end to end, from the first one on, at either of its ends; each end is looked up once."""
    at_end: dict[tuple, list[int]] = {}
    for k, way in enumerate(ways):
        for end in {way[0], way[-1]}:
            at_end.setdefault(end, []).append(k)
    used, rings = [False] * len(ways), []

    def next_way(end: tuple) -> list[tuple] | None:
        waiting = at_end.get(end, [])
        while waiting and used[waiting[0]]:
            waiting.pop(0)
        if not waiting:
            return None
        used[waiting[0]] = True
        return ways[waiting.pop(0)]

    for k, way in enumerate(ways):
        if used[k]:
            continue
        used[k], ring = True, list(way)
        while ring[0] != ring[-1] and (more := next_way(ring[-1])):
            ring += (more if more[0] == ring[-1] else more[::-1])[1:]
        head: list[tuple] = []
        while ring[0] != ring[-1] and (more := next_way(head[-1] if head else ring[0])):
            end = head[-1] if head else ring[0]
            head += (more if more[0] == end else more[::-1])[1:]
            if head[-1] == ring[-1]:
                break
        rings.append(head[::-1] + ring)
    return rings


def _contains(ring: list[tuple], point: tuple) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > point[1]) != (by > point[1]) and point[0] < ax + (point[1] - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def assemble_rings(ways: DataFrame) -> DataFrame:
    """(relation_id, ring_no, role, closed, polygon_no, points, area, ring): member ways (relation_id, way_id, points array<struct<x,y>>, and ``role``, 'outer' where it is missing or null)
    joined end to end, ways of a role with one another.

    Closed rings of some area are polygons: outer ones run counter-clockwise and are polygons of their own number; inner ones run clockwise and take the
    number of the smallest outer ring that holds their first point, null if none does. Rings that stay open, have under three different points or no area have
    closed false and no number. Ways of other roles and of under two points are left out. Order-dependent inside a relation: one call a relation.
    """

    named = F.lower(F.coalesce("role", F.lit("outer"))) if "role" in ways.columns else F.lit("outer")
    flat = lambda c: F.transform("points", lambda p: p[c].cast("double"))
    rows = ways.select("relation_id", "way_id", named.alias("role"), flat("x").alias("xs"), flat("y").alias("ys"))

    def assemble(group):
        members: dict[str, list] = {"outer": [], "inner": []}
        for relation, _, role, xs, ys in group:
            if role in members and xs is not None and len(xs) >= 2:
                members[role].append(list(zip(xs, ys)))
        found = []
        for role, turn in (("outer", 1), ("inner", -1)):
            for ring in _joined(members[role]):
                ring = [p for k, p in enumerate(ring) if not k or p != ring[k - 1]]
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
                closed = ring[0] == ring[-1] and len(set(ring)) >= 3 and abs(area) > 1e-14
                found.append((role, closed, ring[::-1] if closed and area * turn < 0 else ring, abs(area) if closed else 0.0))
        number = {k: n for n, k in enumerate(k for k, f in enumerate(found) if f[0] == "outer" and f[1])}
        for k, (role, closed, ring, area) in enumerate(found):
            holder = k if k in number else min((o for o in number if closed and _contains(found[o][2], ring[0])), key=lambda o: (found[o][3], o), default=None)
            yield relation, k, role, closed, number.get(holder), len(ring), area, [x for x, _ in ring], [y for _, y in ring]

    kind = ways.schema["relation_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"relation_id {kind}, ring_no long, role string, closed boolean, polygon_no long, points long, area double, xs array<double>, ys array<double>")
    found = walk_groups(rows, "relation_id", [F.col("way_id")], assemble, schema)
    return found.withColumn("ring", F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))).drop("xs", "ys")
