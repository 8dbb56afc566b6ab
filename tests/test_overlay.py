"""Overlay of polygons against plain loops: areas by thin scan lines, contact by all pairs of edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import overlay as O
from factweave.operators import spatial as S


def star(rng, cx, cy, size, n):
    """A concave ring around a centre."""
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    reach = [size * rng.uniform(0.2, 1) for _ in angles]
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for r, t in zip(reach, angles)]


def closed(ring):
    return [{"x": x, "y": y} for x, y in [*ring, ring[0]]]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def scanned(a, b, n=400):
    """The area inside both, by a grid of points."""
    xs = [p[0] for ring in a for p in ring]
    ys = [p[1] for ring in a for p in ring]
    dx, dy = (max(xs) - min(xs)) / n, (max(ys) - min(ys)) / n
    hits = sum(inside(a, min(xs) + (i + 0.5) * dx, min(ys) + (j + 0.5) * dy) and inside(b, min(xs) + (i + 0.5) * dx, min(ys) + (j + 0.5) * dy) for i in range(n) for j in range(n))
    return hits * dx * dy


@pytest.mark.parametrize("seed", range(4))
def test_shared_area_of_concave_rings_with_holes(seed):
    rng = random.Random(seed)
    a = [star(rng, 0, 0, 1, 9), star(rng, 0, 0, 0.15, 5)]
    b = [star(rng, 0.4, 0.2, 1, 11), star(rng, 0.3, 0.2, 0.1, 4)]
    ea, eb = (O._edges([closed(r) for r in x]) for x in (a, b))
    assert O.shared_area(ea, eb) == pytest.approx(scanned(a, b, 150), abs=0.03)
    assert O.shared_area(ea, eb) == pytest.approx(O.shared_area(eb, ea), abs=1e-12)
    shoelace = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(b[0], b[0][1:] + b[0][:1]))) / 2
    assert O.shared_area(O._edges([closed(b[0])])) == pytest.approx(shoelace, rel=1e-9)
    # what is shared with a ring and with the rest of a box around it adds up
    box = [(-3, -3), (3, -3), (3, 3), (-3, 3)]
    rest = O._edges([closed(box), closed(b[0])])
    assert O.shared_area(ea, O._edges([closed(b[0])])) + O.shared_area(ea, rest) == pytest.approx(O.shared_area(ea), rel=1e-9)


def test_contact_is_that_of_edges():
    edges = lambda *p: O._edges([closed(list(p))])
    box = edges((0, 0), (1, 0), (1, 1), (0, 1))
    assert O.in_contact(box, edges((1, 1), (2, 1), (2, 2))) and O.in_contact(box, edges((1, 0.2), (2, 0.2), (2, 0.4), (1, 0.4))) and O.in_contact(box, edges((-1, 0.5), (2, 0.5), (2, 0.6)))
    assert not O.in_contact(box, edges((1.001, 0), (2, 0), (2, 1))) and not O.in_contact(box, edges((0.2, 0.2), (0.8, 0.2), (0.5, 0.8)))
    # boxes that meet, triangles that do not
    assert not O.in_contact(edges((0, 0), (1, 0), (0, 1)), edges((1, 1), (0.51, 1), (1, 0.51)))


def test_zones_of_all_sizes_meet_as_in_plain_loops(spark):
    rng = random.Random(7)
    zones = {f"z{i:03d}": star(rng, rng.uniform(77, 78), rng.uniform(12, 13), 10 ** rng.uniform(-4, 0.3), rng.randrange(3, 12)) for i in range(60)}
    zones["far"] = [(179.0, 80.0), (180.0, 80.0), (180.0, 81.0)]
    rows = [(k, closed(r), i % 2) for i, (k, r) in enumerate(zones.items())] + [(None, closed(zones["far"]), 0), ("none", None, 1)]
    df = spark.createDataFrame(rows, "zone_id string, ring array<struct<x: double, y: double>>, admin_level int")
    got = {(r.a_id, r.b_id): r for r in O.overlap_pairs(df, df).collect()}
    edges = {k: O._edges([closed(r)]) for k, r in zones.items()}
    for a in zones:
        for b in zones:
            shared, touch = O.shared_area(edges[a], edges[b]), O.in_contact(edges[a], edges[b])
            if shared > 0 or touch:
                assert got[a, b].shared == pytest.approx(shared, abs=1e-12) and got[a, b].touch == touch
    points = [(f"p{i}", rng.uniform(12, 13), rng.uniform(77, 78)) for i in range(200)]
    found = {(r.id, r.zone_id) for r in O.points_in(spark.createDataFrame(points, "id string, lat double, lon double"), df).collect()}
    assert found == {(i, k) for i, lat, lon in points for k, r in zones.items() if inside([r], lon, lat)}
    joined = S.overlap_join(df.filter("zone_id < 'z02'"), df, 0.2).collect()
    best = {}
    for (a, b), r in got.items():
        if a < "z02" and r.ratio >= 0.2:
            level = int(b[1:]) % 2 if b != "far" else 0
            best.setdefault((a, level), []).append((-round(r.ratio, 9), b))
    assert {(r.a_id, r.level): r.b_id for r in joined} == {k: min(v)[1] for k, v in best.items()}


def test_holes_and_levels(spark):
    kind = "zone_id string, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>, admin_level int"
    box = lambda x, y, w: closed([(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))])
    zones = spark.createDataFrame([("frame", box(0, 0, 8), [box(2, 2, 4)], 1), ("island", box(3, 3, 2), None, 1), ("plug", box(2, 2, 4), [], 1), ("side", box(8, 0, 2), None, 1), ("other", box(8, 2, 2), None, 2)], kind)
    got = {(r.a_id, r.b_id): r for r in O.overlap_pairs(zones, zones).collect()}
    assert not got["island", "frame"].touch and got["island", "frame"].shared == 0 and got["plug", "frame"].touch and got["plug", "frame"].shared == 0 and got["island", "plug"].ratio == 1
    assert {tuple(r) for r in S.adjacency(zones).collect()} == {("plug", "frame"), ("frame", "plug"), ("frame", "side"), ("side", "frame")}
    point = spark.createDataFrame([("in hole", 4.0, 4.0), ("in frame", 1.0, 1.0)], "id string, lat double, lon double")
    assert {tuple(r) for r in O.points_in(point, zones.filter("zone_id = 'frame'")).collect()} == {("in frame", "frame")}


def test_a_large_zone_has_few_cells(spark):
    zones = spark.createDataFrame([("w", closed([(-170.0, -80.0), (170.0, -80.0), (170.0, 80.0), (-170.0, 80.0)]))], "zone_id string, ring array<struct<x: double, y: double>>")
    boxed = O.boxes(O.with_rings(zones))
    assert O.in_cells(boxed, F.col("level")).count() <= 4
    assert O.overlap_pairs(zones.limit(0), zones).count() == 0
    assert np.isclose(O.overlap_pairs(zones, zones).first().ratio, 1)


def test_neighbours_are_measured_once(spark, monkeypatch):
    """each pair was measured in both directions, zones with themselves, and pairs of other levels too, with areas that nothing read."""
    monkeypatch.setattr(S, "overlap_pairs", lambda *_: pytest.fail("all pairs of boxes were measured"))
    box = lambda k, level, x, y: (k, level, [{"x": x + i, "y": y + j} for i, j in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))])
    rows = [box("a", 1, 0.0, 0.0), box("b", 1, 1.0, 0.0), box("c", 2, 0.0, 1.0), box("d", 1, 1.0, 1.0), box("e", 1, 0.5, 0.5), box("f", None, 2.0, 0.0), box("g", 1, 2.5, 0.0)]
    zones = spark.createDataFrame(rows, "zone_id string, admin_level int, ring array<struct<x: double, y: double>>")
    got = sorted(map(tuple, S.adjacency(zones).collect()))
    assert got == [("a", "b"), ("a", "d"), ("b", "a"), ("b", "d"), ("d", "a"), ("d", "b")]
    assert ("a", "c") in set(map(tuple, S.adjacency(zones.drop("admin_level")).collect()))
