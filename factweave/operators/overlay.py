"""Overlay of polygons of any shape: candidate pairs by grid levels, exact area and contact of each pair.

A zone lies in the level of the grid whose cells are as large as its box, so it has at most four cells, however large it is; a smaller
zone is also looked up in the coarser levels that exist. So pairs meet by an equi-join of small rows of ids and boxes, and rings join only the pairs left.

The shared area is summed over slabs between the heights of all vertices and crossings: within a slab no edges cross, so both polygons are
trapezoids and the width of what they share at half height is exact. Rings are read by the even-odd rule, in any direction, so holes, parts and concave
rings need no care. Contact is a distance of edges of at most ``CONTACT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geo import in_ring
from ..plans.cut import cut

#: Side of the finest cells, in the unit of the coordinates, and the distance that still is contact (about 0.1 mm in degrees).
FINEST = 0.001
CONTACT = 1e-9
#: Pairs of edges that are looked at in one step.
STEP = 1 << 20
#: Pairs of zones that a task measures.
PAIRS_A_TASK = 4096


def with_rings(zones: DataFrame) -> DataFrame:
    """Adds ``rings``: the zone's ``ring`` and, where the column exists, its ``holes``; a table that has ``rings`` keeps them. Rings are closed arrays of structs (x, y)."""
    if "rings" in zones.columns:
        return zones
    return zones.withColumn("rings", F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(zones.schema["holes"].dataType))) if "holes" in zones.columns else F.array("ring"))


def boxes(zones: DataFrame) -> DataFrame:
    """Adds the zone's box (x0, y0, x1, y1) and its grid ``level``."""
    side = lambda f, c: f(F.transform(F.flatten("rings"), lambda p: p[c]))
    z = zones.withColumns({"x0": side(F.array_min, "x"), "x1": side(F.array_max, "x"), "y0": side(F.array_min, "y"), "y1": side(F.array_max, "y")})
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(FINEST))
    return z.withColumn("level", F.ceil(F.log2(wide / FINEST)).cast("int"))


def levels_of(boxed: DataFrame) -> list[int]:
    """The levels that occur; a few dozen at most, whatever the rows."""
    return sorted(r.level for r in boxed.select("level").distinct().collect() if r.level is not None)


def in_cells(boxed: DataFrame, level: F.Column, pad: float = 0.0) -> DataFrame:
    """A row for each cell of ``level`` that the padded box touches."""
    size = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("at"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - pad) / size), F.floor((F.col(hi) + pad) / size)))
    return boxed.withColumn("at", level).withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def box_pairs(a: DataFrame, b: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id) of zones whose boxes meet, and that have the columns ``same`` alike; sides have zone_id, x0, y0, x1, y1, level."""
    side = lambda df, s: df.select(F.col("zone_id").alias(f"{s}_id"), "cx", "cy", "at", *same, *[F.col(c).alias(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")])

    def met(large: DataFrame, small: DataFrame, names: str, strictly: bool) -> DataFrame:
        coarser = F.array(*[F.lit(x) for x in levels_of(large)]).cast("array<int>")
        above = F.explode(F.filter(coarser, lambda x: x > F.col("level") if strictly else x >= F.col("level")))
        pairs = side(in_cells(large, F.col("level"), CONTACT), names[0]).join(side(in_cells(small, above, CONTACT), names[1]), ["at", "cx", "cy", *same])
        for lo, hi in (("x0", "x1"), ("y0", "y1")):
            pairs = pairs.filter((F.col(f"a{lo}") <= F.col(f"b{hi}") + CONTACT) & (F.col(f"b{lo}") <= F.col(f"a{hi}") + CONTACT))
        return pairs.select("a_id", "b_id")

    return met(a, b, "ab", False).unionByName(met(b, a, "ba", True)).distinct()


def _edges(rings: list[list[dict]]) -> np.ndarray:
    """(x1, y1, x2, y2) of all rings' edges."""
    found = [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in rings]
    return np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in found if len(r) > 1] or [np.zeros((0, 4))])


def _edge_lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """``_edges`` of each zone of a column of rings."""
    zones, rings, points = column.offsets.to_numpy(), column.values.offsets.to_numpy(), column.values.values
    xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")])
    for first, last in zip(zones[:-1], zones[1:]):
        found = [xy[rings[i] : rings[i + 1]] for i in range(first, last)]
        yield np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in found if len(r) > 1] or [np.zeros((0, 4))])


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of ``a`` cross edges of ``b``."""
    found = [np.zeros(0)]
    step = max(1, STEP // max(1, len(b)))
    for at in range(0, len(a), step):
        p, q = a[at : at + step, None, :], b[None, :, :]
        dx, dy, ex, ey = p[..., 2] - p[..., 0], p[..., 3] - p[..., 1], q[..., 2] - q[..., 0], q[..., 3] - q[..., 1]
        cross = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((q[..., 0] - p[..., 0]) * ey - (q[..., 1] - p[..., 1]) * ex) / cross
            u = ((q[..., 0] - p[..., 0]) * dy - (q[..., 1] - p[..., 1]) * dx) / cross
            inside = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        found.append(np.broadcast_to(p[..., 1], t.shape)[inside] + t[inside] * np.broadcast_to(dy, t.shape)[inside])
    return np.concatenate(found)


def _spans(edges: np.ndarray, y: float) -> np.ndarray:
    """The stretches, as rising x in pairs, that a line at height ``y`` has inside the rings."""
    hit = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    return np.sort(hit[:, 0] + (y - hit[:, 1]) * (hit[:, 2] - hit[:, 0]) / (hit[:, 3] - hit[:, 1]))


def _shared_length(a: np.ndarray, b: np.ndarray) -> float:
    """What two lists of stretches share."""
    if not len(a) or not len(b):
        return 0.0
    low, high = np.maximum(a[0::2, None], b[None, 0::2]), np.minimum(a[1::2, None], b[None, 1::2])
    return float(np.maximum(0.0, high - low).sum())


def shared_area(a: np.ndarray, b: np.ndarray | None = None) -> float:
    """The area inside both of two edge lists, or inside one."""
    if not len(a) or (b is not None and not len(b)):
        return 0.0
    both = [a] if b is None else [a, b]
    low, high = max(e[:, [1, 3]].min() for e in both), min(e[:, [1, 3]].max() for e in both)
    if low >= high:
        return 0.0
    near = [e[(e[:, [1, 3]].max(axis=1) >= low) & (e[:, [1, 3]].min(axis=1) <= high)] for e in both]
    every = np.concatenate(near)
    heights = np.unique(np.clip(np.concatenate([every[:, 1], every[:, 3], _crossing_heights(every, every)]), low, high))
    total = 0.0
    for y0, y1 in zip(heights[:-1], heights[1:]):
        spans = [_spans(e, (y0 + y1) / 2) for e in near]
        total += (y1 - y0) * _shared_length(spans[0], spans[-1])
    return total


def in_contact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether an edge of ``a`` comes within ``CONTACT`` of an edge of ``b``."""

    def reach(points: np.ndarray, edges: np.ndarray) -> bool:
        step = max(1, STEP // max(1, len(edges)))
        for at in range(0, len(points), step):
            p = points[at : at + step, None, :]
            d = edges[None, :, 2:] - edges[None, :, :2]
            size = np.maximum((d * d).sum(-1), 1e-300)
            t = np.clip(((p - edges[None, :, :2]) * d).sum(-1) / size, 0, 1)[..., None]
            if (((edges[None, :, :2] + t * d - p) ** 2).sum(-1) <= CONTACT**2).any():
                return True
        return False

    if not len(a) or not len(b):
        return False
    return reach(a[:, :2], b) or reach(b[:, :2], a) or bool(len(_crossing_heights(a, b)))


def _boxed(zones: DataFrame, *more: str) -> DataFrame:
    return cut(boxes(with_rings(zones).filter("zone_id IS NOT NULL").select("zone_id", "rings", *more)).filter("level IS NOT NULL"), "overlay-boxes")


def _with_edges(pairs: DataFrame, a: DataFrame, b: DataFrame, measure: Callable[[np.ndarray, np.ndarray], tuple | None], kinds: str) -> DataFrame:
    """Pairs (a_id, b_id) with what ``measure`` gives for the edges of both; pairs for which it gives None are left out. Tasks follow the measured number of pairs,
    as rows are few and small for the work that each takes."""
    pairs = cut(pairs, "overlay-pairs")
    tasks = -(-pairs.count() // PAIRS_A_TASK) or 1
    rings = lambda s, n: s.select(F.col("zone_id").alias(f"{n}_id"), F.col("rings").alias(f"{n}_rings"))
    whole = pairs.join(rings(a, "a"), "a_id").join(rings(b, "b"), "b_id").select("a_id", "b_id", "a_rings", "b_rings")
    schema = StructType([*whole.schema.fields[:2], *StructType.fromDDL(kinds).fields]) if kinds else StructType(whole.schema.fields[:2])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(*both) for both in zip(_edge_lists(batch.column("a_rings")), _edge_lists(batch.column("b_rings")))]
            kept = pa.array([i for i, f in enumerate(found) if f is not None], pa.int64())
            values = zip(*[f for f in found if f is not None]) if len(kept) else [[] for _ in arrow.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("a_id").take(kept), batch.column("b_id").take(kept), *[pa.array(v, f.type) for v, f in zip(values, list(arrow)[2:])]], names=arrow.names)

    return whole.repartition(tasks, "a_id", "b_id").mapInArrow(run, schema)


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, ratio = area of both / area of a, shared, touch) of zones whose boxes meet. Zones have zone_id and ``ring``, with ``holes`` if there are any, or ``rings``.

    Rows without an id or a ring meet nothing; a zone without area has ratio 0. ``touch`` is whether edges meet.
    """
    a, b = _boxed(a), _boxed(b)

    def measure(ea: np.ndarray, eb: np.ndarray) -> tuple:
        area, shared = shared_area(ea), shared_area(ea, eb)
        return min(1.0, shared / area) if area else 0.0, shared, in_contact(ea, eb)

    return _with_edges(box_pairs(a.drop("rings"), b.drop("rings")), a, b, measure, "ratio double, shared double, touch boolean")


def touching_pairs(zones: DataFrame, most: float, same: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id), a_id the smaller, of zones whose edges meet and that share an area of at most ``most``, among those with the columns ``same`` alike.
    Each pair is measured once, and its area only where edges meet."""
    z = _boxed(zones, *same)
    pairs = box_pairs(z.drop("rings"), z.drop("rings"), same).filter("a_id < b_id")
    return _with_edges(pairs, z, z, lambda ea, eb: () if in_contact(ea, eb) and shared_area(ea, eb) <= most else None, "")


def points_in(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(id, zone_id) of every zone that contains a point (id, lat, lon), by the even-odd rule over all its rings."""
    z = _boxed(zones)
    levels = F.array(*[F.lit(x) for x in levels_of(z)]).cast("array<int>")
    size = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("at"))
    p = points.select("id", "lat", "lon").withColumn("at", F.explode(levels)).withColumn("cx", F.floor(F.col("lon") / size)).withColumn("cy", F.floor(F.col("lat") / size))
    inside = (F.col("lon") >= F.col("x0")) & (F.col("lon") <= F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") <= F.col("y1"))
    hit = p.join(in_cells(z, F.col("level")).drop("level"), ["at", "cx", "cy"]).filter(inside)
    odd = F.aggregate("rings", F.lit(False), lambda even, ring: even != in_ring(F.col("lon"), F.col("lat"), ring))
    return hit.filter(odd).select("id", "zone_id")
