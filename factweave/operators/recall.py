"""Candidates of anchors by six channels, each bounded where rows are many, united under the rule which channels may admit.

An anchor takes at most ``cap`` candidates of a channel, those of the highest score and then of the lowest ids. Channels of one fixed score (area, price band,
builder, shared neighbour) need only the lowest ids of a group: a group is reduced to its ``cap`` + 1 lowest ids before it meets any anchor, and Spark keeps no more
of it in any task, so a value that a third of all items hold costs no more than another. The lowest ids of a union are among those of its parts, which makes this exact
for neighbours of several targets, and for price bands, which are cut into at most thirty intervals of each power of sixteen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut, scratch
from .nearest import knn_join
from .search import build_index, search_index, words

#: Levels of the price intervals: widths 1, 16, 256 and on.
LEVELS = 10


@dataclass(frozen=True)
class Channel:
    """A channel: ``kind`` is area, price, builder, neighbor, spatial or lexical; one that can't ``recall`` only adds to the score of candidates that another admits."""

    name: str
    kind: str
    score: float
    cap: int
    recall: bool = True
    low: float = 0.82
    high: float = 1.18
    km: float = 8.0
    edge_types: tuple[str, ...] = ()


def normal(c: Column) -> Column:
    """Trimmed and lower case; null is empty."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))


def type_group(c: Column, groups: list[list[str]]) -> Column:
    """The value, or for values of one of the disjoint ``groups`` that group's first, so that they count as alike."""
    return reduce(lambda other, g: F.when(normal(c).isin([v.lower() for v in g]), g[0].lower()).otherwise(other), groups, normal(c))


def _lowest(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` lowest candidates of each key. As a limit on row numbers, it is applied in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("candidate"))
    return rows.withColumn("r", rank).filter(F.col("r") <= n).drop("r")


def _met(anchors: DataFrame, kept: DataFrame, key: list[str], cap: int) -> DataFrame:
    pairs = anchors.join(kept, key).filter("anchor <> candidate").select("anchor", "candidate").distinct()
    return _lowest(pairs, ["anchor"], cap).withColumn("share", F.lit(1.0))


def equal_value(anchors: DataFrame, items: DataFrame, column: str, cap: int) -> DataFrame:
    """Items of the anchor's value; an empty value meets none."""
    rows = items.select(F.col("id").alias("candidate"), "alike", normal(F.col(column)).alias("v")).filter("v <> ''")
    asked = anchors.select(F.col("id").alias("anchor"), "alike", normal(F.col(column)).alias("v"))
    return _met(asked, _lowest(rows, ["v", "alike"], cap + 1), ["v", "alike"], cap)


def _intervals(low: str, high: str, level: int) -> Column:
    """The intervals of 16^level whole prices that lie between ``low`` and ``high`` and in no such interval of the next level."""
    w = 16**level
    first, last = f"(({low} + {w - 1}) div {w})", f"(({high} + 1) div {w} - 1)"
    whole = f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE cast(array() AS array<bigint>) END"
    if level == LEVELS - 1:
        return F.expr(whole)
    up, down = f"(({low} + {16 * w - 1}) div {16 * w} * 16)", f"(({high} + 1) div {16 * w} * 16)"
    sides = [f"CASE WHEN {a} <= {b} THEN sequence({a}, {b}) ELSE cast(array() AS array<bigint>) END" for a, b in ((first, f"({up} - 1)"), (down, last))]
    return F.expr(f"CASE WHEN {up} < {down} THEN concat({sides[0]}, {sides[1]}) ELSE {whole} END")


def price_band(anchors: DataFrame, items: DataFrame, low: float, high: float, cap: int) -> DataFrame:
    """Items whose whole price lies between ``low`` and ``high`` times the anchor's; no price, or none above zero, meets none."""
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"price div {16**k}").alias("node")) for k in range(LEVELS)])
    rows = items.filter("price > 0").select(F.col("id").alias("candidate"), "alike", F.explode(nodes).alias("n")).select("candidate", "alike", "n.*")
    band = anchors.filter("price > 0").select(F.col("id").alias("anchor"), "alike", F.ceil(F.col("price") * low).alias("low"), F.floor(F.col("price") * high).alias("high"))
    parts = [band.select("anchor", "alike", F.lit(k).alias("level"), F.explode(_intervals("low", "high", k)).alias("node")) for k in range(LEVELS)]
    key = ["level", "node", "alike"]
    return _met(reduce(DataFrame.unionByName, parts), _lowest(rows, key, cap + 1), key, cap)


def shared_neighbor(anchors: DataFrame, items: DataFrame, edges: DataFrame, types: tuple[str, ...], cap: int) -> DataFrame:
    """Items with an edge of one of the types to a node that the anchor has such an edge to."""
    e = edges.filter(F.col("edge_type").isin(list(types))).select(F.col("src").alias("id"), "edge_type", "dst").distinct()
    key = ["edge_type", "dst", "alike"]
    rows = e.join(items.select("id", "alike"), "id").withColumnRenamed("id", "candidate")
    asked = e.join(anchors.select("id", "alike"), "id").withColumnRenamed("id", "anchor")
    return _met(asked, _lowest(rows, key, cap + 1), key, cap)


def _alike_only(pairs: DataFrame, anchors: DataFrame, items: DataFrame) -> DataFrame:
    both = pairs.filter("anchor <> candidate").join(items.select(F.col("id").alias("candidate"), "alike"), "candidate").join(anchors.select(F.col("id").alias("anchor"), F.col("alike").alias("own")), "anchor")
    return both.filter("alike = own").select("anchor", "candidate", "share")


def within_radius(anchors: DataFrame, items: DataFrame, km: float, cap: int) -> DataFrame:
    """The ``cap`` nearest other items of any kind, of which those alike and nearer than ``km`` stay; the share falls linearly with the distance."""
    near = knn_join(anchors, items, cap + 1).filter("left_id <> right_id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("left_id").orderBy("km", "right_id"))).filter(F.col("r") <= cap)
    return _alike_only(near.filter(F.col("km") < km).select(F.col("left_id").alias("anchor"), F.col("right_id").alias("candidate"), F.round(1 - F.col("km") / km, 6).alias("share")), anchors, items)


def lexical(anchors: DataFrame, items: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` best items by search (T1) for the anchor's words, of which the others that are alike stay; the share is the score by the greatest, or by 1 if that is less."""
    folder = scratch(items.sparkSession, "recall-index")
    build_index(items, "id", ["text"], folder)
    hits = search_index(items.sparkSession, folder, anchors.select(F.col("id").alias("query_id"), words(F.coalesce("text", F.lit(""))).alias("tokens")), cap)
    most = F.greatest(F.lit(1.0), F.max("score").over(Window.partitionBy("query_id")))
    return _alike_only(hits.select(F.col("query_id").alias("anchor"), F.col("doc").alias("candidate"), F.round(F.greatest(F.lit(0.0), F.col("score")) / most, 6).alias("share")), anchors, items)


def recall(anchors: DataFrame, items: DataFrame, channels: list[Channel], n: int, edges: DataFrame | None = None, alike: list[Column] | None = None) -> DataFrame:
    """(anchor, candidate, score, channels, rank): the ``n`` candidates of the greatest summed score for each anchor, ties by id.

    Both sides have id (unique, not null), area, builder, price (whole number), lat, lon and text, null where unknown; anchors are a stated set of the items. A candidate
    is alike its anchor in all columns of ``alike``, and at least one channel that may recall has found it. Names of channels come in order, joined by '+'.
    """
    same = F.array(*[normal(c) for c in alike or [F.lit("")]])
    columns = ["id", "area", "builder", "price", "lat", "lon", "text", same.alias("alike")]
    tasks = items.sparkSession.sparkContext.defaultParallelism  # a small file would be one task of all that follows
    a, i = cut(anchors.select(*columns), "recall-anchors"), cut(items.select(*columns).repartition(tasks, "id"), "recall-items")
    parts = []
    for c in channels:
        if c.kind in ("area", "builder"):
            found = equal_value(a, i, c.kind, c.cap)
        elif c.kind == "price":
            found = price_band(a, i, c.low, c.high, c.cap)
        elif c.kind == "neighbor":
            found = shared_neighbor(a, i, edges, c.edge_types, c.cap)
        elif c.kind == "spatial":
            found = within_radius(a, i, c.km, c.cap)
        elif c.kind == "lexical":
            found = lexical(a, i, c.cap)
        else:
            raise ValueError(f"no such channel: {c.kind}")
        parts.append(found.select("anchor", "candidate", (F.col("share") * c.score).alias("score"), F.lit(c.name).alias("channel"), F.lit(c.recall).alias("recall")))
    merged = reduce(DataFrame.unionByName, parts).groupBy("anchor", "candidate").agg(F.round(F.sum("score"), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("channels"), F.max("recall").alias("recall"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "candidate"))
    return merged.filter("recall").drop("recall").withColumn("rank", rank).filter(F.col("rank") <= n)
