"""Connected components by alternating stars: a DataFrame fixpoint that survives hot centres and long chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, sized_join

#: A row of two short names in a broadcast table, with its place in the map.
NODE_BYTES = 160


def _with_least(pairs: DataFrame, node_bytes: int) -> DataFrame:
    """Adds ``m``, the least ``v`` of each ``u``. A groupBy and a join: a hot ``u`` costs one row a task and can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return sized_join(pairs, least, ["u"], "inner", node_bytes)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node reachable.

    Large stars hang each node's larger neighbours on its least neighbour, small stars its smaller ones; a number
    of rounds that grows with the logarithm of the component is enough. Each round is cut through the shared
    folder. Loops and repeated edges are harmless, rows with a null end are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut(e.distinct(), "components-edges")
    loops = e.filter("u = v").select(F.col("u").alias("node"))
    e = e.filter("u <> v")
    was = None
    while True:
        n, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == was or not n:
            break
        was = (n, mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, n * NODE_BYTES).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large, n * NODE_BYTES)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, "components-round")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
