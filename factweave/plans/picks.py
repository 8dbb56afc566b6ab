"""Best-of picks with a total order: the pattern behind most resolutions of conflicting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def pick(df: DataFrame, by: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, which has to be total for a repeatable result."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def best_row(df: DataFrame, by: list[str], order: list[Column], descending: bool = False) -> DataFrame:
    """One row a group by partial aggregation, without a sort: the least (or greatest) of a struct of order keys and the row.

    Suits hot groups: each task reduces its rows before the shuffle.
    """
    rest = [c for c in df.columns if c not in by]
    whole = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(rest)])
    chosen = df.groupBy(*by).agg((F.max if descending else F.min)(whole).alias("__best"))
    return chosen.select(*by, *[F.col(f"__best.v{i}").alias(c) for i, c in enumerate(rest)])


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the rank of each row from 1 over all rows. Rows are sorted by ranges, so no task has them all; only one count a range meets in one window."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "in-order")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + within).drop("__range", "__before")  # a row a range
