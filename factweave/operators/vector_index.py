"""An index of vectors for the nearest by cosine: cells around centres, of which a query reads a few.

Centres are fitted on a bounded sample by spherical k-means; every row is then put in the cell of its nearest centre and written sorted by cell, so that
a search reads the files and row groups of its cells only. How many cells a query has to read for a wanted recall isn't known beforehand: ``calibrate``
measures it against the exact search (``similar_to``), and the index that it returns keeps the number.

Rows whose vector is null, empty, of another length than most of the sample, without length or not finite have no cosine with any: they are in the index, in cell -1, which no query reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import similar_to

#: Rows that centres are fitted on, at most: 20,000 vectors of 1,000 numbers are 160 MB in the driver.
SAMPLE_ROWS = 20_000
#: Queries that a measurement of recall takes, at most.
SAMPLE_QUERIES = 200


@dataclass(frozen=True)
class VectorIndex:
    """Where the rows are, the centres (cells x dimensions), and how many cells a query reads."""

    path: str
    centres: np.ndarray
    probes: int = 1


def _unit(rows: list) -> np.ndarray:
    m = np.asarray(rows, dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(size: int) -> Column:
    """True for vectors of ``size`` finite numbers that are not all 0; never null."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size("embedding") == size) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _sample(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest hash: the same ones at every run, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(n)


def fit_centres(vectors: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, passes: int = 12) -> np.ndarray:
    """At most ``cells`` centres of length 1, by spherical k-means over at most ``sample_rows`` rows; none if no vector is usable.

    Far-apart rows start as centres; a centre that loses all rows goes.
    """
    lengths = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return np.zeros((0, 0))
    rows = [r.embedding for r in _sample(vectors.filter(_usable(lengths[0].d)).select("vec_id", "embedding"), sample_rows).collect()]
    if not rows:
        return np.zeros((0, lengths[0].d))
    points = np.unique(_unit(rows), axis=0)
    rng, chosen = np.random.default_rng(11), [0]
    far = 1 - points @ points[0]
    while len(chosen) < min(cells, len(points)):
        weight = np.maximum(far, 0)
        weight[chosen] = 0
        if weight.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=weight / weight.sum())))
        far = np.minimum(far, 1 - points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(passes):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        kept = np.linalg.norm(sums, axis=1) > 1e-9
        centres = _unit(sums[kept])
    return centres


def _cells(df: DataFrame, centres: np.ndarray, nearest: int) -> DataFrame:
    """``df`` (vec_id, embedding, label) with ``cells``: the ``nearest`` cells of each row, nearest first; [-1] where there is none."""
    usable = _usable(centres.shape[1])

    def find(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in column:
            out = [[-1]] * len(batch)
            at = [i for i, v in enumerate(batch) if v is not None]
            if at and len(centres):
                near = np.argsort(-(_unit([batch.iloc[i] for i in at]) @ centres.T), axis=1, kind="stable")[:, :nearest]
                for i, cells in zip(at, near.tolist()):
                    out[i] = cells
            yield pd.Series(out)

    find_udf = F.pandas_udf(find, "array<int>")
    return df.withColumn("cells", find_udf(F.when(usable, F.col("embedding"))))


def build_index(vectors: DataFrame, path: str, cells: int = 64, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Writes every row of ``vectors`` (vec_id, embedding, label) to ``path``, sorted by cell; cells of many rows are spread over several files."""
    centres = fit_centres(vectors, cells, sample_rows)
    placed = _cells(vectors.select("vec_id", "embedding", "label"), centres, 1).select(F.col("cells")[0].alias("cell"), "vec_id", "embedding", "label")
    placed.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell", "label").write.mode("errorifexists").parquet(path)
    return VectorIndex(path, centres)


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, same_kind: bool = True, probes: int | None = None) -> DataFrame:
    """(q_id, v_id, cosine, rank) of the ``k`` most similar rows in the ``probes`` cells nearest to each query, ties by id; a query never finds its own id.

    ``probes`` is the index's own number unless given; with all cells the result is the exact one over usable rows. With ``same_kind`` only rows of the query's label count.
    """
    rows = spark.read.schema("cell int, vec_id long, embedding array<float>, label int").parquet(index.path)
    probing = _cells(queries.select("vec_id", "embedding", "label"), index.centres, probes or index.probes).withColumn("cell", F.explode("cells")).filter("cell >= 0").drop("cells")
    kinds = ["cell", "label"] if same_kind else ["cell"]
    q = probing.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_v"), *kinds)
    v = rows.filter("cell >= 0").select(F.col("vec_id").alias("v_id"), F.col("embedding").alias("v_v"), *kinds)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    pairs = q.withColumn("q_n", norm("q_v")).join(v.withColumn("v_n", norm("v_v")), kinds).filter("q_id <> v_id")
    scored = pairs.select("q_id", "v_id", F.round(dot("q_v", "v_v") / (F.col("q_n") * F.col("v_n")), 6).alias("cosine"))
    # the rank's limit reaches below the shuffle: a task sends at most k rows a query
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("cosine").desc(), "v_id"))).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact pairs (q_id, v_id) that were found, a found row of the same cosine as the last exact one counting for it; 1.0 if there are none."""
    last = exact.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
    hits = found.join(last, "q_id").filter("cosine >= least").groupBy("q_id").agg(F.count(F.lit(1)).alias("hits"))
    r = last.join(hits, "q_id", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("hits", F.lit(0)))).alias("hits")).first()
    return r.hits / r.n if r.n else 1.0


def calibrate(vectors: DataFrame, index: VectorIndex, queries: DataFrame, k: int, wanted: float = 0.95, same_kind: bool = True, sample_queries: int = SAMPLE_QUERIES) -> tuple[VectorIndex, float]:
    """The index with the fewest cells a query whose recall is ``wanted`` or more, and that recall.

    At most ``sample_queries`` of the queries are searched exactly; where the cells of the rows found stand among the cells nearest to their query tells the recall
    of every number of cells at once. It holds for the sample, so ask for somewhat more than is needed.
    """
    usable = _usable(index.centres.shape[1])
    few = _sample(queries.filter(usable), sample_queries)
    cells = _cells(few.select("vec_id", "embedding", "label"), index.centres, len(index.centres)).select(F.col("vec_id").alias("q_id"), "cells")
    rows = vectors.sparkSession.read.schema("cell int, vec_id long").parquet(index.path).select("cell", F.col("vec_id").alias("v_id"))
    exact = similar_to(vectors.filter(usable), few, k, same_kind).select("q_id", "v_id")
    at = F.array_position("cells", F.col("cell")).alias("probes")
    counted = sorted((r.probes, r.n) for r in exact.join(rows, "v_id").join(cells, "q_id").groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a cell at most
    total, seen = sum(n for _, n in counted), 0
    for probes, n in counted:
        seen += n
        if seen >= wanted * total:
            return replace(index, probes=int(probes)), seen / total
    return index, 1.0
