"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; a document's copies are target / source size on average. The whole part is
taken as it is. The fractions are rounded in pairs: words move at random between two documents, unbiased and
without changing the pair's expected words, until one of them is integral. The open one meets the next. Pairs are
made inside buckets of a few thousand documents, and each bucket's last open document goes up a reduction tree,
so that one hot source is spread over many tasks and a source ends within one document of its target.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, sized_join
from .rows import free_name, ids_are_unique

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
BUCKET_ROWS = 2048
FAN_IN = 1024
NEAR = 1e-9


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the number of sources before each by code point, null last: ranges of sources are counted, not gathered."""
    spark = sources.sparkSession
    placed = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    at = F.monotonically_increasing_id()
    placed = cut(placed.withColumn("part", F.shiftright(at, 33)).withColumn("nth", at.bitwiseAND(F.lit((1 << 33) - 1))), "mix-places")
    before, total = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part long, before long")
    return sized_join(placed, offsets, ["part"], "inner", len(before) * 32).withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target, from rows (source, size).

    ``weights`` repeat over the sources by code point, null last. They share ``share`` times all words; none gets
    more than ``ceiling`` times its own, and the excess is shared again by weight. That ends at min(cap, level * weight)
    for one level, which rises round by round, as the sources above their caps stop and the others share the rest; a round
    is one sum over the sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("w", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    s = cut(s, "mix-sources")
    words, stopped, level = s.agg(F.sum("source_size")).first()[0] or 0, -1, -1.0
    while True:
        full = F.col("cap") < level * F.col("w") * (1 - 1e-12)
        n, caps, free = s.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (min(share, ceiling) * words - caps) / free
    return s.select("source", "source_size", F.least(F.col("cap"), F.lit(level if free else float("inf")) * F.col("w")).alias("target"))


def pivotal(p: np.ndarray, size: np.ndarray, draw) -> tuple[np.ndarray, int]:
    """Rounds ``p`` in order; returns 0, 1 or the open fraction, and the index of the open one (-1: none).

    Between i and j, ``a`` is what j can give to i and ``b`` what i can give to j, in words; i gets ``a`` with the
    chance b / (a + b), so that neither's expectation moves.
    """
    p, i = p.copy(), -1
    for j in range(len(p)):
        if size[j] == 0:
            p[j] = float(draw() < p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        move = a if draw() * (a + b) < b else -b
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for k in (i, j):
            if p[k] < NEAR or p[k] > 1 - NEAR:
                p[k] = float(p[k] > 0.5)
        if 0 < p[i] < 1 and 0 < p[j] < 1:  # both open only by rounding error
            p[j] = float(p[j] > 0.5)
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p, i


def close(p: np.ndarray, i: int, size: np.ndarray) -> None:
    """The source's last open document ``i`` goes to 0 or 1, with at most one other turned, so that the words miss least."""
    turn = np.where(p == 0, size, -size)
    turn[i] = 0.0  # nothing else is turned
    missed = {float(end): (end - p[i]) * size[i] + turn for end in (0, 1)}
    end = min(missed, key=lambda e: np.abs(missed[e]).min())
    j = int(np.abs(missed[end]).argmin())
    p[i] = end
    if j != i:
        p[j] = 1 - p[j]


def _settle(seed: int, depth: int, last: bool):
    """Rounds one bucket, larger documents first, so that what stays open is small."""

    def settle(key, pdf):
        pdf = pdf.sort_values(["size", "h", "rid"], ascending=[False, True, True], kind="stable")
        rng = np.random.default_rng(zlib.crc32(f"{seed} {depth} {key[1]} {pdf['h'].iloc[0]} {len(pdf)}".encode()))
        size = pdf["size"].to_numpy(float)
        p, i = pivotal(pdf["p"].to_numpy(float), size, rng.random)
        if last and i >= 0:
            close(p, i, size)
        return pdf.assign(p=p)

    return settle


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``source_col``, size, source_size, target, copies, taken.

    A null text has no words; a null source is a source. Rows without words get copies by chance and take none.
    Repeated rows are rounded one by one, and texts count whole, however long. The draw of a bucket depends on its rows and the seed: reruns agree.
    A source whose words are all zero takes none. An empty table gives no rows.
    ``carry`` hands input columns through in the struct ``row``; only (number, fraction, size) goes to Python.
    """
    held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), F.monotonically_increasing_id().alias("rid"), *held)
    rows = cut(rows, "mix-sizes")
    aims = cut(targets(rows, weights, share, ceiling), "mix-targets")
    n_rows, n_sources = rows.count(), aims.count()
    aims = aims.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("pi"), F.monotonically_increasing_id().alias("sid"))
    aims = cut(aims, "mix-aims")
    rows = sized_join(rows, aims, F.col("source").eqNullSafe(F.col("s")), "inner", n_sources * 256)
    rows = rows.withColumn("whole", F.floor(F.col("pi") + NEAR).cast("long")).withColumn("p", F.greatest(F.col("pi") - F.col("whole"), F.lit(0.0)))

    # the tree: (source, bucket) -> (source, bucket / FAN_IN) -> ...
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    # rows alike in id and text that would fill a bucket are dealt by their number
    alike = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS).select("h", F.ceil(F.col("n") / BUCKET_ROWS).alias("deals")), "mix-alike")
    level = sized_join(rows.filter(F.col("p") > NEAR).select("sid", "rid", "size", "p", "h"), alike, ["h"], "left", alike.count() * 32)
    deal = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("deals")), F.lit(0).cast("long"))
    level = level.select("sid", "rid", "size", "p", "h", F.pmod(F.xxhash64("h", deal, F.lit(seed)), F.lit(buckets)).alias("bucket"))
    settled: DataFrame | None = None
    depth = 0
    while True:
        last = buckets == 1

        level = cut(level.groupBy("sid", "bucket").applyInPandas(_settle(seed, depth, last), level.schema), f"mix-level{depth}")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        part = level.filter(~is_open).select("rid", F.col("p").cast("long").alias("more"))
        settled = part if settled is None else settled.unionByName(part)
        if last:
            break
        level = level.filter(is_open).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        buckets, depth = -(-buckets // FAN_IN), depth + 1
    got = rows.join(settled, "rid", "left")
    copies = F.col("whole") + F.coalesce("more", F.lit(0).cast("long"))
    return got.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it has copies, with its own columns. Where ids are unique, copies are
    joined to the rows by id, and the texts are shuffled only beyond the broadcast limit."""
    if ids_are_unique(docs, id_col):
        name, times, copy = (free_name(docs, c) for c in ("id", "copies", "copy"))
        copies = mix(docs, id_col, text_col, source_col, **settings).filter("copies > 0").select(F.col(id_col).alias(name), F.col("copies").cast("int").alias(times))
        copies = cut(copies, "mix-copies")
        taken = sized_join(docs, copies, docs[id_col] == copies[name], "inner", copies.count() * 48)
        return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
    got = mix(docs, id_col, text_col, source_col, carry=docs.columns, **settings)
    return got.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
