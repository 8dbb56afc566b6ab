"""Exact dedup by distributed most-significant-digit radix partitioning.

A document is read as a length-prefixed byte string. Each round takes the next bytes of every document
that still shares its group, and splits the groups by them; a document leaves when it is alone or its
bytes have ended. Rows are compared by their bytes, never by a digest. The digits widen by ``GROWTH`` each
round, so that a text of n bytes takes O(log n) rounds.

A round aggregates (group, digit) with partial sums, so that a group of copies costs one row a task, and
marks the rows by a join whose broadcast is size-checked; without it, Spark's skew join splits hot groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, sized_join
from .rows import ids_are_unique, without

FIRST_DIGIT = 64
GROWTH = 16
WIDEST_DIGIT = 16 << 20
LONGEST = 2_147_483_647


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null becomes empty. Single spaces need no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256, and ``carry`` as a struct.

    Texts are equal when their normalised bytes are. Of equal texts the smallest id stays; null ids come last,
    and of rows that repeat an id exactly one stays. A null text equals an empty one. An empty table gives no rows.
    ``carry`` names input columns to hand through in the struct ``row``, whatever they are called.
    """
    held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    keep = ["row"] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).cast("binary").alias("b"), *held)
    rows = rows.select("id", *keep, "b", F.octet_length("b").alias("len"), F.substring("b", 1, FIRST_DIGIT).alias("digit"))

    groups = cut(rows.groupBy("len", "digit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len", "digit", F.monotonically_increasing_id().alias("g")), "radix-heads")
    n, longest = groups.agg(F.count(F.lit(1)), F.max("len")).first()
    state = sized_join(rows, groups, ["len", "digit"], "left", n * (FIRST_DIGIT + 48))
    state = state.select("id", *keep, "len", "g", F.sha2("b", 256).alias("sha"), F.when(F.col("g").isNotNull(), F.substring("b", FIRST_DIGIT + 1, LONGEST)).alias("rest"), F.monotonically_increasing_id().alias("rid"))
    state = cut(state, "radix-0")

    out = ["id", "rid", "sha", *keep]
    alone = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    grouped = [F.coalesce("first.id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept")]
    closed = [state.filter("g is null").select(*out, *alone)]
    state, done, width = state.filter("g is not null"), FIRST_DIGIT, FIRST_DIGIT
    while n:
        width = min(width * GROWTH, WIDEST_DIGIT)
        state = state.withColumn("digit", F.substring("rest", 1, width))
        groups = state.groupBy("g", "digit").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.max("len").alias("longest"))
        groups = cut(groups.filter("n > 1").withColumn("g2", F.monotonically_increasing_id()), "radix-groups")
        n, size, longest = groups.agg(F.count(F.lit(1)), F.sum(F.octet_length("digit") + 96), F.max("longest")).first()
        state = sized_join(state, groups.drop("longest"), ["g", "digit"], "left", size or 0)
        state = state.select(*out, "len", F.col("g2").alias("g"), "n", "first", F.substring("rest", width + 1, LONGEST).alias("rest"))
        done += width
        if not n or longest <= done:
            closed.append(state.select(*out, *grouped))
            break
        state = cut(state, "radix-round")
        closed.append(state.filter((F.col("g").isNull()) | (F.col("len") <= done)).select(*out, *grouped))
        state = state.filter(F.col("g").isNotNull() & (F.col("len") > done)).drop("n", "first")
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *keep)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Where ids are unique, only ids and digests are written on the way."""
    if ids_are_unique(docs, id_col):
        return without(docs, id_col, exact_dedup(docs, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("id")), "radix-gone")
    return exact_dedup(docs, id_col, text_col, carry=docs.columns).filter("kept").select("row.*")
