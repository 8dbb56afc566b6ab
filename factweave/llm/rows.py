"""Telling rows apart without copying them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, sized_join


def ids_are_unique(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is null or repeats; reads the id column only."""
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(f"`{id_col}`"))).first()
    return rows == ids


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, id_col: str, gone: DataFrame, label: str) -> DataFrame:
    """``docs`` whose unique ids are not in ``gone`` (id). The texts are shuffled only if ``gone`` is beyond the broadcast limit."""
    name = free_name(docs, "gone")
    gone = cut(gone.select(F.col("id").alias(name)), label)
    return sized_join(docs, gone, docs[id_col] == gone[name], "left_anti", gone.count() * 48)
