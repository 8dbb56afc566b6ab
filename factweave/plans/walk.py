"""Greedy walks over the rows of a group, in their order: each row is seen once, and no frame is built for a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an answer that are sent on at once.
ROWS = 10_000


def walk_groups(df: DataFrame, by: str, order: list[Column], walk: Callable[[Iterator[tuple]], Iterator[tuple]], schema: StructType) -> DataFrame:
    """``walk`` of the rows of each group, as tuples in the order of ``df``'s columns; it may stop early and gives rows of ``schema``.

    Rows are dealt by the group and sorted; a task reads its groups one after another, so that groups may be many, and large where ``walk`` keeps little.
    """
    at, kinds = df.columns.index(by), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found = (out for _, group in groupby(rows, key=lambda r: r[at]) for out in walk(group))
        while part := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kinds)], schema=kinds)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
