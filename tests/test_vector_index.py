"""The vector index against the exact search: recall, whole rows, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import vector_index as I
from factweave.operators.joins import similar_to

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in middle[i % 20] + 0.4 * rng.normal(size=16)], i % 2) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(700)]  # a third is one vector
    odd = [None, [], [1.0], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    return spark.createDataFrame(rows + [(3000 + i, v, 0) for i, v in enumerate(odd)], SCHEMA).cache()


def usable(df):
    return df.filter((F.col("vec_id") < 3000))


def ranked(df):
    return sorted((r.q_id, r.rank, r.v_id, r.cosine) for r in df.collect())


@pytest.mark.parametrize("same_kind", [True, False])
def test_recall_and_all_cells(spark, vectors, tmp_path, same_kind):
    index = I.build_index(vectors, f"file://{tmp_path}/i", cells=16)
    rows = spark.read.parquet(index.path)
    assert rows.count() == vectors.count() and {r.vec_id for r in rows.filter("cell = -1").collect()} == set(range(3000, 3007))
    queries = vectors.filter("vec_id % 50 = 0")
    fitted, measured = I.calibrate(vectors, index, queries, 5, 0.95, same_kind)
    exact = similar_to(usable(vectors), usable(queries), 5, same_kind)
    assert measured >= 0.95 and fitted.probes < len(index.centres)
    assert I.recall(I.search(spark, fitted, queries, 5, same_kind), exact) >= 0.9
    assert ranked(I.search(spark, index, queries, 5, same_kind, probes=len(index.centres))) == ranked(exact)


def test_supplied_embeddings(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index, _ = I.calibrate(v, I.build_index(v, f"file://{tmp_path}/i", cells=16), v, 5)
    assert I.recall(I.search(spark, index, v, 5), similar_to(v, v, 5)) >= 0.9


def test_empty_and_useless_tables(spark, tmp_path):
    for i, rows in enumerate(([], [(1, None, 0), (2, [0.0, 0.0], 0)], [(1, [1.0, 0.0], 0)])):
        v = spark.createDataFrame(rows, SCHEMA)
        index, got = I.calibrate(v, I.build_index(v, f"file://{tmp_path}/{i}"), v, 3)
        assert got == 1.0 and I.search(spark, index, v, 3).count() == 0 and spark.read.schema("cell int").parquet(index.path).count() == len(rows)
