"""Batches merged into buckets: what is rewritten, what a repeated batch does, and the result against one compaction of all rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.operators.windows import compact_facts
from factweave.streaming import events as E
from factweave.streaming import merge as M

SCHEMA = "entity_id string, fact_key string, source_type string, source_url string, value_text string, confidence double, skill_id string, fact_no long"


@pytest.fixture(scope="module")
def batches(spark):
    rng = random.Random(2)
    rows = [(f"e{rng.randrange(30)}", f"k{rng.randrange(3)}", "s", None if rng.random() < 0.1 else "u", str(rng.randrange(9)), rng.random(), "a", i) for i in range(600)]
    return [spark.createDataFrame(rows[i : i + 100], SCHEMA) for i in range(0, 600, 100)]


def entries(spark, root):
    return {(r.bucket, r.path) for r in M.manifest(spark, root).collect()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_give_what_one_compaction_gives(spark, batches, tmp_path):
    root, every = f"file://{tmp_path}/m", None
    for epoch, batch in enumerate(batches):
        M.merge_batch(batch, epoch, root, buckets=4, most_files=3, most_rows=10**9)
        every = batch if every is None else every.unionByName(batch)
        assert rows(M.latest(spark, root, batch.schema)) == rows(compact_facts(every).select(*batch.columns))
    assert M.epochs(spark, root) == list(range(6))
    assert any("/data/" in p for _, p in entries(spark, root)) and all(sum(b == k for b, _ in entries(spark, root)) <= 4 for k in range(4))
    before = rows(M.latest(spark, root, batches[0].schema))
    assert M.vacuum(spark, root) > 0 and rows(M.latest(spark, root, batches[0].schema)) == before and M.epochs(spark, root) == [5]


def test_only_touched_buckets_are_written_and_a_repeated_batch_changes_nothing(spark, batches, tmp_path):
    root = f"file://{tmp_path}/n"
    M.merge_batch(batches[0], 0, root, buckets=16)
    was = entries(spark, root)
    one = batches[1].filter("entity_id = 'e3' AND fact_key = 'k1'").limit(1).cache()
    touched = {r[0] for r in one.select(F.pmod(F.xxhash64(*M.KEY), F.lit(16))).collect()}
    M.merge_batch(one, 1, root, buckets=16, most_files=1)
    now = entries(spark, root)
    assert {b for b, _ in now - was} == touched and {b for b, _ in was - now} == touched
    result = rows(M.latest(spark, root, one.schema))
    M.merge_batch(one, 1, root, buckets=16, most_files=1)
    assert entries(spark, root) == now and rows(M.latest(spark, root, one.schema)) == result


def test_an_uncommitted_batch_is_not_seen(spark, batches, tmp_path):
    root = f"file://{tmp_path}/o"
    M.merge_batch(batches[0], 0, root)
    want = rows(M.latest(spark, root, batches[0].schema))
    M._write(batches[1].withColumn("bucket", F.lit(1)), f"{root}/delta/epoch=1")  # the driver is lost before the manifest
    assert rows(M.latest(spark, root, batches[0].schema)) == want
    assert M.latest(spark, f"file://{tmp_path}/nothing", batches[0].schema).count() == 0


def test_demand_of_batches_equals_that_of_all_events(spark, tmp_path):
    gap = "gaps array<struct<entity_id: string, missing_fact: string>>"
    events = [([(f"e{i % 5}", "area"), (f"e{i % 3}", "price")] if i % 4 else [],) for i in range(60)] + [(None,)]
    for k in range(6):
        spark.createDataFrame(events[k::6], gap).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/wanted"
    stream = spark.readStream.schema(gap).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: E.stream_gap_demand(stream, root, f"{tmp_path}/progress", whole_every=2).awaitTermination()
    assert E.gap_queue(spark, root).count() == 0
    run()
    queue = lambda: sorted((r.rank, -r.wanted, r.entity_id, r.missing_fact) for r in E.gap_queue(spark, root).collect())

    def want(rows):
        counted = Counter(g for (gaps,) in rows for g in gaps or [])
        return [(i, *key) for i, key in enumerate(sorted((-n, *g) for g, n in counted.items()), 1)]

    assert queue() == want(events) and len(E._committed(spark, root, "changed")) >= 6 and len(E._committed(spark, root, "whole")) >= 3
    more = [([("e0", "floor")] * 40,)]
    spark.createDataFrame(more, gap).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert queue() == want(events + more)
    last = E._committed(spark, root, "changed")[-1]
    again = spark.read.parquet(f"{root}/changed/epoch={last}").collect()
    E.upsert_demand(spark.createDataFrame(again, E._DEMAND), last, root, 2)  # the batch runs once more
    assert queue() == want(events + more)


def test_a_large_delta_is_not_compacted_by_itself(spark, tmp_path):
    """a batch that its size splits into several files was rewritten at once, and all of the table with each batch after it."""
    root, size = f"file://{tmp_path}/m", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(size)
    every = spark.range(3000).select(F.concat(F.lit("e"), F.col("id") % 1000).alias("entity_id"), F.lit("k").alias("fact_key"), F.lit("s").alias("source_type"), F.lit("u").alias("source_url"), F.sha2(F.col("id").cast("string"), 256).alias("value_text"), F.rand(1).alias("confidence"), F.lit("a").alias("skill_id"), F.col("id").alias("fact_no"))
    spark.conf.set(size, "8k")
    try:
        places = []
        for epoch in range(3):
            M.merge_batch(every.filter(F.col("id") % 3 == epoch), epoch, root, buckets=2, most_files=2, most_rows=10**9)
            places.append([r.path for r in M.manifest(spark, root).collect()])
            if epoch == 0:
                assert M.manifest(spark, root).agg(F.max("files")).first()[0] > 2
    finally:
        spark.conf.set(size, was)
    assert [sum("/data/" in p for p in part) for part in places] == [0, 0, 2] and len(places[2]) == 2
    assert rows(M.latest(spark, root, every.schema)) == rows(compact_facts(every).select(*every.columns))
