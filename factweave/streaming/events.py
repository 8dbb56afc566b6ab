"""Structured Streaming jobs: an idempotent event log, merged fact deltas, and the demand of gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import shared_dir
from ..plans.picks import best_row, in_order

_DEMAND = "entity_id string, missing_fact string, wanted long"


def ingest_events(stream: DataFrame, path: str, checkpoint: str, at: str = "ts", late: str = "1 hour"):
    """ST1, S11: append events under ``dt=``; the content's digest is the key, so that a repeated event within the watermark is written
    once. Returns the started query."""
    keyed = stream.withColumn("event_key", F.sha2(F.to_json(F.struct(*stream.columns)), 256)).withColumn("dt", F.to_date(at))
    once = keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["event_key"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("dt").outputMode("append").trigger(availableNow=True).start()


def gap_demand(events: DataFrame) -> DataFrame:
    """ST3: how often each (entity, missing fact) was wanted, the most wanted first in rank order; batch or streaming in update mode."""
    return events.select(F.explode("gaps").alias("g")).groupBy("g.entity_id", "g.missing_fact").agg(F.count(F.lit(1)).alias("wanted"))


def _committed(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The batches whose folder of a kind was written to its end, in order."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/epoch=*/_SUCCESS")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("epoch=")) for f in found)


def _demand(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The newest count of each (entity, missing fact): the newest whole table and the batches after it, merged by partial aggregation."""
    within = lambda kind: [e for e in _committed(spark, root, kind) if upto is None or e <= upto]
    whole, counts = within("whole")[-1:], spark.createDataFrame([], f"{_DEMAND}, epoch long")
    for kind, chosen in (("whole", whole), ("changed", [e for e in within("changed") if not whole or e > whole[0]])):
        for e in chosen:
            counts = counts.unionByName(spark.read.schema(_DEMAND).parquet(f"{root}/{kind}/epoch={e}").withColumn("epoch", F.lit(e).cast("long")))
    return best_row(counts, ["entity_id", "missing_fact"], [F.col("epoch")], descending=True).select("entity_id", "missing_fact", "wanted")


def upsert_demand(batch: DataFrame, epoch: int, root: str, whole_every: int = 20) -> None:
    """Writes the counts that batch ``epoch`` changed; every ``whole_every`` batches the whole table too, so that a reader meets fewer than that many changes.

    A batch that runs again writes the same folders. A lost driver leaves a folder without its mark, which no reader takes.
    """
    batch.select("entity_id", "missing_fact", "wanted").write.mode("overwrite").parquet(f"{root}/changed/epoch={epoch}")
    if epoch % whole_every == whole_every - 1:
        _demand(batch.sparkSession, root, epoch).write.mode("overwrite").parquet(f"{root}/whole/epoch={epoch}")


def stream_gap_demand(stream: DataFrame, root: str, checkpoint: str, whole_every: int = 20):
    """ST3: ``gap_demand`` of a stream, kept as state and upserted under ``root``. Returns the started query; ``gap_queue`` reads the result."""
    upsert = lambda batch, epoch: upsert_demand(batch, epoch, root, whole_every)
    return gap_demand(stream).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_queue(spark: SparkSession, root: str) -> DataFrame:
    """ST3: (entity_id, missing_fact, wanted, rank) as of the newest batch, the most wanted first; ties by entity and fact. No rows before the first batch."""
    return in_order(_demand(spark, root), [F.col("wanted").desc(), F.col("entity_id"), F.col("missing_fact")], "rank")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
