"""A table of facts that grows by batches: delta files by hash bucket, merged when read, compacted bucket by bucket.

A batch is written as one delta with a folder for each bucket that it touches. Buckets whose files pass a limit (U9) are compacted into folders of their own;
no other bucket is read or written. The manifest of a batch lists the folders that count, and is committed last: readers see the old table or the new one. A batch
that runs again starts from the manifest before it and writes the same folders, so it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import needs_compaction
from ..operators.windows import compact_facts

KEY = ("entity_id", "fact_key", "source_type", "source_url")
BUCKETS = 64
_MANIFEST = "bucket int, path string, files long, rows long, bytes long, written timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def epochs(spark: SparkSession, root: str) -> list[int]:
    """The batches whose manifests were committed, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(e for e in (int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")) if _exists(spark, f"{root}/manifest/epoch={e}/_SUCCESS"))


def manifest(spark: SparkSession, root: str, epoch: int | None = None) -> DataFrame:
    """(bucket, path, files, rows, bytes, written) of the newest batch up to ``epoch``; no rows before the first. At most a few dozen rows a bucket."""
    done = [e for e in epochs(spark, root) if epoch is None or e <= epoch]
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/epoch={done[-1]}") if done else spark.createDataFrame([], _MANIFEST)


def _write(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows (with ``bucket``) as a folder a bucket, and returns their manifest rows."""
    spark = rows.sparkSession
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).select("bucket", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("bucket", "file", "size").agg(F.count(F.lit(1)).alias("rows"))
    place = F.concat(F.lit(f"{path}/bucket="), F.col("bucket").cast("string"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("size").alias("bytes")).select("bucket", place.alias("path"), "files", "rows", "bytes", F.current_timestamp().alias("written"))


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """The rows of the folders, without their bucket."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, epoch: int, root: str, buckets: int = BUCKETS, **limits) -> None:
    """Adds a batch as number ``epoch``. ``limits`` are those of ``needs_compaction``, for which a folder is one file however many its size makes it; ``buckets`` has to stay as it was at first."""
    spark, schema = batch.sparkSession, batch.schema
    before = manifest(spark, root, epoch - 1).collect()
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    entries = before + _write(rows, f"{root}/delta/epoch={epoch}").collect()
    files = spark.createDataFrame(entries, _MANIFEST).withColumn("age_hours", (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("written")) / 3600)
    # what was written at once counts as one file: it is split by size only, and compacting it again would not make it fewer
    each = files.select(F.col("bucket").alias("partition"), "rows", "bytes", "age_hours")
    full = {r.partition for r in needs_compaction(each, **limits).filter("compact").collect() if r.files > 1}
    if full:
        old = [r.path for r in entries if r.bucket in full]
        merged = compact_facts(_read(spark, old, schema)).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
        entries = [r for r in entries if r.bucket not in full] + _write(merged.select(*schema.names, "bucket"), f"{root}/data/epoch={epoch}").collect()
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/epoch={epoch}")


def merge_deltas(stream: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, **limits):
    """ST2: the stream's batches, one after another, through ``merge_batch``. Returns the started query; ``latest`` reads the result."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, root, buckets, **limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, root: str, schema) -> DataFrame:
    """The table as of the newest batch: what is not compacted yet is merged on reading, by partial aggregation."""
    return compact_facts(_read(spark, [r.path for r in manifest(spark, root).select("path").distinct().collect()], schema))


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes the folders that the newest manifest does not list, and the older manifests. For when no reader of an older one is left. Returns how many folders went."""
    done = epochs(spark, root)
    if not done:
        return 0
    listed = {r.path.rpartition("/")[0].removeprefix(root) + "/" + r.path.rpartition("/")[2] for r in manifest(spark, root).collect()}
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    system = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    for kind in ("delta", "data"):
        for batch in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/epoch=*/bucket=*")) or []:
            place = batch.getPath()
            if f"/{kind}/{place.getParent().getName()}/{place.getName()}" not in listed:
                gone += system.delete(place, True)
    for e in done[:-1]:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/epoch={e}"), True)
    return gone
