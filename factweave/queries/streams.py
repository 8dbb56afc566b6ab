"""Queries of the streaming jobs: each runs over the files there are, then reads what it wrote."""

from pyspark.sql import functions as F

from ..streaming import events as E
from ..streaming import merge as M
from .registry import Tables, query

#: Rows of an arriving file, about; a batch has more files where it has more rows, so that no task writes or reads a whole batch.
BATCH_FILE_ROWS = 1 << 20


def _stream(t: Tables, name: str):
    return t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


@query("SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def st1_event_log(t: Tables):
    """Every event arrives twice and is written once."""
    typed = lambda: _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = E.scratch(t.spark, "event-log")
    E.ingest_events(typed().unionByName(typed()), path, path + "-progress", late="3650 days").awaitTermination()
    return t.spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT entity_id, fact_key, source_type, source_url, value_text, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key, source_type, source_url ORDER BY confidence DESC, value_text DESC, skill_id DESC, fact_no DESC) = 1")
def st2_merge_deltas(t: Tables):
    """The facts arrive in four batches; buckets of more than two files are compacted on the way, the rest is merged on reading."""
    arriving = E.scratch(t.spark, "facts-arriving")
    each = max(1, t.facts.count() // (4 * BATCH_FILE_ROWS))  # files of a batch
    t.facts.repartition(4 * each, "fact_no").write.parquet(arriving)
    root = E.scratch(t.spark, "facts-merged")
    M.merge_deltas(t.spark.readStream.schema(t.facts.schema).option("maxFilesPerTrigger", each).parquet(arriving), root, root + "-progress", buckets=8, most_files=2, most_rows=1 << 40).awaitTermination()
    return M.latest(t.spark, root, t.facts.schema).select("entity_id", "fact_key", "source_type", "source_url", "value_text", "fact_no")


_GAPS = "SELECT concat('user:', user_id) AS entity_id, missing_fact, count(*) AS wanted FROM (SELECT user_id, event_type AS missing_fact FROM events WHERE value > 10 UNION ALL SELECT user_id, 'any' FROM events) GROUP BY ALL"


def _gaps(t: Tables):
    """Each event with what it lacked."""
    gap = lambda fact, when: F.when(when, F.struct(F.concat(F.lit("user:"), "user_id").alias("entity_id"), fact.alias("missing_fact")))
    return t.events.select(F.array_compact(F.array(gap(F.col("event_type"), F.col("value") > 10), gap(F.lit("any"), F.lit(True)))).alias("gaps"))


@query(_GAPS)
def st3_gap_demand(t: Tables):
    return E.gap_demand(_gaps(t))


@query(f"SELECT *, row_number() OVER (ORDER BY wanted DESC, entity_id, missing_fact) AS rank FROM ({_GAPS})")
def st3_gap_queue(t: Tables):
    """The events arrive in four batches; counts are state of the stream, what each batch changes is upserted."""
    arriving, root = E.scratch(t.spark, "gaps-arriving"), E.scratch(t.spark, "gaps-wanted")
    _gaps(t).repartition(4).write.parquet(arriving)
    stream = t.spark.readStream.schema(_gaps(t).schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    E.stream_gap_demand(stream, root, root + "-progress", whole_every=3).awaitTermination()
    return E.gap_queue(t.spark, root).withColumn("rank", F.col("rank").cast("long"))
