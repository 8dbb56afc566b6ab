"""Cutting lineage through the cluster's shared folder, and joins whose broadcast is size-checked."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size is at most this.
BROADCAST_LIMIT = 32 << 20
#: Pairs that a task of ``split_join`` looks at.
PAIRS = 1 << 26
_WRITTEN: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where Spark runs in one process may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there is removed by ``release``, or when the driver's process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if id(spark) not in _WRITTEN:
        _WRITTEN[id(spark)] = []
        atexit.register(_remove, spark)
    _WRITTEN[id(spark)].append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows no longer depends on what came before."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """A mark for ``release``."""
    return len(_WRITTEN.get(id(spark), []))


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes what was written after the mark ``since``, but for the last ``keep`` paths. Only for what no DataFrame in use reads."""
    paths = _WRITTEN.get(id(spark), [])
    gone = paths[since : len(paths) - keep]
    _delete(spark, gone)
    _WRITTEN[id(spark)] = [p for p in paths if p not in gone]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def _remove(spark: SparkSession) -> None:
    """Deletes what ``cut`` wrote, through the file system of the shared folder, if the session still runs."""
    try:
        _delete(spark, _WRITTEN.pop(id(spark), []))
    except Exception:  # noqa: BLE001  the JVM has gone first: the folder's own clean-up is left
        return


def sized_join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, right_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join that broadcasts ``right`` only if its measured size allows; beyond it Spark shuffles and splits skew, whatever it takes the size
    of compressed files to be."""
    return left.join(F.broadcast(right) if right_bytes <= limit else right.hint("merge"), on, how)


def split_join(left: DataFrame, right: DataFrame, on: list[str], pairs: int = PAIRS) -> DataFrame:
    """Inner equi-join whose work is dealt evenly, whatever the sizes of the keys: a key of more than ``pairs`` pairs is dealt into parts by the hash of its
    left rows, and its right rows are copied into each part. Tasks follow the measured number of pairs, so neither a hot key nor a table that
    looks small, as rows before an ``explode`` or compressed files do, ends in one task or in a broadcast. Null keys meet nothing."""
    n = lambda df, name: df.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    sizes = cut(n(left, "__l").join(n(right, "__r"), on).withColumn("__pairs", F.col("__l").cast("double") * F.col("__r")), "join-sizes")
    hot = sizes.filter(F.col("__pairs") > pairs).select(*on, F.ceil(F.col("__pairs") / pairs).cast("int").alias("__parts"))
    total, rows, n_hot = sizes.agg(F.coalesce(F.sum("__pairs"), F.lit(0.0)), F.coalesce(F.sum(F.col("__l") + F.col("__r")), F.lit(0)), F.count(F.when(F.col("__pairs") > pairs, 1))).first()
    tasks = int(min(20000, max(1, -(-total // (pairs / 4)), -(-rows // (1 << 20)))))
    if not n_hot:  # a part that is 0 in all rows would be dropped from the keys, and all rows shuffled a second time
        return left.repartition(tasks, *on).hint("merge").join(right.repartition(tasks, *on), on)
    parts = F.coalesce("__parts", F.lit(1))
    a = sized_join(left, hot, on, "left", n_hot * 64).withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__parts")
    b = sized_join(right, hot, on, "left", n_hot * 64).withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    key = [*on, "__part"]
    return a.repartition(tasks, *key).hint("merge").join(b.repartition(tasks, *key), key).drop("__part")
