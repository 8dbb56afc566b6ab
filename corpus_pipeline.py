"""From raw documents to token ids: five stages, each an operator of factweave.llm whose decisions take effect.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.exact_dedup import drop_copies
from factweave.llm.mixing import mixed
from factweave.llm.quality import drop_low_quality
from factweave.llm.simhash import drop_near_copies
from factweave.llm.tokens import encode_documents
from factweave.plans.cut import cut, release, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels beside the documents."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the text that they decode to."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), carry=["lang", "source"]).select("doc_id", "row.lang", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing to target weights", mixing), ("BPE encoding", encoding)]

#: The classifier's weights, the fingerprints and the draws of the mix are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``. What a stage wrote on the way, and its input, are removed once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written(spark)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
        release(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
