"""Typed fact values: encoding, decoding, coercions; scores; vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"numeric": "value_number", "text": "value_text", "bool": "value_bool", "tags": "value_tags", "score": "value_score"}
#: Accepted aliases of value types.
ALIASES = {"number": "numeric", "boolean": "bool"}


def _type(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.lower(c)], F.lower(c))


def encode_value(df: DataFrame) -> DataFrame:
    """Fills ``value_text`` with the rendering of the typed column; tags are joined by a space, a score is followed by its explanation."""
    kind = _type(F.col("value_type"))
    number = F.regexp_replace(F.format_string("%.6f", F.col("value_number")), r"\.?0+$", "")
    score = F.concat_ws(" ", F.regexp_replace(F.format_string("%.6f", F.col("value_score")), r"\.?0+$", ""), "value_score_explanation")
    text = F.when(kind == "numeric", number).when(kind == "bool", F.col("value_bool").cast("string")).when(kind == "tags", F.array_join("value_tags", " ")).when(kind == "score", score).otherwise(F.col("value_text"))
    return df.withColumn("value_type", kind).withColumn("value_text", text)


def decode_value(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): the column that the type names has to be filled, and a known type named."""
    kind = _type(F.col("value_type"))
    valid = F.lit(False)
    for name, column in TYPES.items():
        valid = F.when(kind == name, F.col(column).isNotNull()).otherwise(valid)
    valid = F.coalesce(valid, F.lit(False))
    return df.filter(valid).withColumn("value_type", kind), df.filter(~valid)


def as_number(df: DataFrame) -> Column:
    """Numeric or score, finite only."""
    v = F.coalesce("value_number", "value_score")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def as_tags() -> Column:
    """Trimmed tags, blank ones dropped; a text is one tag."""
    return F.filter(F.transform(F.coalesce("value_tags", F.array("value_text")), lambda x: F.trim(x)), lambda x: x != "")


def saturate(v: Column, higher_is_better: bool = True) -> Column:
    """0.5 + 0.5 v / (1 + |v|), mirrored for lower-is-better."""
    half = 0.5 * v / (1 + F.abs(v))
    return F.lit(0.5) + (half if higher_is_better else -half)


def cosine(a: Column, b: Column) -> Column:
    """0 when lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def hash_embed(docs: DataFrame, key: str, tokens: str, dims: int = 256) -> DataFrame:
    """(key, dim, weight): unigrams, and bigrams that weigh 1.25, hashed to ``dims`` signed buckets, length 1 per document; summed as rows, so that
    long documents need no wide state."""
    t = F.col(tokens)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    h = F.xxhash64("gram")
    # the outer form, as Spark makes the pairs once more to see whether an inner one has rows
    terms = docs.filter(F.size(t) > 0).select(key, F.explode_outer(F.concat(t, pairs)).alias("gram")).select(key, F.pmod(h, F.lit(dims)).cast("int").alias("dim"), (F.when(h.bitwiseAND(F.lit(1 << 40)) == 0, 1.0).otherwise(-1.0) * F.when(F.contains("gram", F.lit(" ")), 1.25).otherwise(1.0)).alias("w"))
    sums = terms.groupBy(key, "dim").agg(F.sum("w").alias("w")).filter("w <> 0")
    # a document's list has ``dims`` entries at most, however long its text
    whole = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("dim", "w")).alias("v")).filter(F.col(key).isNotNull())
    return whole.select(key, "norm", F.explode("v").alias("v")).select(key, "v.dim", (F.col("v.w") / F.col("norm")).alias("weight"))


def sentiment(rating: Column) -> tuple[Column, Column]:
    """A score from -1 to 1 of a rating 0-5, and its band."""
    score = F.when(rating.between(0, 5), (rating - 2.5) / 2.5)
    return score, F.when(score >= 0.4, "positive").when(score <= -0.2, "concern").when(score.isNotNull(), "mixed").otherwise("unknown")
