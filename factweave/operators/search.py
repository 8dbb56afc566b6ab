"""Lexical search over fields: postings in blocks of documents with the greatest weight of each, kept in files, and exact block-max top-n.

Documents are dealt into blocks by the hash of their id. A row of the postings is a token in a field of a block: its documents with their weights, and the
greatest of these. A search reads those maxima first: their sum bounds every score in a block, and a block without some term can't match at all.
The blocks of the greatest bounds are scored; then only those whose bound reaches the n-th score found. So nothing is lost, and most postings
are not read. A file holds whole blocks, its rows sorted by token, so Parquet skips the pages without the tokens asked for. Queries of the same words are one search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import BROADCAST_LIMIT, cut, scratch, sized_join

#: Documents of a block, blocks of each query that are scored first, and tokens that are pushed down to the scan by name.
BLOCK_DOCS = 1024
FIRST_BLOCKS = 4
PUSHED = 2000
#: Tasks that write an index, at most.
TASKS = 10_000


def words(c: Column) -> Column:
    """Runs of letters and digits, lower case, at least two signs."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2)


def _by_field(fields: list[str]) -> Column:
    """A row ``f`` for each field with its words."""
    return F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])).alias("f")


def build_index(docs: DataFrame, doc: str, fields: list[str], folder: str, k1: float = 1.2, b: float = 0.75, block_docs: int = BLOCK_DOCS) -> None:
    """Writes the index of the text columns ``fields`` to ``folder``: postings, terms (token, field, df) and fields (field, docs, mean length).

    Ids are to be unique and not null. A null field is empty; a field's documents are those with a token in it. Weights are BM25 without the
    term's rarity: tf (k1 + 1) / (tf + k1 (1 - b + b length / mean)). A document's postings of a token meet in one block, so a token that all documents
    hold is as many rows as there are blocks.
    """
    spark = docs.sparkSession
    each = docs.select(_by_field(fields)).select("f.field", "f.t")
    each.filter(F.size("t") > 0).groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean")).coalesce(1).write.parquet(f"{folder}/fields")
    known = spark.read.parquet(f"{folder}/fields")
    blocks = max(1, -(-docs.count() // block_docs))
    # texts are dealt by blocks once; what follows groups within a block, so postings are not shuffled as rows. A task has about a block, whatever
    # the texts' compressed size, so that its counts stay in memory
    dealt = docs.withColumn("__block", F.pmod(F.xxhash64(doc), F.lit(blocks))).select("__block", doc, *fields).repartition(min(blocks, TASKS), "__block")
    terms = dealt.select(F.col("__block").alias("block"), F.col(doc).alias("doc"), _by_field(fields)).select("block", "doc", "f.field", "f.t")
    counts = terms.select("block", "doc", "field", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("block", "token", "field", "doc", "length").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    rows = counts.join(F.broadcast(known), "field").select("token", "field", "block", "doc", weight.alias("w"))  # a row a field
    grouped = rows.groupBy("block", "token", "field").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("greatest"), F.collect_list(F.struct("doc", "w")).alias("entries"))
    grouped.select("token", "field", "block", "n", "greatest", "entries").sortWithinPartitions("token", "field", "block").write.parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").groupBy("token", "field").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/terms")


def search_index(spark: SparkSession, folder: str, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, doc, score, rank, fields): for each query (query_id, tokens) the ``n`` documents of the highest scores that have every token in some field; ties by id.

    The score is BM25 summed over tokens and fields, to six decimals; ``fields`` are those that hold a token, in order of name. Queries without tokens give nothing.
    """
    sets = queries.select("query_id", F.array_sort(F.array_distinct("tokens")).alias("t"))
    least = sets.groupBy("t").agg(F.min("query_id").alias("set_id"))
    named = cut(sets.join(least, "t").select(F.col("query_id").alias("own_id"), F.col("set_id").alias("query_id"), "t"), "search-sets")
    q = named.filter("own_id = query_id").dropDuplicates(["query_id"]).select("query_id", F.size("t").alias("terms"), F.explode("t").alias("token"))
    q = cut(q, "search-terms")
    asked = cut(q.select("token").distinct(), "search-asked")
    count = asked.count()
    postings = spark.read.parquet(f"{folder}/postings")
    if count <= PUSHED:
        postings = postings.filter(F.col("token").isin([r.token for r in asked.collect()]))
    else:  # too many to be named: those asked for are taken out once, and no others are read or shuffled again
        postings = cut(sized_join(postings, asked, ["token"], "left_semi", count * 40), "search-postings")
    rarity = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = sized_join(spark.read.parquet(f"{folder}/terms"), asked, ["token"], "left_semi", count * 40)
    terms = cut(terms.join(F.broadcast(spark.read.parquet(f"{folder}/fields")), "field").select("token", "field", "df", rarity.alias("rarity")), "search-rarity")  # a row a field
    rarest = sized_join(q, terms.groupBy("token").agg(F.sum("df").alias("df")), ["token"], "inner", count * 48).groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("rarest"))
    term_bytes = terms.count() * 64

    maxima = sized_join(postings.select("token", "field", "block", "greatest"), terms, ["token", "field"], "inner", term_bytes).groupBy("token", "block").agg(F.sum(F.col("rarity") * F.col("greatest")).alias("most"))
    bounds = q.join(maxima, "token").groupBy("query_id", "block", "terms").agg(F.count(F.lit(1)).alias("held"), F.sum("most").alias("bound")).filter("held = terms")
    ranked = cut(bounds.select("query_id", "block", "bound", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")).alias("place")), "search-bounds")

    def score(blocks: DataFrame) -> DataFrame:
        """All matches of the queries in their blocks: the rarest token's documents, those of them that every token has, then these documents' weights."""
        ids = F.transform("entries", lambda e: e["doc"])
        blocks = cut(blocks, "search-blocks")
        need = cut(blocks.join(q, "query_id").select("token", "block").distinct(), "search-need")
        need_bytes = need.count() * 64
        # few are picked where they lie; of many, most are needed
        near = sized_join(postings, need, ["token", "block"], "left_semi", need_bytes) if need_bytes <= BROADCAST_LIMIT else postings
        firsts = blocks.join(rarest, "query_id").join(near.select(F.col("token").alias("rarest"), "block", "entries"), ["rarest", "block"])
        firsts = firsts.groupBy("query_id", "block").agg(F.array_distinct(F.flatten(F.collect_list(ids))).alias("able"))  # a list a field
        asked_of = cut(firsts.join(q, "query_id"), "search-asked-of")
        held = asked_of.join(near.select("token", "block", ids.alias("ids")), ["token", "block"]).select("query_id", "block", "terms", "token", F.array_intersect("able", "ids").alias("ids")).filter(F.size("ids") > 0)
        held = held.groupBy("query_id", "block", "terms", "token").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        lists = held.groupBy("query_id", "block", "terms").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == F.col("terms"))
        every = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
        sure = cut(lists.select("query_id", "block", every.alias("able")).filter(F.size("able") > 0), "search-matches")
        kept = F.when(F.size(F.array_intersect("able", ids)) == F.size("entries"), F.col("entries")).otherwise(F.filter("entries", lambda e: F.array_contains("able", e["doc"])))
        met = sure.join(q, "query_id").join(near, ["token", "block"]).select("query_id", "terms", "token", "field", F.explode(kept).alias("e"))
        met = sized_join(met, terms, ["token", "field"], "inner", term_bytes)
        found = met.groupBy("query_id", "terms", F.col("e.doc").alias("doc")).agg(F.count_distinct("token").alias("held"), F.round(F.sum(F.col("rarity") * F.col("e.w")), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
        return found.filter("held = terms").select("query_id", "doc", "score", "fields")

    first = cut(score(ranked.filter(F.col("place") <= FIRST_BLOCKS).select("query_id", "block")), "search-first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    floor = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == n).select("query_id", F.col("score").alias("floor"))
    rest = ranked.filter(F.col("place") > FIRST_BLOCKS).join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
    found = first.unionByName(score(rest.select("query_id", "block")))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return named.drop("t").join(top, "query_id").select(F.col("own_id").alias("query_id"), "doc", "score", "rank", "fields")


def lexical_search(docs: DataFrame, doc: str, fields: list[str], queries: DataFrame, n: int) -> DataFrame:
    """Builds the index in the shared folder and searches it once. Keep the folder of ``build_index`` where more searches follow."""
    folder = scratch(docs.sparkSession, "search-index")
    build_index(docs, doc, fields, folder)
    return search_index(docs.sparkSession, folder, queries, n)
