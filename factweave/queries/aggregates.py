"""Queries of the aggregations."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import Tables, query


@query("""WITH s AS (SELECT o_custkey AS owner, o_orderstatus AS status, count(*) AS n, sum(o_totalprice) AS area FROM orders GROUP BY ALL)
    SELECT owner, CAST(sum(n) AS BIGINT) AS projects, round(sum(area), 2) AS area, string_agg(concat(status, ':', n), ' ' ORDER BY concat(status, ':', n)) AS statuses FROM s GROUP BY owner""")
def a1_owner_aggregate(t: Tables):
    return A.owner_aggregate(t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("area"))).withColumn("area", F.round("area", 2))


@query("""SELECT l_suppkey AS builder, count(DISTINCT l_partkey) AS projects, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS registered, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS delayed,
    count(DISTINCT l_partkey) FILTER (l_discount > 0) AS with_complaints, max(l_linenumber) AS revocations FROM lineitem GROUP BY 1""")
def a2_portfolio(t: Tables):
    return A.portfolio(t.lineitem.select(F.col("l_suppkey").alias("builder"), F.col("l_partkey").alias("project"), (F.col("l_linestatus") == "F").alias("registered"), (F.col("l_returnflag") == "R").alias("delayed"), F.col("l_discount").alias("complaints"), F.col("l_linenumber").alias("revocations")))


@query("""SELECT entity_type, fact_key, count(DISTINCT entity_id) AS covered, total, round(CAST(count(DISTINCT entity_id) AS DOUBLE) / total, 6) AS share
    FROM facts JOIN entities USING (entity_id) JOIN (SELECT entity_type, count(*) AS total FROM entities GROUP BY 1) USING (entity_type) GROUP BY entity_type, fact_key, total""")
def a3_fact_coverage(t: Tables):
    return A.fact_coverage(t.facts, t.entities)


@query("SELECT 'node' AS kind, entity_type AS type, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'fact', fact_key, count(*) FROM facts GROUP BY 2")
def a4_graph_stats(t: Tables):
    return A.graph_stats(t.entities, t.edges, t.facts)


@query("SELECT label, count(*) AS n, count(embedding) AS embedded, count(DISTINCT len(embedding)) AS lengths FROM embeddings GROUP BY 1")
def a5_embedding_stats(t: Tables):
    return A.embedding_stats(t.embeddings, "label", "embedding")


@query("""SELECT fact_key, count(*) AS n, count(*) FILTER (confidence >= 0.6) AS confident, min(confidence) AS low, max(confidence) AS high, round(avg(confidence), 6) AS mean, count(DISTINCT source_type) AS sources,
    count(DISTINCT value_type) AS types, count(DISTINCT entity_id) AS entities, array_to_string(list_sort(list(DISTINCT entity_id))[1:5], ' ') AS examples FROM facts GROUP BY 1""")
def a6_fact_profile(t: Tables):
    return A.fact_profile(t.facts)


def _ranks(src: str, by: str, value: str, ranks: dict[str, str]) -> str:
    picks = ", ".join(f"max({value}) FILTER (rn = {r}) AS {name}" for name, r in ranks.items())
    return f"SELECT {by}, max(n) AS n, {picks} FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {src} WHERE {value} IS NOT NULL) GROUP BY {by}"


_NEAREST = {"least": "1", "median": "floor((n - 1) * 0.5::DOUBLE + 0.5) + 1", "p95": "floor((n - 1) * 0.95::DOUBLE + 0.5) + 1", "greatest": "n"}


@query(_ranks("listings", "kind", "price", _NEAREST))
def a7_distribution(t: Tables):
    return A.distribution(t.listings, ["kind"], "price")


@query(_ranks("(SELECT edge_type, node, count(*) AS degree FROM (SELECT edge_type, src AS node FROM edges UNION ALL SELECT edge_type, dst FROM edges) GROUP BY ALL)", "edge_type", "degree", _NEAREST))
def a8_degree_stats(t: Tables):
    return A.degree_stats(t.edges)


@query(_ranks("(SELECT 'all' AS scope, round((x1 - x0) * (y1 - y0), 6) AS area FROM zones)", "scope", "area", _NEAREST))
def a8_cell_sizes(t: Tables):
    return A.cell_sizes(t.zones)


@query(_ranks("listings", "entity_id", "price", {"median": "CAST(floor(n / 2) AS BIGINT) + 1"}))
def a9_upper_median(t: Tables):
    return A.upper_median(t.listings, ["entity_id"], "price")


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (c > 1) AS repeated, l_returnflag IN ('N', 'R') AS known FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) GROUP BY 1")
def a10_quality_report(t: Tables):
    return A.quality_report(t.lineitem, "l_orderkey", "l_returnflag", ["N", "R"])


@query("""SELECT reason, count(*) AS n FROM (SELECT 'late' AS reason FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'cheap' FROM lineitem WHERE l_extendedprice < 5000 UNION ALL SELECT 'discount' FROM lineitem WHERE l_discount > 0.05) GROUP BY 1""")
def a11_reason_counts(t: Tables):
    reasons = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "late"), F.when(F.col("l_extendedprice") < 5000, "cheap"), F.when(F.col("l_discount") > 0.05, "discount")))
    return A.reason_counts(t.lineitem.select(reasons.alias("reasons")))


@query("""SELECT m.src AS a, o.dst AS c, min(least(m.confidence, o.confidence)) AS confidence, count(DISTINCT m.dst) AS inputs FROM edges m JOIN edges o ON m.dst = o.src AND m.edge_type = 'bought' AND o.edge_type = 'supplied_by' GROUP BY ALL""")
def a12_compose_coverage(t: Tables):
    side = lambda kind, a, b: t.edges.filter(F.col("edge_type") == kind).select(F.col("src").alias(a), F.col("dst").alias(b), "confidence")
    return A.compose_coverage(side("bought", "a", "b"), side("supplied_by", "b", "c"))


@query("SELECT entity_id, count(fact_no) AS facts FROM entities LEFT JOIN facts USING (entity_id) GROUP BY 1")
def a13_fact_counts(t: Tables):
    return A.fact_counts(t.entities, t.facts)


_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(text, '[\x00-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: len(x) >= 2)"


def _tokens(docs, text="text"):
    """Runs of letters of at least two signs, as written."""
    return docs.withColumn("tokens", F.filter(F.split(F.regexp_replace(text, r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", " "), " "), lambda x: F.length(x) >= 2))


@query(f"""WITH d AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark) SELECT token, count(*) AS df, count(*) = 1 OR (count(*) <= 3 AND count(*) <= (SELECT count(*) FROM benchmark) * 0.15) AS distinctive FROM d GROUP BY 1""")
def a14_token_df(t: Tables):
    return A.token_df(_tokens(t.benchmark), "item_id", "tokens")


_GRAMS = f"""t AS (SELECT {_TOKENS} AS k FROM conversations), g AS (SELECT unnest(k) AS gram FROM t UNION ALL SELECT unnest([concat(k[i], ' ', k[i + 1]) FOR i IN range(1, len(k))]) FROM t UNION ALL SELECT unnest([concat(k[i], ' ', k[i + 1], ' ', k[i + 2]) FOR i IN range(1, len(k) - 1)]) FROM t), c AS (SELECT gram, count(*) AS n FROM g GROUP BY 1)"""


@query(f"WITH {_GRAMS} SELECT gram, n FROM c")
def a15_ngram_counts(t: Tables):
    return A.ngram_counts(_tokens(t.conversations), "tokens")


_THEMES = "(VALUES ('articles', 'the'), ('articles', 'la'), ('verbs', 'is'), ('verbs', 'was'), ('pairs', 'of the'), ('pairs', 'de la')) AS th(theme, term)"


def _themes(t: Tables):
    return t.spark.sql("SELECT * FROM (VALUES ('articles', 'the'), ('articles', 'la'), ('verbs', 'is'), ('verbs', 'was'), ('pairs', 'of the'), ('pairs', 'de la')) AS th(theme, term)")


@query(f"WITH {_GRAMS} SELECT theme, CAST(sum(n) AS BIGINT) AS score, count(*) AS terms FROM c JOIN {_THEMES} ON gram = term GROUP BY 1")
def a16_theme_scores(t: Tables):
    return A.theme_scores(A.ngram_counts(_tokens(t.conversations), "tokens"), _themes(t))


@query(f"WITH {_GRAMS} SELECT gram, n FROM c WHERE gram NOT IN (SELECT term FROM {_THEMES}) AND n >= 2 ORDER BY n DESC, gram LIMIT 40")
def a16_unmapped_terms(t: Tables):
    return A.unmapped_terms(A.ngram_counts(_tokens(t.conversations), "tokens"), _themes(t))


@query("""SELECT entity_id, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM (SELECT entity_id, round(0.5::DOUBLE * max(CASE WHEN source_type = 'registry' THEN 1 ELSE 0 END) + 0.25::DOUBLE * least(CAST(count(*) AS DOUBLE) / 25, 1) + 0.25::DOUBLE * max(confidence), 6) AS score FROM facts GROUP BY 1)""")
def a17_confidence_score(t: Tables):
    return A.confidence_score(t.facts, "registry")


_RANKED = "SELECT o_orderstatus AS mode, o_custkey AS query_id, concat(o_orderpriority, o_orderkey) AS id, CAST(row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM {orders}"


@query(f"""WITH r AS ({_RANKED.format(orders='orders')}), w AS (SELECT mode, query_id, id FROM r WHERE id LIKE '1%' OR id LIKE '2%'), f AS (SELECT mode, query_id, min(rank) AS rank FROM w LEFT JOIN (SELECT * FROM r WHERE rank <= 8) USING (mode, query_id, id) GROUP BY ALL)
    SELECT mode, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM f GROUP BY 1""")
def a18_rank_metrics(t: Tables):
    ranked = t.spark.sql(_RANKED, orders=t.orders)
    return A.rank_metrics(ranked.filter("rank <= 8"), ranked.filter("id LIKE '1%' OR id LIKE '2%'").select("mode", "query_id", "id"))


@query("""SELECT l_returnflag AS layer, l_linestatus AS category, CAST(l_linenumber AS STRING) AS mode, count(*) FILTER (l_discount < 0.05) AS passed, count(*) FILTER (NOT l_discount < 0.05) AS failed FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (CAST(l_linenumber AS STRING)), ())""")
def a19_check_summary(t: Tables):
    return A.check_summary(t.lineitem.select(F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").cast("string").alias("mode"), (F.col("l_discount") < 0.05).alias("passed")))


@query("SELECT l_orderkey AS case_id, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS bucket FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1")
def a20_failure_bucket(t: Tables):
    return A.failure_bucket(t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("layer"), (F.col("l_discount") < 0.05).alias("passed")), ["R", "A", "N"])


@query(_ranks("events", "event_type", "value", {"p50": "CAST(ceil((n - 1) * 0.5::DOUBLE) AS BIGINT) + 1", "p95": "CAST(ceil((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1", "p99": "CAST(ceil((n - 1) * 0.99::DOUBLE) AS BIGINT) + 1"}))
def a21_latency_summary(t: Tables):
    return A.latency_summary(t.events, ["event_type"], "value")


@query("""SELECT entity_id, CASE WHEN visibility = 'internal' THEN '' ELSE coalesce(txt, '') END AS searchable_text FROM entities LEFT JOIN (SELECT entity_id, string_agg(kv, ' ' ORDER BY kv) AS txt FROM (SELECT DISTINCT entity_id, concat(fact_key, ' ', value_text) AS kv FROM facts) GROUP BY 1) USING (entity_id)""")
def a22_searchable_text(t: Tables):
    return A.searchable_text(t.entities, t.facts)


_WORD_SUMS = ", ".join(f"sum(('0x' || substr(d, {8 * k + 1}, 8))::BIGINT)" for k in range(8))


@query(f"""WITH r AS (SELECT sha256(concat_ws('|', entity_id, fact_key, value_text, fact_no)) AS d FROM facts)
    SELECT sha256(concat_ws(',', count(*), {_WORD_SUMS})) AS fingerprint FROM r""")
def a23_fingerprint(t: Tables):
    return A.fingerprint(t.facts, ["entity_id", "fact_key", "value_text", "fact_no"])


@query("""SELECT source, count(*) AS evidence, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS langs, round(avg(quality), 6) AS rating, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS concern, max(n_chars) AS longest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def a24_summarize_entities(t: Tables):
    return A.summarize_entities(t.documents.join(t.labels.withColumnRenamed("quality", "rating"), "doc_id", "left"), "source")


@query("""WITH c AS (SELECT o_custkey AS registration, concat(year(o_orderdate), '-', quarter(o_orderdate)) AS quarter, o_orderstatus AS predicate, o_totalprice AS value FROM orders), p AS (SELECT registration, quarter, sum(value) FILTER (predicate = 'F') AS f, sum(value) FILTER (predicate = 'O') AS o FROM c GROUP BY ALL)
    SELECT registration, count(*) AS points, string_agg(s, ' ' ORDER BY s) AS series FROM (SELECT registration, concat_ws('/', quarter, coalesce(format('{:.2f}', f), '-'), coalesce(format('{:.2f}', o), '-')) AS s FROM p) GROUP BY 1""")
def a25_quarterly_series(t: Tables):
    return A.quarterly_series(t.orders.select(F.col("o_custkey").alias("registration"), F.concat_ws("-", F.year("o_orderdate"), F.quarter("o_orderdate")).alias("quarter"), F.col("o_orderstatus").alias("predicate"), F.col("o_totalprice").alias("value")), ["F", "O"])


@query("""SELECT * FROM (SELECT l_orderkey AS event_id, max(l_quantity) FILTER (l_linenumber = 1) AS one, max(l_quantity) FILTER (l_linenumber = 2) AS two, max(l_quantity) FILTER (l_linenumber = 3) AS three FROM lineitem GROUP BY 1) WHERE one IS NOT NULL AND two IS NOT NULL AND three IS NOT NULL""")
def a26_assemble_events(t: Tables):
    claims = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.element_at(F.array(*[F.lit(x) for x in ("one", "two", "three", "more", "more", "more", "more")]), F.col("l_linenumber")).alias("predicate"), F.col("l_quantity").alias("value"))
    return A.assemble_events(claims, ["one", "two", "three"])


@query("""WITH c AS (SELECT l_orderkey AS registration, l_returnflag AS unit, l_linestatus AS predicate, l_tax AS value FROM lineitem), d AS (SELECT DISTINCT a.registration, a.unit, round(a.value - b.value, 2) + 0.0 AS d FROM c a JOIN c b ON a.registration = b.registration AND a.unit = b.unit AND a.predicate = 'F' AND b.predicate = 'O')
    SELECT registration, unit, count(*) AS differences, count(*) = 1 AND min(d) = 0 AS matching FROM d GROUP BY ALL""")
def a27_reconcile(t: Tables):
    return A.reconcile(t.lineitem.select(F.col("l_orderkey").alias("registration"), F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("predicate"), F.col("l_tax").alias("value")), "F", "O")


@query("SELECT entity_id, source_type, count(value_text) AS facts, count(*) FILTER (value_number IS NULL) AS gaps, round(avg(confidence), 6) AS confidence FROM facts GROUP BY ALL")
def a28_evidence_snapshot(t: Tables):
    return A.evidence_snapshot(t.facts, ["entity_id", "source_type"])


@query("SELECT seller, min(coalesce(CASE WHEN kind = 'N' THEN price * 0.5 END, price)) AS low, max(coalesce(CASE WHEN kind = 'R' THEN price * 2 END, price)) AS high FROM listings GROUP BY 1")
def a29_price_band(t: Tables):
    return A.price_band(t.listings.select("seller", "price", F.when(F.col("kind") == "N", F.col("price") * 0.5).alias("price_min"), F.when(F.col("kind") == "R", F.col("price") * 2).alias("price_max")), ["seller"])


@query("SELECT source_type, entity_id, learned_on, fact_no FROM facts QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY learned_on DESC, fact_no DESC) = 1")
def a30_latest_by_source(t: Tables):
    return A.latest_by_source(t.facts, "source_type", "learned_on", "fact_no").select("source_type", "entity_id", "learned_on", "fact_no")


@query("SELECT entity_id, count(*) FILTER (bhk >= 2) AS attention, max(bhk) AS severity, coalesce(string_agg(DISTINCT CASE WHEN discount > 0.05 THEN kind END, ' ' ORDER BY CASE WHEN discount > 0.05 THEN kind END), '') AS primary_labels FROM listings GROUP BY 1")
def a31_label_summary(t: Tables):
    return A.label_summary(t.listings.select("entity_id", F.col("bhk").alias("severity"), (F.col("discount") > 0.05).alias("primary"), F.col("kind").alias("label")), "entity_id")


@query("SELECT lang AS lens, string_agg(DISTINCT source, ' ' ORDER BY source) AS themes, count(*) AS hits FROM documents GROUP BY 1")
def a32_group_by_lens(t: Tables):
    return A.group_by_lens(t.documents.select(F.col("lang").alias("lens"), F.col("source").alias("theme")))


@query("SELECT entity_id, fact_key, CAST(count(*) AS DOUBLE) AS signal FROM facts WHERE fact_key = 'order_status' GROUP BY ALL UNION ALL SELECT entity_id, fact_key, max(value_number) FROM facts WHERE fact_key = 'order_total' GROUP BY ALL HAVING max(value_number) > 0")
def a33_card_signals(t: Tables):
    return A.card_signals(t.facts, ["order_status"], ["order_total"])


@query("""WITH c(section, fact_key) AS (VALUES ('money', 'order_total'), ('state', 'order_status'), ('state', 'order_owner')), h AS (SELECT entity_id, fact_key, count(DISTINCT value_text) AS items FROM facts GROUP BY ALL)
    SELECT entity_id, section, CAST(sum(coalesce(items, 0)) AS BIGINT) AS items, count(*) FILTER (items IS NULL) AS missing FROM (SELECT DISTINCT entity_id FROM facts) CROSS JOIN c LEFT JOIN h USING (entity_id, fact_key) GROUP BY ALL HAVING sum(coalesce(items, 0)) > 0""")
def a34_evidence_sections(t: Tables):
    return A.evidence_sections(t.facts, t.spark.sql("SELECT * FROM (VALUES ('money', 'order_total'), ('state', 'order_status'), ('state', 'order_owner')) AS c(section, fact_key)"))


@query("""SELECT entity_id, fact_key AS section, count(*) AS shown, max(confidence) AS confidence, min(fact_no) AS first FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key, value_text ORDER BY confidence DESC, fact_no) = 1) GROUP BY ALL""")
def a35_registry_sections(t: Tables):
    return A.registry_sections(t.facts)


@query("SELECT entity_id, count(*) AS candidates, count(*) FILTER (discount <= 0.05) AS approved, count(*) FILTER (discount > 0.05) AS rejected, count(DISTINCT kind) AS kinds, count(*) FILTER (kind = 'N' AND discount <= 0.05) = 0 AS missing_hero FROM listings GROUP BY 1")
def a36_media_report(t: Tables):
    return A.media_report(t.listings.select("entity_id", "kind", F.when(F.col("discount") > 0.05, "discount").alias("reject_reason")), "entity_id", "N")


@query("SELECT concat('customer:', c_custkey) AS entity_id, count(fact_no) AS records FROM customer LEFT JOIN facts ON entity_id = concat('customer:', c_custkey) GROUP BY 1 HAVING count(fact_no) < 20")
def a37_thin_entities(t: Tables):
    return A.thin_entities(t.facts, t.entities.filter("entity_type = 'customer'"), "entity_id", 20)


@query("""WITH m(theme, coarse) AS (VALUES ('N', 'open'), ('A', 'closed'), ('R', 'closed')) SELECT entity_id, coarse, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, coarse) AS rank FROM (SELECT entity_id, coarse, sum(n) AS n FROM (SELECT entity_id, kind AS theme, count(*) AS n FROM listings GROUP BY ALL) JOIN m USING (theme) GROUP BY ALL) QUALIFY rank <= 1""")
def a38_rollup_themes(t: Tables):
    counts = t.listings.groupBy("entity_id", F.col("kind").alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    return A.rollup_themes(counts, t.spark.sql("SELECT * FROM (VALUES ('N', 'open'), ('A', 'closed'), ('R', 'closed')) AS m(theme, coarse)"), 1).withColumn("rank", F.col("rank").cast("long"))
