"""Queries of text recall and classification."""

from pyspark.sql import functions as F

from ..operators import texts as X
from ..operators.search import lexical_search
from .registry import Tables, query

_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: len(x) >= 2)"


def _queries(t: Tables):
    """All words of every benchmark item."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), X.tokens(F.col("text")).alias("tokens"))


_Q = f"q AS (SELECT item_id AS query_id, {_TOK.format('text')} AS tokens FROM benchmark)"


@query(f"SELECT doc_id, len(k) AS n, len(list_filter(k, lambda x: x IN ('the', 'of'))) AS stopped FROM (SELECT doc_id, {_TOK.format('text')} AS k FROM documents)")
def p28_tokens(t: Tables):
    k = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.size(F.filter(k, lambda x: x.isin("the", "of"))).cast("long").alias("stopped"))


@query()
def p28_stem(t: Tables):
    """Stems, and runs of two and three; tested on the published sample."""
    stems = X.stem(t.conversations.select("conv_id", "turn", X.tokens(F.col("text")).alias("tokens")), "tokens")
    return stems.withColumns({"pairs": X.stem_ngrams(F.col("tokens"), 2), "triples": X.stem_ngrams(F.col("tokens"), 3)})


@query()
def p29_stemmed_phrase(t: Tables):
    """P29 by stems: phrases of the documents in other forms."""
    docs = t.documents.select("doc_id", X.tokens(F.col("text")).alias("tokens"))
    return X.has_phrases(docs, "tokens", {"of_the": ["of", "the"], "licenses": ["Licensing", "under"]}).drop("tokens")


@query(f"SELECT doc_id, contains(concat(' ', array_to_string({_TOK.format('text')}, ' '), ' '), ' of the ') AS has FROM documents")
def p29_contains_phrase(t: Tables):
    from ..functions.text import contains_phrase

    return t.documents.select("doc_id", contains_phrase(X.tokens(F.col("text")), ["of", "the"]).alias("has"))


_FIELDS = "SELECT doc_id AS doc, text AS body, concat(source, ' ', lang) AS name, concat_ws(' ', 'quality ' || quality, CASE WHEN toxic = 1 THEN 'toxic' END) AS fact_keys FROM documents LEFT JOIN labels USING (doc_id)"
_ASKED = f"SELECT concat('item:', item_id) AS query_id, list_concat({_TOK.format('text')}, CASE WHEN item_id % 2 = 0 THEN ['en'] ELSE [] END) AS tokens FROM benchmark UNION ALL SELECT concat('site:', source), {_TOK.format("concat(source, ' quality')")} FROM (SELECT DISTINCT source FROM documents)"


@query(f"""WITH d AS ({_FIELDS}), q AS ({_ASKED}), k AS (SELECT doc, 'body' AS field, {_TOK.format('body')} AS k FROM d UNION ALL SELECT doc, 'name', {_TOK.format('name')} FROM d UNION ALL SELECT doc, 'fact_keys', {_TOK.format('fact_keys')} FROM d),
    i AS (SELECT field, token, doc, length, count(*) AS tf FROM (SELECT field, doc, len(k) AS length, unnest(k) AS token FROM k) GROUP BY ALL), c AS (SELECT field, count(*) AS docs, avg(len(k)) AS mean FROM k WHERE len(k) > 0 GROUP BY 1), f AS (SELECT field, token, count(*) AS df FROM i GROUP BY ALL),
    s AS (SELECT query_id, len(list_distinct(tokens)) AS terms, unnest(list_distinct(tokens)) AS token FROM q),
    r AS (SELECT query_id, doc, terms, count(DISTINCT token) AS n, string_agg(DISTINCT field, ',' ORDER BY field) AS fields, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM s JOIN i USING (token) JOIN f USING (field, token) JOIN c USING (field) GROUP BY ALL)
    SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, fields FROM r WHERE n = terms QUALIFY rank <= 10""")
def t1_lexical_search(t: Tables):
    """T1 over a document's text, its source and language, and its label keys: all words of every benchmark item, and of every source."""
    docs = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"), F.concat_ws(" ", "source", "lang").alias("name"), F.concat_ws(" ", F.concat(F.lit("quality "), "quality"), F.when(F.col("toxic") == 1, "toxic")).alias("fact_keys"))
    items = t.benchmark.select(F.concat(F.lit("item:"), "item_id").alias("query_id"), F.concat(X.tokens(F.col("text")), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>"))).alias("tokens"))
    sites = t.documents.select("source").distinct().select(F.concat(F.lit("site:"), "source").alias("query_id"), X.tokens(F.concat("source", F.lit(" quality"))).alias("tokens"))
    return lexical_search(docs, "doc", ["name", "body", "fact_keys"], items.unionByName(sites), 10).withColumn("rank", F.col("rank").cast("long"))


_FZ = "(a = b OR (length(a) >= 4 AND length(b) >= 4 AND (starts_with(a, b) OR starts_with(b, a) OR levenshtein(a, b) <= CASE WHEN greatest(length(a), length(b)) >= 8 THEN 2 ELSE 1 END)))"


#: ASCII words only: the checking engine counts edits in bytes.
_ASCII = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: len(x) >= 2)"


@query(f"""WITH a AS (SELECT item_id AS query_id, unnest(list_distinct({_ASCII})) AS a FROM benchmark), c AS (SELECT DISTINCT concat(conv_id, '-', turn) AS id, unnest({_ASCII}) AS b FROM conversations), e AS (SELECT query_id, a, id, 3 AS points FROM a JOIN c ON a = b), r AS (SELECT * FROM a ANTI JOIN e USING (query_id, a)),
    v AS (SELECT a, b FROM (SELECT DISTINCT a FROM r), (SELECT DISTINCT b FROM c) WHERE {_FZ}), z AS (SELECT DISTINCT query_id, a, id, 1 AS points FROM r JOIN v USING (a) JOIN c USING (b)) SELECT query_id, id, CAST(sum(points) AS BIGINT) AS points FROM (SELECT * FROM e UNION ALL SELECT * FROM z) GROUP BY ALL""")
def t2_token_recall(t: Tables):
    ascii_ = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)
    corpus = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), ascii_.alias("tokens")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return X.token_recall(t.benchmark.select(F.col("item_id").alias("query_id"), ascii_.alias("tokens")), corpus)


@query(f"""WITH {_Q}, n AS (SELECT query_id AS name_id, array_to_string(tokens, ' ') AS g FROM q WHERE len(tokens) > 1), d AS (SELECT doc_id AS text_id, concat(' ', array_to_string({_TOK.format('text')}, ' '), ' ') AS s FROM documents) SELECT text_id, name_id FROM d JOIN n ON contains(s, concat(' ', g, ' '))
    UNION SELECT text_id, name_id FROM d JOIN n ON length(s) <= length(g) + 2 AND contains(concat(' ', g, ' '), s) WHERE contains(trim(s), ' ')""")
def t3_phrase_recall(t: Tables):
    return X.phrase_recall(t.documents.select(F.col("doc_id").alias("text_id"), X.tokens(F.col("text")).alias("tokens")), _queries(t).withColumnRenamed("query_id", "name_id"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(p_type), 'a') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(p_name), 'steel') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 1.5 ELSE 0 END AS score FROM part")
def t4_field_score(t: Tables):
    return t.part.select("p_partkey", X.field_score(["a", "steel"], {"p_name": 3.0, "p_type": 1.5}).alias("score"))


@query("""WITH k AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS k FROM documents) SELECT doc_id, CASE WHEN len(list_filter(generate_series(1, len(k)), lambda i: starts_with(coalesce(k[i], ''), 'th') AND starts_with(coalesce(k[i + 1], ''), 'a'))) > 0 THEN 1.0 WHEN len(list_filter(k, lambda x: starts_with(x, 'th') OR starts_with(x, 'a'))) > 0 THEN 0.5 ELSE 0 END AS score FROM k""")
def t5_prefix_score(t: Tables):
    name = F.split(F.lower("text"), "[^a-z]+")
    return t.documents.select("doc_id", name.alias("k")).select("doc_id", X.prefix_score(F.col("k"), ["th", "a"]).alias("score"))


@query("""WITH n AS (SELECT concat('part:', p_partkey) AS entity_id, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS b, CASE WHEN p_partkey % 2 = 0 THEN concat('x', p_partkey % 1500, ' tower by someone') ELSE concat('y', p_partkey) END AS rest FROM part), a AS (SELECT entity_id, CASE WHEN entity_id LIKE '%7' THEN concat(b, ' ', rest) ELSE rest END AS full_name, regexp_replace(rest, '\\sby\\s.*$', '') AS alias FROM n)
    SELECT entity_id, alias FROM (SELECT *, count(*) OVER (PARTITION BY alias) AS c FROM a WHERE alias <> full_name AND length(alias) >= 4 AND alias <> 'y107') WHERE c = 1""")
def t6_make_aliases(t: Tables):
    b = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", " "))
    rest = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x"), F.col("p_partkey") % 1500, F.lit(" tower by someone"))).otherwise(F.concat(F.lit("y"), "p_partkey"))
    e = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("entity_id"), rest.alias("rest"), b.alias("builder"))
    named = e.select("entity_id", F.when(F.col("entity_id").endswith("7"), F.concat("builder", F.lit(" "), "rest")).otherwise(F.col("rest")).alias("name"))
    return X.make_aliases(named, e.select("entity_id", "builder"), ["y107"])


_TH = "(VALUES ('articles', 'the'), ('articles', 'la'), ('verbs', 'is'), ('pairs', 'of the')) AS th(theme, term)"
_TAGS = rf"g AS (SELECT doc_id AS doc, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS k FROM documents), tg AS (SELECT doc, theme, count(*) AS terms FROM g, {_TH} WHERE CASE WHEN contains(term, ' ') THEN contains(concat(' ', array_to_string(k, ' '), ' '), concat(' ', term, ' ')) ELSE list_contains(k, term) END GROUP BY ALL)"


def _tags(t: Tables):
    return X.tag_themes(t.documents, "doc_id", "text", t.spark.sql(f"SELECT * FROM {_TH}"))


@query(f"WITH {_TAGS} SELECT doc, theme, terms FROM tg")
def t7_tag_themes(t: Tables):
    return _tags(t)


@query(f"WITH {_TAGS}, m(theme, fact_key) AS (VALUES ('articles', 'has_articles'), ('verbs', 'has_verbs'), ('pairs', 'has_pairs')) SELECT doc, fact_key, round(greatest(0.2::DOUBLE, 0.45::DOUBLE - (row_number() OVER (PARTITION BY doc ORDER BY terms DESC, fact_key) - 1) * 0.03::DOUBLE), 6) AS confidence FROM tg JOIN m USING (theme)")
def t9_classify_terms(t: Tables):
    return X.classify_terms(_tags(t), t.spark.sql("SELECT * FROM (VALUES ('articles', 'has_articles'), ('verbs', 'has_verbs'), ('pairs', 'has_pairs')) AS m(theme, fact_key)"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license') OR contains(lower(x), 'the'))) AS n FROM documents")
def t10_snippets(t: Tables):
    return t.documents.select("doc_id", F.size(X.snippets(F.split("text", "\n"), ["license", "the"])).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'worthless') THEN 'concern' WHEN quality * 5.0 >= 4 THEN 'positive' WHEN quality * 5.0 < 4 THEN 'concern' WHEN contains(lower(text), 'good') OR contains(lower(text), 'the') THEN 'positive' ELSE 'neutral' END AS tone FROM documents LEFT JOIN labels USING (doc_id)")
def t11_tone(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", X.tone(F.col("text"), F.col("quality") * 5.0, ["idiot", "worthless"], ["good", "the"]).alias("tone"))


@query(f"""WITH {_Q}, p AS (SELECT concat(conv_id, '-', turn) AS place_id, list_distinct({_TOK.format('text')}) AS k FROM conversations), d AS (SELECT token FROM (SELECT DISTINCT item_id, unnest({_TOK.format('text')}) AS token FROM benchmark) GROUP BY 1 HAVING count(*) = 1),
    j AS (SELECT query_id, place_id, len(k) AS size, count(*) AS n, bool_or(t IN (SELECT token FROM d)) AS d FROM (SELECT query_id, unnest(list_distinct(tokens)) AS t FROM q) JOIN (SELECT *, unnest(k) AS t FROM p) USING (t) GROUP BY ALL),
    f AS (SELECT query_id, place_id, k FROM j JOIN p USING (place_id) WHERE n = size), g AS (SELECT DISTINCT a.query_id, a.place_id FROM f a JOIN f b ON a.query_id = b.query_id AND len(b.k) > len(a.k) AND list_has_all(b.k, a.k))
    SELECT query_id, place_id, round(CASE WHEN n = size THEN 1.0::DOUBLE ELSE CAST(n AS DOUBLE) / size * CASE WHEN d THEN 1 ELSE 0.4::DOUBLE END END, 6) AS score FROM j ANTI JOIN g USING (query_id, place_id)""")
def t12_resolve_places(t: Tables):
    from ..operators.aggregates import token_df

    places = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("place_id"), X.tokens(F.col("text")).alias("tokens"))
    single = token_df(t.benchmark.select("item_id", X.tokens(F.col("text")).alias("tokens")), "item_id", "tokens").filter("df = 1")
    return X.resolve_places(_queries(t), places, single)


@query("""WITH m AS (SELECT l_orderkey AS query_id, l_returnflag AS name, l_suppkey % 5 AS area, concat(l_partkey, '-', l_linenumber) AS id FROM lineitem), a AS (SELECT o_orderkey AS query_id, o_custkey % 5 AS area FROM orders) SELECT query_id, name, area, id FROM (SELECT m.*, count(*) OVER (PARTITION BY query_id, name) AS c FROM m JOIN a USING (query_id, area)) WHERE c = 1""")
def t13_disambiguate(t: Tables):
    m = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("name"), (F.col("l_suppkey") % 5).alias("area"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("id"))
    return X.disambiguate(m, t.orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 5).alias("area")))


@query("SELECT o_orderkey AS entity_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderpriority LIKE '1%' THEN 'planned' WHEN o_custkey - 800 > 365 THEN 'stalled' WHEN o_custkey - 800 > 0 THEN 'delayed' ELSE 'on time' END AS state, CASE WHEN o_orderstatus = 'F' THEN 'now' WHEN o_custkey - 800 > 0 THEN concat('late by ', o_custkey - 800, ' days') ELSE 'as planned' END AS timeline FROM orders")
def t14_home_state(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderpriority").startswith("1"), "New project").otherwise("Under way")
    return X.home_state(t.orders.select(F.col("o_orderkey").alias("entity_id"), status.alias("status"), (F.col("o_custkey") - 800).alias("delay")))


@query()
def t8_tag_themes_semantic(t: Tables):
    """The hash is Spark's own; tested against vectors made in one place."""
    themes = t.spark.sql("SELECT * FROM (VALUES ('articles', 'of the'), ('articles', 'de la'), ('verbs', 'it is'), ('verbs', 'was'), ('links', 'and the'), ('links', 'und')) AS th(theme, term)")
    return X.tag_themes_semantic(t.documents, "doc_id", "text", themes)
