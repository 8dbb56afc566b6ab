"""Lexical recall, theme tagging and rule classification over tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_phrase
from ..plans.cut import cut, sized_join
from .joins import fuzzy_token

#: Stems that a task keeps from one batch to the next.
STEMS_KEPT = 1 << 17
#: Places whose tokens a task of ``resolve_places`` counts.
PLACES = 4096


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Runs of letters and digits, lower case, at least two signs, without stopwords."""
    t = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2)
    return F.array_except(t, F.array(*[F.lit(s) for s in stop])) if stop else t


def stem(df: DataFrame, column: str) -> DataFrame:
    """The tokens' English stems, in Arrow batches; a token is stemmed once, as long as ``STEMS_KEPT`` hold those that a task has met. A null list stays null, a null token too."""

    def run(batches):
        from ..functions.stemmer import stem as one

        known = {}
        for pdf in batches:
            if len(known) > STEMS_KEPT:
                known = {}
            met = {w for ws in pdf[column] if ws is not None for w in ws}
            known.update((w, None if w is None else one(w)) for w in met - known.keys())
            yield pdf.assign(**{column: [None if ws is None else [known[w] for w in ws] for ws in pdf[column]]})

    return df.mapInPandas(run, df.schema)


def has_phrases(df: DataFrame, column: str, phrases: dict[str, list[str]]) -> DataFrame:
    """Adds a column for each phrase, by name: whether the row's tokens hold its words in a row, by their stems on both sides."""
    from ..functions.stemmer import stem as one

    stemmed = stem(df, column)
    return stemmed.withColumns({name: contains_phrase(F.col(column), [one(w.lower()) for w in words]) for name, words in phrases.items()})


def stem_ngrams(c: Column, n: int) -> Column:
    """Runs of ``n`` stems, joined by a space; fewer stems give none."""
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.array_join(F.slice(c, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _fuzzy_keys(token: str) -> Column:
    """Keys that any two tokens which ``fuzzy_token`` matches have in common: the first four signs, for the prefixes, and what is left
    without any one sign, or without any two where the distance may be two; short tokens are their own key."""
    one = "transform(sequence(1, length({0})), {1} -> concat(substr({0}, 1, {1} - 1), substr({0}, {1} + 1)))"
    first = one.format(token, "i")
    both = f"flatten(transform({first}, w -> {one.format('w', 'j')}))"
    left = f"CASE WHEN length({token}) >= 6 THEN array_union({first}, {both}) ELSE {first} END"
    prefix = f"array(concat('^', substr({token}, 1, 4)), {token})"
    return F.expr(f"CASE WHEN length({token}) >= 4 THEN array_distinct(concat({prefix}, {left})) ELSE array({token}) END")


def token_recall(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """3 for each equal token, 1 for each fuzzy one of a query token that has no equal. Fuzzy pairs share a key of ``_fuzzy_keys``."""
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    c = corpus.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    exact = q.join(c, "token").select("query_id", "token", "id", F.lit(3).alias("points"))
    keyed = lambda df, name: df.select(F.col("token").alias(name), F.explode(_fuzzy_keys("token")).alias("key"))
    rest = q.join(exact.select("query_id", "token").distinct(), ["query_id", "token"], "left_anti")
    near = keyed(rest.select("token").distinct(), "token").join(keyed(c.select("token").distinct(), "other"), "key").filter(fuzzy_token(F.col("token"), F.col("other"))).select("token", "other").distinct()
    fuzzy = rest.join(near, "token").join(c.withColumnRenamed("token", "other"), "other").select("query_id", "token", "id", F.lit(1).alias("points")).distinct()
    return exact.unionByName(fuzzy).groupBy("query_id", "id").agg(F.sum("points").alias("points"))


def phrase_recall(texts: DataFrame, names: DataFrame, negated: DataFrame | None = None, head: int = 3) -> DataFrame:
    """(text_id, name_id), each once, where a name of two tokens or more, of any length, occurs as a phrase in the text, or such a
    text in the name. Pairs in ``negated`` (text_id, name_id) are left out."""
    inside = _contained(texts, names, head)
    around = _contained(names.select(F.col("name_id").alias("text_id"), "tokens"), texts.select(F.col("text_id").alias("name_id"), "tokens"), head)
    found = inside.unionByName(around.select(F.col("name_id").alias("text_id"), F.col("text_id").alias("name_id"))).distinct()
    return found.join(negated, ["text_id", "name_id"], "left_anti") if negated is not None else found


def _contained(texts: DataFrame, names: DataFrame, head: int) -> DataFrame:
    """Names of two tokens or more that occur as a phrase in a text; those longer than every text are left out first.

    An equi-join on the name's first ``head`` tokens; longer names are then looked for in the texts that it finds.
    """
    most = texts.agg(F.max(F.size("tokens"))).first()[0] or 0

    def of(n: int) -> Column:
        return F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.array_join(F.slice("tokens", i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = texts.select("text_id", F.explode(F.array_distinct(F.flatten(F.array(*[of(n) for n in range(2, head + 1)])))).alias("gram"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    named = names.filter(F.size("tokens").between(2, most)).select(
        "name_id",
        F.array_join(F.slice("tokens", 1, head), " ").alias("gram"),
        F.when(F.size("tokens") > head, spaced("tokens")).alias("whole"),
    )
    named = cut(named, "phrase-names")
    size = named.agg(F.sum(F.length("gram") + F.coalesce(F.length("whole"), F.lit(0)) + 64)).first()[0] or 0
    met = cut(sized_join(grams, named, ["gram"], "inner", size).select("text_id", "name_id", "whole").distinct(), "phrase-met")
    longer = met.filter("whole is not null").join(texts.select("text_id", spaced("tokens").alias("s")), "text_id").filter(F.contains("s", "whole"))
    return met.filter("whole is null").select("text_id", "name_id").unionByName(longer.select("text_id", "name_id").distinct())


def field_score(terms: list[str], weights: dict[str, float]) -> Column:
    """T4: the summed weights of the (term, field) pairs in which the field contains the term."""
    hits = [F.when(F.contains(F.lower(F.col(f)), F.lit(x)), w).otherwise(0.0) for x in terms for f, w in weights.items()]
    return reduce(lambda a, b: a + b, hits, F.lit(0.0))


def prefix_score(name: Column, terms: list[str]) -> Column:
    """T5: the longest run of query terms that begin consecutive name tokens, over the number of terms."""
    best = F.lit(0)
    for n in range(1, len(terms) + 1):
        for s in range(len(terms) - n + 1):
            run = terms[s : s + n]
            at = lambda i, run=tuple(run): reduce(lambda a, b: a & b, [F.coalesce(F.get(name, i + k).startswith(x), F.lit(False)) for k, x in enumerate(run)])
            best = F.when(F.exists(F.sequence(F.lit(0), F.greatest(F.size(name) - 1, F.lit(0))), (lambda f: lambda i: f(i))(at)), n).otherwise(best)
    return best / len(terms)


def make_aliases(entities: DataFrame, builders: DataFrame, protected: list[str], shortest: int = 4) -> DataFrame:
    """A name without its builder's prefix and cut at ' by '; long enough, not protected, and of one entity only."""
    j = entities.join(builders, "entity_id", "left")
    n = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    bare = F.when(n.startswith(F.concat(F.lower("builder"), F.lit(" "))), F.substr(n, F.length("builder") + 2)).otherwise(n)
    alias = F.trim(F.regexp_replace(bare, r"\sby\s.*$", ""))
    made = j.select("entity_id", alias.alias("alias"), n.alias("n")).filter((F.col("alias") != F.col("n")) & (F.length("alias") >= shortest) & ~F.col("alias").isin(protected))
    return made.withColumn("owners", F.count(F.lit(1)).over(Window.partitionBy("alias"))).filter("owners = 1").select("entity_id", "alias")


def tag_themes(docs: DataFrame, doc: str, column: str, themes: DataFrame) -> DataFrame:
    """Themes of a text: single terms equal a token, phrases of several words occur in a row. ``themes``: theme, term."""
    t = docs.select(F.col(doc).alias("doc"), F.split(F.lower(column), r"[^\p{L}\p{N}]+").alias("tokens"))
    grams = F.concat("tokens", F.when(F.size("tokens") > 1, F.zip_with(F.slice("tokens", F.lit(1), F.size("tokens") - 1), F.slice("tokens", F.lit(2), F.size("tokens") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))
    return t.select("doc", F.explode(F.array_distinct(grams)).alias("term")).join(themes, "term").groupBy("doc", "theme").agg(F.count(F.lit(1)).alias("terms"))


def classify_terms(tags: DataFrame, mapping: DataFrame, top: float = 0.45, step: float = 0.03, floor: float = 0.2) -> DataFrame:
    """Tags to fact keys, by count; confidence falls from ``top`` by ``step`` a rank to ``floor``."""
    j = tags.join(F.broadcast(mapping), "theme").withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("terms").desc(), "fact_key")))
    return j.select("doc", "fact_key", F.round(F.greatest(F.lit(floor), F.lit(top) - (F.col("rank") - 1) * step), 6).alias("confidence"))


def snippets(lines: Column, terms: list[str]) -> Column:
    """The lines that contain a term."""
    return F.filter(lines, lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(t)) for t in terms]))


def tone(text: Column, rating: Column, bad: list[str], good: list[str]) -> Column:
    """Concern terms, then the rating (below 4 is a concern), then positive terms; a null rating says nothing."""
    has = lambda ws: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in ws])
    return F.when(has(bad), "concern").when(rating >= 4.0, "positive").when(rating < 4.0, "concern").when(has(good), "positive").otherwise("neutral")


def resolve_places(queries: DataFrame, places: DataFrame, distinctive: DataFrame) -> DataFrame:
    """The share of a place's tokens that the query has, times 0.4 unless one of them is distinctive; full names count 1.

    A full name whose tokens are part of a longer full name of the same query is left out. Names of equal tokens are compared once.
    """
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).join(distinctive.select("token", F.lit(1).alias("d")).distinct(), "token", "left")
    q = cut(q, "places-asked")
    asked_bytes = q.agg(F.coalesce(F.sum(F.length("token") + 80), F.lit(0))).first()[0]
    named = cut(places.select("place_id", F.array_distinct("tokens").alias("name")), "places-named")
    # names are split into tokens once and dealt by their place, so that a task counts few places and counts are not shuffled
    p = named.repartition(max(1, -(-named.count() // PLACES)), "place_id").select("place_id", F.size("name").alias("size"), F.explode("name").alias("token"))
    j = sized_join(p, q, ["token"], "inner", asked_bytes)
    g = cut(j.groupBy("query_id", "place_id", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("d", F.lit(0))).alias("d")), "places-met")
    full = g.filter("n = size").join(named.select("place_id", F.sort_array("name").alias("name")), "place_id")
    full = cut(full.select("query_id", "place_id", "name"), "places-full")
    part = full.select("query_id", "name", F.explode("name").alias("token")).distinct()
    longer = part.select("query_id", F.col("name").alias("other"), "token").filter(F.size("other") > 1)
    inside = part.join(longer, ["query_id", "token"]).filter(F.size("other") > F.size("name"))
    inside = inside.groupBy("query_id", "name", "other").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("name"))
    gone = cut(full.join(inside, ["query_id", "name"], "left_semi").select("query_id", "place_id"), "places-gone")
    g = sized_join(g, gone, ["query_id", "place_id"], "left_anti", gone.count() * 160)
    return g.select("query_id", "place_id", F.round(F.when(F.col("n") == F.col("size"), 1.0).otherwise(F.col("n") / F.col("size") * F.when(F.col("d") == 1, 1.0).otherwise(0.4)), 6).alias("score"))


def disambiguate(matches: DataFrame, areas: DataFrame) -> DataFrame:
    """Of several matches of a name, the one compatible with the asked area, if exactly one is."""
    ok = matches.join(areas, ["query_id", "area"], "left_semi")
    return ok.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "name"))).filter("n = 1").drop("n")


def home_state(facts: DataFrame) -> DataFrame:
    """A state and a timeline from status text and delay in days."""
    s = F.lower("status")
    state = F.when(F.contains(s, F.lit("complete")), "ready").when(F.contains(s, F.lit("new")), "planned").when(F.col("delay") > 365, "stalled").when(F.col("delay") > 0, "delayed").otherwise("on time")
    return facts.select("entity_id", state.alias("state"), F.when(state == "ready", "now").when(F.col("delay") > 0, F.concat(F.lit("late by "), F.col("delay").cast("string"), F.lit(" days"))).otherwise("as planned").alias("timeline"))


def tag_themes_semantic(docs: DataFrame, doc: str, column: str, themes: DataFrame, least: float = 0.18, dims: int = 256) -> DataFrame:
    """Themes one of whose terms the text holds, word for word; and those that share a word with a term of theirs and whose hashed
    vector has a cosine of at least ``least`` with the text's. ``themes``: theme, term (one word or more). Only (text, theme) pairs that
    share a word are compared, by an equi-join."""
    from ..functions.values import hash_embed

    t = cut(docs.select(F.col(doc).alias("doc"), tokens(F.col(column)).alias("tokens")), "theme-tokens")
    words = themes.select("theme", tokens(F.col("term")).alias("phrase"))
    anchor = t.select("doc", F.explode("tokens").alias("word")).join(words.select("theme", F.explode("phrase").alias("word")).distinct(), "word").select("doc", "theme").distinct()
    anchor = cut(anchor, "theme-anchors")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    exact = anchor.join(words, "theme").join(t, "doc").filter(F.contains(spaced("tokens"), spaced("phrase"))).select("doc", "theme").distinct().withColumn("exact", F.lit(True))
    b = hash_embed(words.groupBy("theme").agg(F.flatten(F.sort_array(F.collect_set("phrase"))).alias("tokens")), "theme", "tokens", dims).withColumnRenamed("weight", "w")
    b = cut(b, "theme-vectors")
    # of a text's vector only the dims that a theme has go on: ``dims`` rows at most are broadcast
    a = hash_embed(t, "doc", "tokens", dims).join(F.broadcast(b.select("dim").distinct()), "dim", "left_semi")
    dots = anchor.join(b, "theme").join(a, ["doc", "dim"]).groupBy("doc", "theme").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("cosine"))
    found = anchor.join(dots, ["doc", "theme"], "left").join(exact, ["doc", "theme"], "left")
    return found.filter(F.coalesce("exact", F.lit(False)) | (F.col("cosine") >= least)).select("doc", "theme", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
