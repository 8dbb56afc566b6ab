"""The search index against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factweave.operators import search as X

FIELDS = ("name", "body", "keys")


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if len(w) >= 2]


def scan(docs, queries, n):
    held = {d[0]: {f: words(t) for f, t in zip(FIELDS, d[1:])} for d in docs}
    size = {f: [len(x[f]) for x in held.values() if x[f]] for f in FIELDS}
    df = Counter((f, t) for x in held.values() for f in FIELDS for t in set(x[f]))
    out = []
    for q, tokens in queries:
        found = []
        for doc, x in held.items():
            if not tokens or not all(any(t in x[f] for f in FIELDS) for t in tokens):
                continue
            score = 0
            for f in FIELDS:
                for t in set(tokens):
                    if tf := x[f].count(t):
                        docs_n, mean = len(size[f]), sum(size[f]) / len(size[f])
                        score += math.log(1 + (docs_n - df[f, t] + 0.5) / (df[f, t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x[f]) / mean))
            found.append((-round(score, 6), doc, ",".join(sorted(f for f in FIELDS if set(tokens) & set(x[f])))))
        out += [(q, d, -s, r, f) for r, (s, d, f) in enumerate(sorted(found)[:n], 1)]
    return sorted(out)


def test_index_equals_a_full_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    pick = lambda k: " ".join(rng.choice(vocabulary[: rng.choice([3, 10, 30])]) for _ in range(rng.randrange(k)))
    docs = [(i, pick(4) or None, pick(30) + (" rare" if i % 97 == 0 else ""), pick(3)) for i in range(600)]
    queries = [(f"q{i}", rng.sample(vocabulary[:12], rng.randrange(1, 4))) for i in range(12)] + [("rare", ["rare", "w1"]), ("none", ["w1", "absent"]), ("empty", []), ("twice", ["w2", "w2"])]
    monkeypatch.setattr(X, "FIRST_BLOCKS", 1)
    folder = f"file://{tmp_path}/index"
    X.build_index(spark.createDataFrame(docs, "doc long, name string, body string, keys string"), "doc", list(FIELDS), folder, block_docs=20)
    asked = spark.createDataFrame(queries, "query_id string, tokens array<string>")
    for pushed in (2000, 0):
        monkeypatch.setattr(X, "PUSHED", pushed)
        got = sorted((r.query_id, r.doc, r.score, r.rank, r.fields) for r in X.search_index(spark, folder, asked, 5).collect())
        assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in scan(docs, queries, 5)]
        assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, scan(docs, queries, 5)))


def test_scan_of_postings_is_pushed_down(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    X.build_index(spark.range(50).select(F.col("id").alias("doc"), F.concat(F.lit("common word"), F.col("id").cast("string")).alias("name")), "doc", ["name"], folder)
    plan = spark.read.parquet(f"{folder}/postings").filter(F.col("token").isin(["word7"])).select("token", "block", "greatest")._jdf.queryExecution().executedPlan().toString()
    assert "In(token" in plan or "EqualTo(token" in plan and "entries" not in plan.split("ReadSchema")[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc long, name string")
    q = spark.createDataFrame([("a", ["x1"])], "query_id string, tokens array<string>")
    assert X.lexical_search(docs, "doc", ["name"], q, 3).count() == 0
    assert X.lexical_search(spark.createDataFrame([(1, "x1 x2")], "doc long, name string"), "doc", ["name"], q.limit(0), 3).count() == 0


def test_queries_of_the_same_words_are_one_search_of_equal_documents(spark, tmp_path, monkeypatch):
    """A word of every document, equal documents and equal queries: work follows the matches and the different queries."""
    folder = f"file://{tmp_path}/index"
    docs = spark.range(4000).select(F.col("id").alias("doc"), F.concat(F.lit("all c"), F.col("id") % 5, F.lit(" d"), F.col("id") % 7).alias("name"))
    X.build_index(docs, "doc", ["name"], folder, block_docs=500)
    built = spark.read.parquet(f"{folder}/postings")
    assert built.select(F.input_file_name().alias("f"), "block").distinct().count() == built.select("block").distinct().count()  # a block lies in one file
    kept = []
    monkeypatch.setattr(X, "cut", lambda df, label, cut=X.cut: kept.append((label, cut(df, label))) or kept[-1][1])
    asked = [(f"q{i:03}", [f"c{i % 5}", "all", f"d{i % 7}"] if i % 2 else [f"d{i % 7}", f"c{i % 5}", "all", "all"]) for i in range(200)] + [("one", ["all"])]
    got = sorted((r.query_id, r["rank"], r.doc) for r in X.search_index(spark, folder, spark.createDataFrame(asked, "query_id string, tokens array<string>"), 3).collect())
    want = [(q, r, d) for q, t in asked for r, d in enumerate([d for d in range(4000) if q == "one" or (f"c{d % 5}" in t and f"d{d % 7}" in t)][:3], 1)]
    assert got == sorted(want)
    assert dict(kept)["search-terms"].select("query_id").distinct().count() == 36


def test_only_postings_asked_for_are_shuffled(spark, tmp_path, monkeypatch):
    """above ``PUSHED`` words every join of a search shuffled the whole index, and blocks were packed into tasks by their compressed size."""
    folder = f"file://{tmp_path}/index"
    docs = spark.range(2000).select(F.col("id").alias("doc"), F.concat(F.lit("all own"), F.col("id"), F.lit(" of"), F.col("id") % 3).alias("name"))
    X.build_index(docs, "doc", ["name"], folder, block_docs=100)
    assert spark.read.parquet(f"{folder}/postings").select(F.input_file_name()).distinct().count() > 5
    kept = {}
    monkeypatch.setattr(X, "cut", lambda df, label, cut=X.cut: kept.setdefault(label, []).append(cut(df, label)) or kept[label][-1])
    monkeypatch.setattr(X, "PUSHED", 0)
    asked = spark.createDataFrame([("a", ["own7"]), ("b", ["of1", "own9", "all"]), ("c", ["own10", "of1"])], "query_id string, tokens array<string>")
    assert {(r.query_id, r.doc) for r in X.search_index(spark, folder, asked, 3).collect()} == {("a", 7), ("c", 10)}
    assert {r.token for r in kept["search-postings"][0].select("token").distinct().collect()} == {"own7", "own9", "own10", "of1", "all"}
    assert kept["search-need"][0].count() <= 5 * X.FIRST_BLOCKS * 3
