"""Work that is dealt evenly: hot keys, popular words, many groups, ties as they are shown."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave.functions.geo import rounded
from factweave.operators import aggregates as A
from factweave.operators import graphs as G
from factweave.operators import joins as J
from factweave.operators import scoring as R
from factweave.operators import spatial as S
from factweave.operators import texts as T
from factweave.operators import windows as W
from factweave.plans import cut as C


def plan(df):
    return df._jdf.queryExecution().toString()


def near_pole(spark, rows):
    return spark.createDataFrame([(k, 12.9 + a, 77.5 + b) for k, a, b in rows], "id string, lat double, lon double")


@pytest.fixture
def no_radius(monkeypatch):
    def fail(*_):
        raise AssertionError("all pairs within a radius were asked for")

    monkeypatch.setattr(S, "radius_join", fail)


def test_hot_keys_are_dealt_over_tasks(spark):
    """One key of nearly all rows ended in one task."""
    a = spark.range(300).select("id", F.when(F.col("id") < 290, 0).otherwise(F.col("id")).alias("k"))
    b = spark.range(200).select(F.col("id").alias("other"), F.when(F.col("id") < 195, 0).otherwise(F.col("id")).alias("k"))
    got = C.split_join(a, b, ["k"], pairs=5000)
    assert sorted(map(tuple, got.select("k", "id", "other").collect())) == sorted(map(tuple, a.join(b, "k").select("k", "id", "other").collect()))
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 3 and max(per_task) < 290 * 195 / 2


def test_radius_join_is_not_one_broadcast(spark):
    points = near_pole(spark, [(f"p{k}", k / 1000, 0.0) for k in range(20)])
    assert "Broadcast" not in plan(S.radius_join(points, points, 1.0)).split("== Physical Plan ==")[1]


def test_ties_as_shown_go_by_id(spark):
    """distances that differ below a millimetre are alike in the result, so the id decides."""
    left = near_pole(spark, [("s", 0.0, 0.0)])
    right = near_pole(spark, [("b", 0.01, 0.0), ("a", 0.01 + 2e-10, 0.0), ("c", 0.02, 0.0)])
    assert [r.right_id for r in S.nearest_core(left, right.withColumn("locality", F.col("id"))).collect()] == ["a"]
    assert [r.right_id for r in S.clip_context(left, right, 5.0, 2).orderBy("rank").collect()] == ["a", "b"]
    assert S.nearest_core(left, right.withColumn("locality", F.col("id")), 1.0).count() == 0


def test_what_measures_large_is_not_broadcast(spark):
    """above the limit Spark took compressed files for small and broadcast them through the driver."""
    small = spark.range(3).toDF("k")
    joined = C.sized_join(spark.range(9).toDF("k"), small, ["k"], "inner", C.BROADCAST_LIMIT + 1)
    assert "BroadcastHashJoin" not in plan(joined).split("== Physical Plan ==")[1] and joined.count() == 3


def test_paths_are_sent_as_lists(spark, monkeypatch):
    """each path was a row of the shuffle."""
    monkeypatch.setattr(A, "LISTED", 2)
    first = spark.createDataFrame([(f"a{k % 4}", f"b{k % 3}", k / 20) for k in range(12)], "a string, b string, confidence double")
    second = spark.createDataFrame([(f"b{k % 3}", f"c{k % 7}", 1 - k / 40) for k in range(30)], "b string, c string, confidence double")
    got = {(r.a, r.c): (r.confidence, r.inputs) for r in A.compose_coverage(first, second).collect()}
    want = first.alias("f").join(second.alias("s"), "b").groupBy("a", "c").agg(F.min(F.least("f.confidence", "s.confidence")).alias("confidence"), F.count_distinct("b").alias("inputs"))
    assert got == {(r.a, r.c): (r.confidence, r.inputs) for r in want.collect()}


def test_walks_build_no_frame_for_a_group(spark):
    """A frame for each group took milliseconds, and groups are many."""
    rows = spark.createDataFrame([(q, r, f"g{min(r // 2, 2)}") for q in range(3) for r in range(1, 9)], "q int, rank int, g string")
    ways = spark.createDataFrame([(1, 0, [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]), (1, 1, [(0.0, 2.0), (0.0, 0.0)])], "relation_id int, way_id int, points array<struct<x: double, y: double>>")
    docs = spark.createDataFrame([("s", k, "N", "same") for k in range(3)] + [("s", 9, None, "x")], "subject string, document_id int, role string, content_hash string")
    picks = spark.createDataFrame([(1, 5, 0.9, 0, 0.5)], "anchor int, candidate int, score double, grp int, closer double")
    found = [W.diversify(rows, "q", "g", 6, 1), G.assemble_rings(ways), W.select_previews(docs, "subject", ["N"], 2, 2), R.pick_branches(picks, ["closer"], 0.2, 1, 1)]
    assert all("FlatMapGroupsInPandas" not in plan(df) for df in found)
    assert [r.rank for r in found[0].filter("q = 1").orderBy("position").collect()] == [1, 2, 4, 3, 5, 6]
    assert [(r.closed, r.points, r.area) for r in found[1].collect()] == [(True, 4, 2.0)]
    assert sorted((r.document_id, r.left_out) for r in found[2].collect()) == [(0, None), (1, "content"), (2, "content"), (9, "role")]
    assert [tuple(r) for r in found[3].collect()] == [(1, 1, "closer", 5)]


def test_only_different_sets_of_tokens_meet(spark, monkeypatch):
    """subjects met every candidate that shares a word."""
    rnd = random.Random(3)
    rows = [(k, rnd.sample("abcde", rnd.randint(1, 4)), rnd.choice([1, 2, None])) for k in range(150)]
    df = spark.createDataFrame(rows, "subject int, tokens array<string>, locality int")
    met, whole = [], J.split_join
    monkeypatch.setattr(J, "split_join", lambda *a: met.append(whole(*a)) or met[-1])
    got = {r.subject: (r.candidate, r.score, r.state) for r in J.match_candidates(df, df.withColumnRenamed("subject", "candidate"), same=True).collect()}
    for k, t, at in rows:
        best = sorted((-round(0.7 * len(set(t) & set(u)) / len(t) + (0.3 if at is not None and at == bt else 0), 6), j) for j, u, bt in rows if j != k and set(t) & set(u))
        state = "rejected" if -best[0][0] < 0.5 else "ambiguous" if len(best) > 1 and -best[1][0] > -best[0][0] - 0.1 else "winner"
        assert got[k] == (best[0][1], -best[0][0], state)
    assert met[0].count() <= 30 * 30 * 4


def test_fuzzy_names_do_not_meet_over_a_common_word(spark, monkeypatch):
    """a word that all names share brought every two names together."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab1") for _ in range(rnd.randint(1, 9)))
    q = spark.createDataFrame([(k, ["common", word(), *(["x"] if k % 3 == 0 else [])]) for k in range(120)], "query_id int, tokens array<string>")
    e = spark.createDataFrame([(k, ["common" if k % 4 else "commons", word(), *(["x"] if k % 3 == 0 else [])]) for k in range(120)], "entity_id int, tokens array<string>")
    met, whole = [], J.split_join
    monkeypatch.setattr(J, "split_join", lambda *a: met.append(whole(*a)) or met[-1])
    got = sorted(map(tuple, J.fuzzy_join(q, e).collect()))
    zipped = F.arrays_zip("qt", "et")
    every = q.select("query_id", F.col("tokens").alias("qt")).crossJoin(e.select("entity_id", F.col("tokens").alias("et"))).filter(F.size("qt") == F.size("et"))
    want = every.filter(F.exists(zipped, lambda z: z["qt"] == z["et"]) & F.forall(zipped, lambda z: J.fuzzy_token(z["qt"], z["et"])))
    assert got == sorted(map(tuple, want.select("query_id", "entity_id").collect())) and got and met


def test_clauses_and_kinds_need_only_the_nearest(spark, no_radius):
    """of all places of a category within the radius only the nearest counts."""
    rnd = random.Random(5)
    left = near_pole(spark, [(f"s{k}", rnd.random() / 10, rnd.random() / 10) for k in range(30)])
    right = near_pole(spark, [(f"p{k}", rnd.random() / 10, rnd.random() / 10) for k in range(60)]).withColumn("category", F.concat(F.lit("kind"), F.length("id") % 2))
    got = {r.id: round(r.km, 9) for r in S.spatial_clauses(left, right, {"kind0": 4.0, "kind1": 2.0}).collect()}
    from factweave.functions.geo import haversine_km

    km = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    pairs = left.crossJoin(right.select("category", F.col("lat").alias("plat"), F.col("lon").alias("plon"))).withColumn("km", km)
    best = pairs.filter("km <= CASE category WHEN 'kind0' THEN 4.0 ELSE 2.0 END").groupBy("id").agg(F.count_distinct("category").alias("n"), F.min("km").alias("km")).filter("n = 2")
    assert got == {r.id: round(r.km, 9) for r in best.collect()} and got
    of_kinds = {(r.left_id, r.category): round(r.km, 9) for r in S.knn_join(left, right, 1, within=3.0, by="category").collect()}
    assert of_kinds == {(r.id, r.category): round(r.km, 9) for r in pairs.filter("km <= 3").groupBy("id", "category").agg(F.min("km").alias("km")).collect()}


def test_recall_queries_meet_the_nearest_only(spark, no_radius):
    """the queries made all pairs within a radius before they kept the best."""
    import __spark_entry__ as entry

    for name in ("r9_recall_candidates", "r10_pick_branches", "r6_multi_place_score"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_cells_of_a_radius_hold_mostly_pairs_within_it(spark, monkeypatch):
    """F8: cells twice as wide as the radius held five times as many pairs as lie within it."""
    joined = []
    monkeypatch.setattr(S, "split_join", lambda *a: joined.append(C.split_join(*a)) or joined[-1])
    rng = random.Random(5)
    a, b = (near_pole(spark, [(f"{n}{k}", rng.uniform(0, 0.4), rng.uniform(0, 0.4)) for k in range(400)]) for n in "ab")
    found = S.radius_join(a, b, 5.0)
    exact = a.select("id", "lat", "lon").crossJoin(b.select(F.col("id").alias("o"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))).filter(S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 5.0)
    assert sorted(map(tuple, found.select("left_id", "right_id").collect())) == sorted(map(tuple, exact.select("id", "o").collect()))
    assert joined[0].count() < 2.5 * exact.count()


def test_boundaries_of_a_word_that_all_share_are_dealt_over_tasks(spark, monkeypatch):
    """all pairs of a common word were sorted with their rings in the tasks that read the subjects; two common words gave a pair twice."""
    monkeypatch.setattr(S, "BOUNDARY_PAIRS", 500)
    joined = []
    monkeypatch.setattr(S, "split_join", lambda *a: joined.append(C.split_join(*a)) or joined[-1])
    subjects = near_pole(spark, [(f"s{k}", k / 10000, 0.0) for k in range(200)]).withColumn("name", F.concat(F.lit("Area North "), F.substring("id", 2, 9).cast("int") % 10))
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(77.4), F.col("lat") - 0.001), (F.lit(77.6), F.col("lat") - 0.001), (F.lit(77.6), F.col("lat") + 0.001), (F.lit(77.4), F.col("lat") + 0.001), (F.lit(77.4), F.col("lat") - 0.001))])
    polygons = near_pole(spark, [(f"z{k}", k / 500, 0.0) for k in range(10)]).select(F.col("id").alias("zone_id"), F.concat(F.lit("north area "), F.substring("id", 2, 9)).alias("name"), F.lit("way").alias("kind"), ring.alias("ring"), "lat", "lon")
    got = {r.id: r for r in S.select_boundary(subjects, polygons, 5.0).collect()}
    assert len(got) == 200 and all(r.zone_id == f"z{int(i[1:]) % 10}" and r.score == 1.0 for i, r in got.items())
    per_task = [r["count"] for r in joined[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 2 * 2000 + 200 and max(per_task) < 2000


def test_counts_of_shared_neighbours_follow_the_pairs(spark, monkeypatch):
    """the number of tasks did not grow with the pairs, so each held more of them."""
    monkeypatch.setattr(J, "SHARED_PAIRS", 1000)
    edges = spark.range(600).select(F.concat(F.lit("p"), F.col("id") % 200).alias("src"), F.lit("by").alias("edge_type"), F.concat(F.lit("s"), F.col("id") % 3).alias("dst"))
    anchors = spark.createDataFrame([(f"p{k}",) for k in range(50)], "node string")
    found = J.shared_neighbors(edges, ["by"], anchors)
    assert found.rdd.getNumPartitions() >= 30
    rows = found.collect()
    assert len(rows) == 50 * 199 and {r.shared for r in rows} == {3}


def test_neighbours_of_one_provider_are_shuffled_once_each_way(spark):
    """pairs were made distinct, joined and counted in shuffles of their own, and then all joined again with their counts."""
    pairs = spark.createDataFrame([("x", "p1"), ("x", "p2"), ("x", "q1"), ("y", "q1"), ("y", "p1"), ("x", "p1"), (None, "p1"), (None, "p2"), ("z", "r1"), ("z", "r2")], "a string, b string")
    providers = spark.createDataFrame([(k, k[0]) for k in ("p1", "p2", "q1", "x", "y")] + [("r1", None), ("r2", None)], "id string, provider string")
    found = G.ambiguous(pairs, providers)
    assert sorted(r.id or "" for r in found.collect()) == ["", "p1", "p2", "x", "z"]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_a_token_is_stemmed_once(monkeypatch):
    """every occurrence of a token was stemmed."""
    from factweave.functions import stemmer

    calls = []
    monkeypatch.setattr(stemmer, "stem", lambda w: calls.append(w) or w.upper())

    class Rows:
        schema = None

        def mapInPandas(self, run, schema):
            return list(run(iter([pd.DataFrame({"t": [["a", "b", "a", None], None]}), pd.DataFrame({"t": [["b", "c"], []]})])))

    assert [list(b["t"]) for b in T.stem(Rows(), "t")] == [[["A", "B", "A", None], None], [["B", "C"], []]]
    assert sorted(calls) == ["a", "b", "c"]


def test_a_quantity_is_matched_once(spark):
    """a text was matched anew for the number and for the unit."""
    from factweave.functions import text as X

    rows = ["1.2 Cr", "85\tlakh", "40K", "Rs 1,200", "2 lacs", "3.", "x", None, "about 4\n KM away", "-2 km", "7 metres", "1 km or 5 m", "0.5Kilometers", "12m", "from 3 by 5 to 9 cr"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = df.select("i", X.parse_amount(F.col("x")).alias("amount"), X.parse_distance_km(F.col("x")).alias("km"), X.parse_range(F.col("x"), 100.0).alias("r")).orderBy("i").collect()
    assert [r.amount for r in got] == [1.2e7, 85e5, 40e3, 1200.0, 2e5, 3.0, None, None, 4e3, 2e3, 7.0, 1e3, 500.0, 12.0, 3.0]
    assert [r.km for r in got] == [None] * 8 + [4.0, None, 0.007, None, 0.5, 0.012, None]
    assert [r.r and tuple(r.r) for r in got] == [(120.0, 120.0), (85.0, 85.0), (40.0, 40.0), (1200.0, 1200.0), (2.0, 2.0), (3.0, 3.0), None, None, (4.0, 4.0), (2.0, 2.0), (7.0, 7.0), (1.0, 5.0), (0.5, 0.5), (12.0, 12.0), (300.0, 900.0)]
    assert "regexp_extract(" in plan(df.select(X.parse_amount(F.col("x")))) and ", 2)" not in plan(df.select(X.parse_amount(F.col("x"))))


def test_a_variant_is_picked_from_few_columns(spark):
    """the picked row carried every column of the listing through the sort and the shuffle."""
    listings = spark.createDataFrame([("e", 2, "l1", 10.0, "long text"), ("e", 2, "l2", None, "long text"), ("e", 3, "l3", 5.0, "long text")], "entity_id string, bhk int, listing_id string, area_sqft double, note string")
    plans = spark.createDataFrame([("e", 2, "p1", 9.0, 0.5), ("e", 2, "p2", 11.0, 0.9), ("e", 2, "p3", None, 1.0), ("e", 2, "p0", 11.0, 0.9)], "entity_id string, bhk int, plan_id string, plan_area double, plan_confidence double")
    found = J.match_variant(listings, plans)
    assert sorted(map(tuple, found.collect()), key=str) == [("l1", "p0", 1.0), ("l2", "p3", None)]
    assert "note" not in found._jdf.queryExecution().optimizedPlan().toString().split("Project")[1].split("LogicalRDD")[0]


def counted(spark, df, column):
    """``df``, with a count of the rows of which ``column`` was made."""
    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    return df.withColumn(column, F.udf(one, df.schema[column].dataType)(column)), made


def test_places_are_split_into_tokens_once(spark):
    """F32: a name's tokens were made again for its joins, and for each token."""
    queries = spark.createDataFrame([("q", "near green lake park gate".split()), ("r", ["lake"])], "query_id string, tokens array<string>")
    places, made = counted(spark, spark.createDataFrame([("park", ["green", "lake", "park"]), ("far", ["lake", "north", "lake"]), ("none", [])], "place_id string, tokens array<string>"), "tokens")
    single = spark.createDataFrame([("north",), ("north",)], "token string")
    got = {tuple(r) for r in T.resolve_places(queries, places, single).collect()}
    assert got == {("q", "park", 1.0), ("q", "far", 0.2), ("r", "park", 0.133333), ("r", "far", 0.2)}
    assert made.value == 3


def test_texts_are_split_into_tokens_once_for_themes(spark):
    """a text was split for its words, its phrases, its vector and its vector's length."""
    docs, made = counted(spark, spark.createDataFrame([(1, "the cat is here"), (2, "nothing"), (3, None)], "k long, text string"), "text")
    themes = spark.createDataFrame([("a", "the cat"), ("b", "it is")], "theme string, term string")
    assert (1, "a") in {(r.doc, r.theme) for r in T.tag_themes_semantic(docs, "k", "text", themes).collect()}
    assert made.value == 3


def test_edges_of_a_walk_are_made_once(spark):
    """the edges were made for the walk and for the result; walks that meet in few nodes were sorted for each hop."""
    rows = [(f"p{k}", "in", f"s{k % 3}") for k in range(40)] + [(f"s{k}", "in", "n") for k in range(3)] + [("n", "in", "p0"), ("p1", "bought", "p2"), ("s0", "in", "p0")]
    edges, made = counted(spark, spark.createDataFrame(rows, "src string, edge_type string, dst string"), "dst")
    anchors = spark.createDataFrame([(f"p{k}",) for k in range(40)] + [("p3",), (None,)], "node string").distinct()
    found = G.walk_edges(edges, anchors, ["in"], 3)
    out, want = {}, set()
    for src, kind, dst in rows:
        if kind == "in":
            out.setdefault(src, []).append(dst)
    for a in (f"p{k}" for k in range(40)):
        depth, front = {a: 0}, [a]
        for d in range(3):
            want |= {(a, d + 1, n, "in", m) for n in front for m in out.get(n, [])}
            front = [m for m in {m for n in front for m in out.get(n, [])} if m not in depth]
            depth |= dict.fromkeys(front, d + 1)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert made.value <= len(rows)
    assert "SortMergeJoin" not in plan(found).split("== Physical Plan ==")[1]


def test_rows_of_even_keys_are_shuffled_once(spark):
    """a part that was 0 in all rows fell out of the join's keys, so both sides were shuffled twice, the second time into as many tasks as the session says."""
    a, b = (spark.range(90).select((F.col("id") % 30).alias("k"), F.col("id").alias(n)) for n in "ab")
    joined = C.split_join(a, b, ["k"], pairs=20)
    assert plan(joined).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 2 and joined.count() == 270


def test_a_pair_in_range_makes_no_text(spark):
    """each pair's distance went through decimals and texts, and the subject's id was split for each pair."""
    import __spark_entry__ as entry

    for name in ("j25_distance_between", "j7_near_join", "j9_radius_join"):
        physical = plan(entry.queries()[name](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
        pairs = physical.partition("SortMergeJoin")[0]
        assert "round(" not in pairs and "split" not in pairs, name


def test_a_radius_decides_as_the_distance_does(spark):
    """The straight line alone admits only what the distance admits, also at the edge and near the antipode; digits are those of F.round."""
    rng = random.Random(9)
    east = lambda km, k: (f"e{k}", 12.9, 77.5 + km / (111.19508 * 0.97476))
    right = spark.createDataFrame([east(4 + (k - 150) * 1e-9, k) for k in range(300)] + [(f"r{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)] + [("anti", -12.9, -102.5)], "id string, lat double, lon double")
    left = spark.createDataFrame([("l", 12.9, 77.5)], "id string, lat double, lon double").withColumn("more", F.lit(7))
    km = S.haversine_km(F.lit(12.9), F.lit(77.5), F.col("lat"), F.col("lon"))
    for radius in (4.0, 9000.0, 20015.0, 21000.0):
        got = S.radius_join(left, right, radius, ("more",)).select("right_id", F.round("km", 9), "more").collect()
        assert sorted(map(tuple, got)) == sorted((*r, 7) for r in right.filter(km <= radius).select("id", F.round(km, 9)).collect())
    values = spark.createDataFrame([(rng.uniform(0, 9),) for _ in range(2000)], "x double").select(rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    assert values.filter("a <> b").count() == 0


def test_every_part_is_matched(spark):
    """F8: of the parts only those whose id is divisible by 100 were matched."""
    import __spark_entry__ as entry

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    got = entry.queries()["j27_match_candidates"](spark, "/root/testdata/sf0.001")
    assert sorted(r.subject for r in got.collect()) == sorted(r.p_partkey for r in parts.collect())


@pytest.mark.parametrize("limit, kind", [(C.BROADCAST_LIMIT, "array<int>"), (0, "array<string>")])
def test_ends_travel_as_numbers(spark, monkeypatch, limit, kind):
    """the names of all ends, and a confidence for each, went with every (a, b)."""
    met, whole = [], A.split_join
    monkeypatch.setattr(A, "split_join", lambda *a: met.append(a[1]) or whole(*a))
    monkeypatch.setattr(A, "BROADCAST_LIMIT", limit, raising=False)
    monkeypatch.setattr(A, "LISTED", 3)
    first = spark.createDataFrame([(f"a{k % 4}" if k % 9 else None, f"b{k % 3}", k / 20) for k in range(12)], "a string, b string, confidence double")
    second = spark.createDataFrame([(f"b{k % 3}", f"c{k % 7}" if k % 8 else None, 0.4 if k % 3 else 1 - k / 40) for k in range(30)], "b string, c string, confidence double")
    got = {(r.a, r.c): (r.confidence, r.inputs) for r in A.compose_coverage(first, second).collect()}
    want = first.alias("f").join(second.alias("s"), "b").groupBy("a", "c").agg(F.min(F.least("f.confidence", "s.confidence")).alias("confidence"), F.count_distinct("b").alias("inputs"))
    assert got == {(r.a, r.c): (r.confidence, r.inputs) for r in want.collect()}
    assert met[0].schema["cs"].dataType.simpleString() == kind and {len(r.os) for r in met[0].collect()} == {1, 2, 3}


def test_equal_names_are_compared_once(spark, monkeypatch):
    """each two rows were compared, though names repeat."""
    rnd = random.Random(6)
    names = [["common", "".join(rnd.choice("ab1") for _ in range(rnd.randint(3, 7)))] for _ in range(25)] + [["common", None], []]
    q = spark.createDataFrame([(k, names[k % 27]) for k in range(200)], "query_id int, tokens array<string>")
    e = spark.createDataFrame([(f"e{k}", names[k * 5 % 27]) for k in range(150)], "entity_id string, tokens array<string>")
    met, whole = [], J.split_join
    monkeypatch.setattr(J, "NAMED", 2, raising=False)
    monkeypatch.setattr(J, "split_join", lambda *a: met.append(a[0]) or whole(*a))
    got = sorted(map(tuple, J.fuzzy_join(q, e).collect()))
    zipped = F.arrays_zip("qt", "et")
    every = q.select("query_id", F.col("tokens").alias("qt")).crossJoin(e.select("entity_id", F.col("tokens").alias("et"))).filter(F.size("qt") == F.size("et"))
    want = every.filter(F.exists(zipped, lambda z: z["qt"] == z["et"]) & F.forall(zipped, lambda z: J.fuzzy_token(z["qt"], z["et"])))
    assert got == sorted(map(tuple, want.select("query_id", "entity_id").collect())) and len(got) > 1000
    assert len(met) == 3 and met[1].count() <= 26 * 26
