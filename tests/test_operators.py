"""Operators that SQL cannot state, on literal rows against plain loops; invariants and plans."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.functions.geo import haversine_km
from factweave.functions import values as V
from factweave.operators import aggregates as A
from factweave.operators import filters as C
from factweave.operators import graphs as G
from factweave.operators import joins as J
from factweave.operators import scoring as R
from factweave.operators import spatial as S
from factweave.operators import texts as T
from factweave.operators import windows as W
from factweave.plans.fixpoint import components
from factweave.sources import tables as P


def test_diversify_keeps_runs_short(spark):
    rows = [("q", r, g) for r, g in enumerate("aaabbbaaccaaab", 1)]
    got = [r.grp for r in W.diversify(spark.createDataFrame(rows, "query string, rank long, grp string"), "query", "grp", 8, 2).orderBy("position").collect()]
    waiting, want = [g for _, _, g in rows], []
    while waiting and len(want) < 8:
        k = next((k for k, g in enumerate(waiting) if want[-2:] != [g, g]), 0)
        want.append(waiting.pop(k))
    assert got == want


def test_previews_obey_joint_caps(spark):
    rows = [("s", f"d{k}", role, h) for k, (role, h) in enumerate([("plan", "1"), ("plan", "1"), ("plan", "2"), ("plan", "3"), ("map", "2"), ("map", "4"), ("note", "9")])]
    df = spark.createDataFrame(rows, "subject string, document_id string, role string, content_hash string")
    got = {r.document_id: r.left_out for r in W.select_previews(df, "subject", ["map", "plan"], 2, 3).collect()}
    assert got == {"d4": None, "d5": None, "d0": None, "d1": "content", "d2": "content", "d3": "total cap", "d6": "role"}


def test_branches_use_no_group_twice(spark):
    rows = [("a", 1, 0.9, 1, 0.5, 0.1), ("a", 2, 0.8, 1, 0.4, 0.9), ("a", 3, 0.7, 2, 0.1, 0.3), ("a", 4, 0.6, 3, 0.0, 0.2), ("b", 5, 0.1, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "anchor string, candidate long, score double, grp long, closer double, cheaper double")
    got = sorted((r.anchor, r.position, r.lens, r.candidate) for r in R.pick_branches(df, ["closer", "cheaper"], 0.2, 3, 5).collect())
    assert got == [("a", 1, "closer", 1), ("a", 2, "cheaper", 3), ("a", 3, "fallback", 2), ("b", 1, "fallback", 5)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (201, 202), (202, 201), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 201, 202: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


#: Words of the stemmer's published sample, each with its stem.
STEMS = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol consolations consol "
    "consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort "
    "conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant "
    "knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick "
    "knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot"
).split()


def test_stems(spark):
    from factweave.functions.stemmer import stem

    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    more = {"hopefulness": "hope", "cities": "citi", "running": "run", "generate": "generat", "communism": "communism", "skies": "sky", "dying": "die", "news": "news", "proceeding": "proceed", "gas": "gas", "this": "this", "ties": "tie", "cries": "cri", "hoping": "hope", "sensational": "sensat", "by": "by", "saying": "say", "youth": "youth", "boyish": "boyish", "agreed": "agre", "controlling": "control", "vietnamization": "vietnam", "dog's": "dog"}
    assert {w: stem(w) for w in more} == more
    df = spark.createDataFrame([(["hopefulness", "cities", "running", None, "is"],), (None,), ([],)], "t array<string>")
    assert [r.t for r in T.stem(df, "t").collect()] == [["hope", "citi", "run", None, "is"], None, []]
    got = T.stem(df, "t").select(T.stem_ngrams(F.col("t"), 2).alias("two"), T.stem_ngrams(F.col("t"), 6).alias("six")).collect()
    assert got[0].two[:2] == ["hope citi", "citi run"] and got[0].six == [] and got[2].two == []
    phrases = T.has_phrases(spark.createDataFrame([(["quick", "running", "dogs"],), (["dog", "run"],)], "t array<string>"), "t", {"p": ["Runs", "dog"]}).collect()
    assert [r.p for r in phrases] == [True, False]


def test_ranks_over_all_rows_need_no_single_task(spark):
    from factweave.plans.picks import in_order

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = in_order(df, [F.col("k").desc()], "rank")
    assert [r["rank"] for r in got.orderBy(F.desc("k")).collect()] == list(range(1, 1001))


def test_hashed_vectors_have_length_one_and_follow_the_text(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["z"])], "k long, t array<string>")
    rows = V.hash_embed(df, "k", "t").collect()
    v = {k: {r.dim: r.weight for r in rows if r.k == k} for k in (1, 2, 3)}
    assert v[1] == v[2] != v[3] and all(abs(sum(x * x for x in w.values()) - 1) < 1e-9 for w in v.values())


def test_blocks_against_a_plain_parser(spark):
    pages = [(1, "<article><p>Flat 2 bhk 950.5 sqft</p><p>none<b>bold</b></article>"), (2, ""), (3, None)]
    got = [(r.page_id, r.block, r.words, r.numbers, r.first_number, r.chars) for r in P.extract_blocks(spark.createDataFrame(pages, "page_id long, html string")).collect()]
    want = []
    for i, html in pages[:1]:
        for k, inner in enumerate(re.findall(r"(?is)<p>(.*?)(?=</?p>|</article>|$)", html)):
            text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", inner)).strip()
            n = re.findall(r"[0-9]+(?:\.[0-9]+)?", text)
            want.append((i, k, len(text.split(" ")), len(n), n[0] if n else None, len(text)))
    assert got == want


def test_knn_finds_far_neighbours(spark):
    left = spark.createDataFrame([("a", 12.0, 77.0), ("b", 50.0, 8.0)], "id string, lat double, lon double")
    right = spark.createDataFrame([("x", 12.01, 77.0), ("y", 13.0, 77.0), ("z", 51.0, 9.0)], "id string, lat double, lon double")
    got = sorted((r.left_id, r.rank, r.right_id) for r in S.knn_join(left, right, 2).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "y")]
    assert S.knn_join(left, right.limit(0), 2).count() == 0


def test_knn_equals_all_pairs_anywhere_and_at_hot_places(spark):
    import random

    rng = random.Random(1)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(90.0, 0.0), (90.0, 120.0), (0.0, 180.0), (0.0, -180.0), (-90.0, 5.0)]
    near = [(12.9 + rng.gauss(0, 0.001), 77.5 + rng.gauss(0, 0.001)) for _ in range(150)]
    rights = [(f"r{i:03d}", *p) for i, p in enumerate([*spots, *near, *([(12.9, 77.5)] * 60)])] + [(None, 1.0, 1.0), ("n", None, 1.0)]
    lefts = [(f"l{i:03d}", *p) for i, p in enumerate([*spots[::3], *near[::10], (12.9, 77.5), (12.9, 77.5), (-40.0, 10.0)])]
    kind = "id string, lat double, lon double"
    right, left = spark.createDataFrame(rights, kind), spark.createDataFrame(lefts, kind)
    km = F.round(haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 6)
    every = {}
    for r in left.alias("a").crossJoin(right.dropna().alias("b")).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), km.alias("km")).collect():
        every.setdefault(r.l, []).append((r.km, r.r))
    for k in (1, 4):
        got = {}
        for r in S.knn_join(left, right, k).collect():
            got.setdefault(r.left_id, {})[r["rank"]] = round(r.km, 6)
        for i, found in every.items():
            assert [got[i][n] for n in sorted(got[i])] == [x for x, _ in sorted(found)[:k]]
    assert sorted((r["rank"], r.right_id) for r in S.knn_join(left.filter("lat = 12.9 AND lon = 77.5"), right, 3).collect()) == [(n + 1, f"r{195 + n}") for n in range(3) for _ in range(2)]


def test_knn_candidates_stay_flat(spark):
    from factweave.operators import nearest as N

    grid = lambda n: N._on_cube(spark.range(n).select(F.concat(F.lit("p"), "id").alias("id"), (F.lit(12.0) + F.rand(3)).alias("lat"), (F.lit(77.0) + F.rand(4)).alias("lon")))
    left = grid(50).select("lat", "lon", "x", "y", "z")
    counts = []
    for n in (300, 30_000):
        own, more = N.candidates(left, grid(n), 3)
        counts.append((own.count() + more.count()) / 50)
    assert counts[1] < 2.5 * counts[0] and counts[1] < 400


def test_concave_subjects_are_clipped(spark):
    ring = lambda ps: [{"x": float(x), "y": float(y)} for x, y in [*ps, ps[0]]]
    zones = spark.createDataFrame([("L", ring([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]))], "zone_id string, ring array<struct<x: double, y: double>>")
    window = spark.createDataFrame([("w", ring([(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)]))], "zone_id string, ring array<struct<x: double, y: double>>")
    row = S.overlap_pairs(zones, window).first()
    assert abs(row.shared - 1.25) < 1e-9 and abs(row.ratio - 1.25 / 3) < 1e-9


def test_four_state_truth_tables(spark):
    one = spark.range(1)
    states = (C.UNSATISFIED, C.UNKNOWN, C.UNSUPPORTED, C.SATISFIED)
    assert one.select(C.and4().alias("a"), C.or4().alias("o")).first() == (C.SATISFIED, C.UNSATISFIED)
    for a in states:
        row = one.select(C.and4(F.lit(a), F.lit(C.SATISFIED)), C.or4(F.lit(a), F.lit(C.UNSATISFIED)), C.not4(C.not4(F.lit(a)))).first()
        assert tuple(row) == (a, a, a)


def test_quantities_and_nulls(spark):
    rows = [("1.2 Cr", 12_000_000.0), ("85 lakh", 8_500_000.0), ("40k", 40_000.0), ("7", 7.0), ("none", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, want double")
    assert [r[0] for r in df.select(X.parse_amount(F.col("s"))).collect()] == [w for _, w in rows]
    far = [("2 km", 2.0), ("300 m", 0.3), ("2 km or 3 km", None), ("far", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame(far, "s string, w double").select(X.parse_distance_km(F.col("s"))).collect()] == [w for _, w in far]


def test_pinned_scan_reads_listed_files_only(spark, tmp_path):
    rows = {"x": [(1, 7.5), (2, 0.5)], "y": [(3, 9.0)], "z": [(4, 8.0)]}
    for name, content in rows.items():
        spark.createDataFrame(content, "k long, v double").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    manifest = spark.createDataFrame([(str(tmp_path / f"{n}.parquet"), "done") for n in "xy"], "path string, status string")
    df = P.pinned_scan(spark, manifest, ".parquet", spark.createDataFrame([], "k long, v double").schema)
    assert sorted(map(tuple, df.filter("v > 1").collect())) == [(1, 7.5), (3, 9.0)]
    for bad in (manifest.unionByName(manifest), manifest.withColumn("status", F.lit("failed")), manifest.limit(0)):
        with pytest.raises(ValueError):
            P.pinned_scan(spark, bad, ".parquet", df.schema)


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("v"))
    one = lambda d: A.fingerprint(d, ["id", "v"]).first()[0]
    assert one(df) == one(df.orderBy(F.col("id").desc()).repartition(7)) != one(df.filter("id > 0"))
    assert one(df) != one(df.unionByName(df.filter("id = 3"))) and len(one(df.filter("id < 0"))) == 64


def test_picks_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("entity_id"), F.lit("k").alias("fact_key"), (F.col("id") % 3).cast("string").alias("source_type"), F.lit("u").alias("source_url"), (F.col("id") % 5 / 5).alias("confidence"), F.col("id").cast("string").alias("value_text"), F.lit("s").alias("skill_id"), F.col("id").alias("fact_no"))
    rows = lambda d: sorted(map(tuple, W.compact_facts(d).collect()))
    assert rows(df) == rows(df.repartition(11))


def test_joins_make_no_cartesian_product(spark):
    pts = spark.createDataFrame([("a", 12.0, 77.0)], "id string, lat double, lon double")
    names = spark.createDataFrame([("q", ["a", "b"])], "query_id string, tokens array<string>")
    plans = [S.radius_join(pts, pts, 1.0), J.fuzzy_join(names, names.withColumnRenamed("query_id", "entity_id")), J.price_band_join(*[spark.createDataFrame([(1, "x", 5.0)], "id long, area string, price double")] * 2)]
    for df in plans:
        assert "Cartesian" not in (text := df._jdf.queryExecution().toString()) and "NestedLoop" not in text


def test_closure_doubles_paths(spark):
    e = spark.createDataFrame([(str(k), "in", str(k + 1)) for k in range(9)], "src string, edge_type string, dst string")
    assert G.closure(e, ["in"]).count() == 45


def test_semantic_themes_need_an_anchor_and_a_cosine_or_the_very_term(spark):
    docs = spark.createDataFrame([(1, "the cat is here"), (2, "the the the the"), (3, "nothing"), (4, None), (5, "so it is " + " ".join(f"w{k}" for k in range(3000)))], "k long, text string")
    themes = spark.createDataFrame([("a", "the cat"), ("b", "it is"), ("c", "dog")], "theme string, term string")
    vector = lambda df, key: {k: {r.dim: r.weight for r in rows if r[0] == k} for rows in [V.hash_embed(df, key, "tokens").collect()] for k in {r[0] for r in rows}}
    d = vector(docs.select("k", T.tokens(F.col("text")).alias("tokens")), "k")
    v = vector(themes.select("theme", F.split("term", " ").alias("tokens")), "theme")
    shares, very = {(1, "a"), (1, "b"), (2, "a"), (5, "b")}, {(1, "a"), (5, "b")}
    want = {(k, t): round(sum(w * v[t].get(i, 0) for i, w in d[k].items()), 6) for k, t in shares}
    assert want[5, "b"] < 0.18
    got = {(r.doc, r.theme): r.cosine for r in T.tag_themes_semantic(docs, "k", "text", themes).collect()}
    assert got == {x: pytest.approx(c, abs=2e-6) for x, c in want.items() if c >= 0.18 or x in very}


def test_radius_join_over_the_whole_globe(spark):
    import math
    import random

    rng = random.Random(3)
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(150)] + [(200, 78.0, 15.0), (201, 78.0, 15.1), (202, 0.0, 179.999), (203, 0.0, -179.999), (204, 90.0, 0.0), (205, 89.99, 120.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for radius in (3.0, 700.0, 15000.0):
        want = {(a[0], b[0]) for a in points for b in points if km(a, b) <= radius}
        found = [(r.left_id, r.right_id) for r in S.radius_join(df, df, radius).collect()]
        assert len(found) == len(want) and set(found) == want
    nearest = {r.left_id: r.right_id for r in S.knn_join(df.filter("id = 202"), df.filter("id <> 202"), 1).collect()}
    assert nearest == {202: 203}


def test_diversify_keeps_the_rest(spark):
    rows = [(q, r, g) for q, text in (("p", "aaabbbaaccaaabaa"), ("q", "aab"), (None, "aaaaaaaaaab")) for r, g in enumerate(text, 1)]
    got = W.diversify_all(spark.createDataFrame(rows, "query string, rank long, grp string"), "query", "grp", 8, 2).collect()
    for q in ("p", "q", None):
        waiting, want = [(r, g) for k, r, g in rows if k == q], []
        while waiting and len(want) < 8:
            k = next((k for k, (_, g) in enumerate(waiting) if [x[1] for x in want[-2:]] != [g, g]), 0)
            want.append(waiting.pop(k))
        mine = sorted((r.position, r["rank"], r.grp) for r in got if r.query == q)
        assert mine == [(i, *x) for i, x in enumerate(want + waiting, 1)]


def test_diversify_looks_through_all_pending_rows(spark):
    rows = [("q", r, g) for r, g in enumerate("a" * 40 + "b" * 20, 1)]
    got = "".join(r.grp for r in W.diversify(spark.createDataFrame(rows, "query string, rank long, grp string"), "query", "grp", 8, 2).orderBy("position").collect())
    assert got == "aabaabaa"


def test_fuzzy_tokens_meet_whatever_differs(spark):
    q = spark.createDataFrame([(1, ["garden", "abcdefgh", "tree", "plan"])], "query_id long, tokens array<string>")
    c = spark.createDataFrame([("x", ["harden"]), ("y", ["xbcdefhg"]), ("z", ["bcdefghi"]), ("u", ["treehouse"]), ("v", ["plan", "plans"]), ("w", ["lane"])], "id string, tokens array<string>")
    assert {r.id: r.points for r in T.token_recall(q, c).collect()} == {"x": 1, "z": 1, "u": 1, "v": 3}


def test_shortest_paths_of_zero_and_more_hops(spark):
    e = spark.createDataFrame([("a", "t", "b"), ("b", "t", "c"), ("d", "t", "c"), ("a", "t", "e"), ("e", "t", "d"), ("e", "s", "a")], "src string, edge_type string, dst string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "c"), ("a", "d"), ("b", "e"), ("a", "z")], "a string, b string")
    got = {(r.a, r.b): (r.hops, r.path, r.relations) for r in G.shortest_path(e, pairs, 2).collect()}
    assert got == {("a", "a"): (0, "a", ""), ("a", "c"): (2, "a>b>c", "t>t"), ("a", "d"): (2, "a>e>d", "s>t"), ("b", "e"): (2, "b>a>e", "t>s")}


def test_walks_give_each_edge_once(spark):
    e = spark.createDataFrame([("a", "t", "b"), ("a", "s", "b"), ("a", "t", "b"), ("b", "t", "a"), ("b", "t", "c"), ("c", "t", "d"), ("b", "u", "z")], "src string, edge_type string, dst string")
    got = lambda types, d: sorted((r.anchor, r.depth, r.src, r.edge_type, r.dst) for r in G.walk_edges(e, spark.createDataFrame([("a",)], "node string"), types, d).collect())
    assert got(["t", "s"], 2) == [("a", 1, "a", "s", "b"), ("a", 1, "a", "t", "b"), ("a", 2, "b", "t", "a"), ("a", 2, "b", "t", "c")]
    assert got([], 2) == got(["t"], 0) == []


def test_keys_of_several_values(spark):
    from factweave.operators.windows import resolve_facts

    rows = [(1, "tag", "x", "u", "k", "a", 0.5), (2, "tag", "x", "u", "k", "b", 0.6), (3, "tag", "x", None, "k", "c", 0.9), (4, "tag", "x", None, "k", "c", 0.9), (5, "tag", "y", "u", None, "d", 0.1), (6, "one", "x", "u", "k", "e", 0.9), (7, "one", "y", "v", "k", "f", 0.95), (8, "one", "x", "v", "k", "g", 0.8)]
    facts = spark.createDataFrame([("e", *r) for r in rows], "entity_id string, fact_no int, fact_key string, source_type string, source_url string, skill_id string, value_text string, confidence double")
    assert sorted(r.fact_no for r in resolve_facts(facts, {"x": 0}, multi_value=["tag"], caps={"x": 0.7}).collect()) == [2, 4, 5, 6]


def test_images_kinds_and_nulls(spark):
    from factweave.operators import unpivot as U

    rows = [("https://x/floor.png", "", 10.0, 10.0, "official"), ("https://x/a.png", "logo", 2000.0, 2000.0, None), ("https://x/b.png", None, None, 5.0, "o")]
    got = [(r.kind, r.relevance) for r in U.score_images(spark.createDataFrame(rows, "url string, alt string, width double, height double, source string")).collect()]
    assert got == [("plan", 0.4), ("logo", 0.0), ("photo", 0.4)]


def test_phrases_of_any_length(spark):
    texts = spark.createDataFrame([(1, "we met at the old mill by the long river today".split()), (2, "the old mill by the road".split()), (3, []), (4, None)], "text_id int, tokens array<string>")
    names = spark.createDataFrame([("a", "the old mill by the long river".split()), ("b", ["old", "mill"]), ("c", ["mill"]), ("d", "by the road".split())], "name_id string, tokens array<string>")
    found = {tuple(r) for r in T.phrase_recall(texts, names).collect()}
    assert found == {(1, "a"), (1, "b"), (2, "b"), (2, "d")}
    assert T.phrase_recall(texts, names.limit(0)).count() == 0
    short = spark.createDataFrame([(7, ["lake", "park"]), (8, ["lake"]), (9, [])], "text_id int, tokens array<string>")
    longer = spark.createDataFrame([("n", "green lake park gate".split())], "name_id string, tokens array<string>")
    assert [tuple(r) for r in T.phrase_recall(short, longer).collect()] == [(7, "n")]
    negated = spark.createDataFrame([(7, "n")], "text_id int, name_id string")
    assert T.phrase_recall(short, longer, negated).count() == 0


def test_places_inside_longer_ones_go(spark):
    queries = spark.createDataFrame([("q", "near green lake park gate".split())], "query_id string, tokens array<string>")
    places = spark.createDataFrame([("lake", ["green", "lake"]), ("park", ["green", "lake", "park"]), ("gate", ["gate"]), ("twin", ["park", "lake", "green"]), ("far", ["lake", "north"])], "place_id string, tokens array<string>")
    single = spark.createDataFrame([("north",)], "token string")
    assert {(r.place_id, r.score) for r in T.resolve_places(queries, places, single).collect()} == {("park", 1.0), ("twin", 1.0), ("gate", 1.0), ("far", 0.2)}


def test_candidates_are_matched_once(spark):
    rows = [(1, ["a", "b"], 1), (2, ["a", "b"], 1), (3, ["a", "c"], 1), (4, ["z"], None), (5, None, 2)]
    s = spark.createDataFrame(rows, "subject int, tokens array<string>, locality int")
    found = {tuple(r) for r in J.match_candidates(s, s.withColumnRenamed("subject", "candidate"), same=True).collect()}
    assert found == {(1, 2, 1.0, "winner"), (2, 1, 1.0, "winner"), (3, 1, 0.65, "ambiguous")}


def test_fact_profile_names_few_entities(spark):
    rows = [("k", f"e{i % 7}", "s", "t", 0.5 + i % 2 * 0.2) for i in range(70)] + [(None, None, "s", "t", 0.1)]
    facts = spark.createDataFrame(rows, "fact_key string, entity_id string, source_type string, value_type string, confidence double")
    found = {r.fact_key: (r.n, r.confident, r.entities, r.examples) for r in A.fact_profile(facts).collect()}
    assert found == {"k": (70, 35, 7, "e0 e1 e2 e3 e4"), None: (1, 0, 0, "")}


def test_ranks_are_exact_over_groups_and_nulls(spark):
    values = {"a": [i * 7 % 101 for i in range(301)], "b": [4], None: [2, 2, 2, 9], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v int").repartition(5)
    found = {r.g: (r.n, r.least, r.median, r.p95, r.greatest) for r in A.distribution(df, ["g"], "v").collect()}
    at = lambda vs, q: sorted(vs)[int((len(vs) - 1) * q + 0.5)]
    assert found == {g: (len(vs), *(at(vs, q) for q in (0, 0.5, 0.95, 1))) for g, vs in values.items() if g != "none"}


def test_redaction_leaves_nothing_of_a_person(spark):
    names = ["Asha", "Asha Rao", " "]
    row = spark.createDataFrame([("Buyer ASHA RAO, 9876543210, asha@example.com, PAN ABCDE1234F, A/C No. 00AA-1122\n  address: 12 Sample Road\nSignature by asha\nSigned", None)], "a string, b string").select(X.redact(F.col("a"), names).alias("a"), X.redact(F.col("b"), names).alias("b"), C.privacy_ok(X.redact(F.col("a"), names), names[:2]).alias("ok"), C.privacy_ok(F.col("a"), names[:2]).alias("was"))
    got = row.first()
    assert got.a == "Buyer [name], [phone], [mail], PAN [identifier], [account]\n[line]\n[line]\n[line]" and got.b is None and got.ok and not got.was


def test_parsed_quantities(spark):
    texts = ["2,004-2,482", "2.59-3.53 Cr", "7", "none", None, "-5 km", "5 km", "1 km 2 km", "400kV;110000", "220000;x;66", ";", "5-6 crore"]
    got = {r.t: (tuple(r.r) if r.r else None, r.km, r.top) for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.parse_range(F.col("t"), 100.0).alias("r"), X.parse_distance_km(F.col("t")).alias("km"), X.max_tag_value(F.col("t")).alias("top")).collect()}
    assert got["2,004-2,482"][0] == (2004.0, 2482.0) and got["2.59-3.53 Cr"][0] == (259.0, 353.0) and got["5-6 crore"][0] == (500.0, 600.0) and got["7"][0] == (7.0, 7.0) and got["none"][0] is None and got[None] == (None, None, None)
    assert [got[x][1] for x in ("-5 km", "5 km", "1 km 2 km")] == [None, 5.0, None]
    assert [got[x][2] for x in ("400kV;110000", "220000;x;66", ";")] == [400.0, 220.0, None]


def test_rings_hold_their_holes_and_turn_the_right_way(spark):
    pts = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    square = lambda x, w: pts((x, x), (x, x + w), (x + w, x + w), (x + w, x), (x, x))
    rows = [(1, 1, "outer", square(0, 10)), (1, 2, "outer", square(4, 3)), (1, 3, "inner", square(3, 5)), (1, 4, "inner", square(5, 1)), (1, 5, None, pts((20, 0), (21, 0))), (1, 6, "outer", pts((19, 5), (20, 0))), (1, 7, "outer", pts((21, 0), (19, 5))), (1, 8, "inner", pts((0, 0))), (1, 9, "outer", pts((40, 0), (41, 0))), (1, 10, "outer", pts((39, 1), (40, 0))), (2, 1, "outer", None)]
    df = spark.createDataFrame(rows, "relation_id long, way_id long, role string, points array<struct<x: double, y: double>>")
    got = {r.ring_no: r for r in G.assemble_rings(df).collect()}
    area = lambda r: sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r.ring, r.ring[1:])) / 2
    assert {k: (r.role, r.closed, r.polygon_no, round(area(r), 6) if r.closed else None) for k, r in got.items()} == {0: ("outer", True, 0, 100.0), 1: ("outer", True, 1, 9.0), 2: ("outer", True, 2, 2.5), 3: ("outer", False, None, None), 4: ("inner", True, 0, -25.0), 5: ("inner", True, 1, -1.0)}
    assert [(p["x"], p["y"]) for p in got[3].ring] in ([(39.0, 1.0), (40.0, 0.0), (41.0, 0.0)], [(41.0, 0.0), (40.0, 0.0), (39.0, 1.0)])


def test_corridors_begin_at_the_nearest_line(spark):
    line = lambda i, *ps: (i, f"name {i}", [{"lat": a, "lon": b} for a, b in ps])
    lines = spark.createDataFrame([line("a", (0.0, 0.0), (0.0, 0.01)), line("b", (0.0, 0.011), (0.0, 0.05), (0.0, 0.1), (0.0, 0.2)), line("c", (0.3, 0.0), (0.3, 0.01)), line("d", (0.001, 0.0), (0.01, 0.0))], "line_id string, name string, points array<struct<lat: double, lon: double>>")
    anchors = spark.createDataFrame([("x", 0.0, -0.01), ("y", 5.0, 5.0), ("z", 0.3, 0.02)], "id string, lat double, lon double")
    got = {(r.anchor_id, r.line_id): (r.name, [p["at"] for p in r.points]) for r in G.stitch_lines(lines, anchors, radius_km=3.0).collect()}
    assert got == {("x", "a"): ("name a", [0, 1]), ("x", "b"): ("name a", [0, 1]), ("x", "d"): ("name a", [0, 1]), ("z", "c"): ("name c", [0, 1])}
    assert {k for k, _ in ((r.anchor_id, 0) for r in G.stitch_lines(lines, anchors, radius_km=3.0, most=2).collect())} == {"x", "z"}


def test_files_are_digested_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "_BLOCK", 1000)
    for name, n in (("empty", 0), ("one block, 100%20 é", 1000), ("many blocks", 123_457)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(n)))
    got = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in P.stat_artifacts(spark, f"file://{tmp_path}").collect()}
    assert got == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir() if f.name != "empty"}  # Spark lists no empty files


def test_corridors_keep_all_their_lines(spark):
    """of a corridor of more than 96 lines only 96 were kept."""
    rows = [(f"l{k:03}", "road", [{"lat": 0.0, "lon": k * 0.0001}, {"lat": 0.0, "lon": (k + 1) * 0.0001}]) for k in range(150)]
    lines = spark.createDataFrame(rows, "line_id string, name string, points array<struct<lat: double, lon: double>>")
    anchors = spark.createDataFrame([("x", 0.0, 0.0)], "id string, lat double, lon double")
    assert sorted(r.line_id for r in G.stitch_lines(lines, anchors).collect()) == [r[0] for r in rows]


def test_corridors_end_at_the_poles(spark):
    """lines numbered beyond the pole were taken for lines on the other side of it, or a turn of the globe further on."""
    line = lambda i, lat: (i, f"name {i}", [{"lat": lat, "lon": 77.4}, {"lat": lat, "lon": 77.41}])
    lines = spark.createDataFrame([line("b", 13.0), line("a", 373.0), line("c", 89.99), line("d", 90.01)], "line_id string, name string, points array<struct<lat: double, lon: double>>")
    anchors = spark.createDataFrame([("x", 13.001, 77.4), ("y", 89.99, 77.4)], "id string, lat double, lon double")
    assert {(r.anchor_id, r.line_id) for r in G.stitch_lines(lines, anchors).collect()} == {("x", "b"), ("y", "c")}
    assert {(r.line_id, r.root) for r in G.line_roots(lines).collect()} == {(k, k) for k in "abcd"}
