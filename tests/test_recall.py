"""Recall by channels against a plain loop over all items."""

import random

from factweave.functions.geo import haversine_km
from factweave.operators import recall as C
from pyspark.sql import functions as F

SCHEMA = "id long, area string, builder string, price long, lat double, lon double, text string, kind string"


def rows(n, seed):
    r = random.Random(seed)
    return [(k, r.choice([" North", "north", "south", None, ""]), r.choice(["a", "b", "c", None]), r.choice([None, 0, 1, 15, 16, 17, 256, r.randint(1, 9000), 10**9 + r.randint(0, 10**8)]), r.choice([None, 12.5, 12.5 + r.random() / 10]), 77.5, None, r.choice(["x", "X ", "y", "z"])) for k in range(n)]


def same(v):
    return (v or "").strip().lower()


def alike(a, b):
    group = lambda v: {"y": "z"}.get(same(v), same(v))
    return a[0] != b[0] and group(a[7]) == group(b[7])


def test_equal_scores_take_the_lowest_ids(spark):
    items = rows(300, 3)
    edges = [(k, t, k * 7 % d) for k in range(300) for t, d in (("s", 5), ("s", 11), ("o", 2))] + [(0, "s", 0)]
    df = spark.createDataFrame(items, SCHEMA)
    kind = [C.type_group(F.col("kind"), [["z", "y"]])]
    channels = [C.Channel("a", "area", 0.4, 9), C.Channel("b", "builder", 0.3, 7), C.Channel("p", "price", 0.2, 8, recall=False), C.Channel("n", "neighbor", 0.5, 6, edge_types=("s",))]
    got = C.recall(df.filter("id % 10 = 0"), df, channels, 12, spark.createDataFrame(edges, "src long, edge_type string, dst long"), kind).collect()
    targets = {k: {(t, d) for s, t, d in edges if s == k and t == "s"} for k in range(300)}
    tests = {
        "a": (0.4, 9, lambda a, b: same(a[1]) and same(a[1]) == same(b[1])), "b": (0.3, 7, lambda a, b: same(a[2]) and same(a[2]) == same(b[2])),
        "p": (0.2, 8, lambda a, b: a[3] and b[3] and -(-a[3] * 82 // 100) <= b[3] <= a[3] * 118 // 100), "n": (0.5, 6, lambda a, b: targets[a[0]] & targets[b[0]]),
    }
    want = []
    for a in items[::10]:
        found = {}
        for name, (score, cap, test) in tests.items():
            for b in [b for b in items if alike(a, b) and test(a, b)][:cap]:
                found.setdefault(b[0], {})[name] = score
        best = sorted((-round(sum(v.values()), 6), k, "+".join(sorted(v))) for k, v in found.items() if set(v) != {"p"})[:12]
        want += [(a[0], k, -s, names, i) for i, (s, k, names) in enumerate(best, 1)]
    assert sorted((r.anchor, r.candidate, r.score, r.channels, r["rank"]) for r in got) == sorted(want)


def test_price_intervals_cover_each_band_once(spark):
    r = random.Random(5)
    bands = [(k, lo, lo + r.choice([-1, 0, 1, 15, 16, 255, 300, 5000])) for k, lo in enumerate(r.choice([1, 16, 17, 4095, r.randint(1, 70000)]) for _ in range(60))]
    df = spark.createDataFrame(bands, "k long, low long, high long")
    for row in df.select("k", "low", "high", *[C._intervals("low", "high", n).alias(f"l{n}") for n in range(C.LEVELS)]).collect():
        covered = [p for n in range(C.LEVELS) for b in row[f"l{n}"] for p in range(b * 16**n, (b + 1) * 16**n)]
        assert sorted(covered) == list(range(row.low, row.high + 1))


def test_nearest_and_lexical_shares(spark):
    items = [(1, None, None, None, 12.0, 77.0, "red garden view", "x"), (2, None, None, None, 12.01, 77.0, "the red garden view view", "x"), (3, None, None, None, 12.02, 77.0, "red garden", "x"), (4, None, None, None, 12.5, 77.0, "Red Garden View", "y"), (5, None, None, None, None, 77.0, "", "x")]
    df = spark.createDataFrame(items, SCHEMA)
    anchors = df.filter("id IN (1, 5)")
    near = C.recall(anchors, df, [C.Channel("s", "spatial", 1.0, 5, km=2.0)], 9).collect()
    km = spark.range(1).select(haversine_km(F.lit(12.0), F.lit(77.0), F.lit(12.01), F.lit(77.0))).first()[0]
    assert [(r.anchor, r.candidate, r.score) for r in near] == [(1, 2, round(1 - km / 2, 6))]
    text = C.recall(anchors, df, [C.Channel("t", "lexical", 1.0, 5)], 9, alike=[F.col("kind")]).collect()
    assert [(r.anchor, r.candidate, r.channels) for r in text] == [(1, 2, "t")]
    assert C.recall(df.limit(0), df.limit(0), [C.Channel("a", "area", 1.0, 5), C.Channel("t", "lexical", 1.0, 5), C.Channel("s", "spatial", 1.0, 5)], 9).count() == 0


def test_counts_of_branches(spark):
    from factweave.operators.scoring import recall_counts

    df = lambda rows: spark.createDataFrame(rows, "query_id int, id int")
    branches = {"s": df([(1, 1), (1, 1), (1, 2)]), "l": df([(1, 2), (1, 3), (2, 9)]), "g": df([(1, 3), (1, 4)])}
    got = lambda need: sorted(tuple(r) for r in recall_counts(branches, need).collect())
    assert got(["g"]) == [(1, "g", 2, 1, 2), (1, "l", 2, 1, 1), (1, "s", 2, 2, 0), (2, "l", 1, 1, 0)]
    assert [r[4] for r in got([])] == [2, 2, 2, 1]


def test_relaxed_sets_of_several_areas(spark):
    from factweave.operators.scoring import relaxed_sets

    df = spark.createDataFrame([(1, "a", 100.0), (2, "b", 120.0), (3, "c", 100.0), (4, None, 100.0), (5, "d", 100.0), (6, "a", 500.0), (7, "b", None)], "id int, area string, price double")
    got = lambda **k: {r.id: r.relaxation for r in relaxed_sets(df, ["a", "b"], 90, 110, ["c"], 1.25, **k).collect()}
    assert got() == {1: "exact", 2: "wider budget", 3: "adjacent area", 4: "other area", 5: "other area"}
    assert got(labels={"exact": "x", "other": "o"}) == {1: "x", 3: "o", 4: "o", 5: "o"}
