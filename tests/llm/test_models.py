import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from factweave.llm import class_lm as L
from factweave.llm import mixing as M
from factweave.llm import quality as Q


def test_targets_stop_at_the_ceiling(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 1000), ("c", 500), (None, 40)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in M.targets(sizes).collect()}
    s = {"a": 1000, "b": 10, "c": 500, None: 40}
    w = {"a": 3, "b": 1, "c": 2, None: 3}
    t, capped, left = {}, set(), 1.5 * sum(s.values())
    while True:
        free = [k for k in s if k not in capped]
        rest = left - sum(2 * s[k] for k in capped)
        t = {k: 2 * s[k] if k in capped else rest * w[k] / sum(w[x] for x in free) for k in s}
        over = {k for k in free if t[k] > 2 * s[k]}
        if not over:
            break
        capped |= over
    assert all(math.isclose(got[k][1], t[k], rel_tol=1e-9) and got[k][0] == s[k] for k in s)


def test_pivotal_keeps_words_and_expectations():
    size = np.array([900.0, 400, 350, 100, 90, 10, 5, 0])
    p = np.full(8, 0.4)
    total = np.zeros(8)
    for seed in range(3000):
        out, i = M.pivotal(p, size, np.random.default_rng(seed).random)
        assert math.isclose((out * size).sum(), (p * size).sum(), rel_tol=1e-6)
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != i)
        total += out
    assert np.abs(total / 3000 - p).max() < 0.05


def test_mix_reaches_targets(real, docs, empty):
    rows = M.mix(real).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in real.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == words[r.doc_id] and r.taken == r.copies * r["size"] <= 2 * r["size"]
        by[r.source].append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r["size"] for r in group) / 2
    assert sorted(M.mix(real).collect()) == sorted(rows)
    odd = M.mixed(docs)
    assert odd.columns == docs.columns and M.mix(docs).count() == docs.count()
    mixed = Counter(r.doc_id for r in M.mixed(real).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0


def test_quality_learns_from_text_alone(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in Q.quality_scores(real, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.93
    assert np.mean([got[r.doc_id].predicted for r in held if r.quality == 1]) > 0.97
    renamed = real.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("other"))
    assert all(math.isclose(r.score, got[r.doc_id].score, abs_tol=1e-6) for r in Q.quality_scores(renamed, labels).collect())
    kept = Q.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    odd = Q.quality_scores(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert Q.quality_scores(empty, labels).count() == 0
    unlabelled = Q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_ftrl_separates():
    rng = np.random.default_rng(1)
    rows = [(np.array([k % 2, 2 + int(rng.integers(50))]), np.array([1.0, 1.0]), k % 2) for k in range(400)]
    w = Q.ftrl(rows, bits=8)
    assert w[1] > 0 > w[0]


def test_base_score_and_counts(real, docs, empty):
    for df in (real, docs):
        rows = df.select("doc_id", "text").collect()
        tokens = [((r.text or "").encode().lower().split() + [b""]) for r in rows]
        out = [zlib.crc32((str(r.doc_id) if r.doc_id is not None else "null").encode()) % 7 == 2 for r in rows]
        c = Counter(t for ts, o in zip(tokens, out) if not o for t in ts)
        n, v = sum(c.values()), len(c)
        want = sorted((r.doc_id or -1, o, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 4)) for r, ts, o in zip(rows, tokens, out))
        got = L.score_documents(df).collect()
        assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score <= 0 for r in got)
    assert L.score_documents(empty).count() == 0


def brute_class_model(rows, classes, least, sweeps):
    """Brown exchange word by word over the whole text, each likelihood from scratch; log10 scores of the rows by hand."""
    texts = [(i, (t or "").encode().lower().split() + [b""], zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    lines = [[b"", *words] for _, words, out in texts if not out]
    n = Counter(w for line in lines for w in line[1:])
    order = sorted((w for w in n if w and n[w] >= least), key=lambda w: (-n[w], L.word_hash(w)))
    cls = defaultdict(lambda: 1, {b"": 0} | {w: 2 + k for k, w in enumerate(order[: classes - 2])})
    pairs = Counter(p for line in lines for p in zip(line, line[1:]))

    def likelihood():
        t = np.zeros((classes, classes))
        for (u, v), k in pairs.items():
            t[cls[u], cls[v]] += k
        return L._xlogx(t).sum() - L._xlogx(t.sum(0)).sum() - L._xlogx(t.sum(1)).sum(), t

    for _ in range(sweeps):
        for w in order:
            was, found = cls[w], {}
            for c in range(2, classes):
                cls[w] = c
                found[c] = likelihood()[0]
            best = max(found.values())
            cls[w] = was if found.get(was, -math.inf) >= best - 1e-9 else min(c for c in found if found[c] >= best - 1e-9)
    t = likelihood()[1]
    share = (t.sum(0) + 1) / (t.sum() + classes)
    step = (t + share) / (t.sum(1, keepdims=True) + 1)
    once, twice = (sum(k == x for k in n.values()) for x in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    rare = [w for w in n if cls[w] == 1]
    mass = {c: sum(n[w] for w in n if cls[w] == c) + (c == 1) for c in range(classes)}

    def emit(w):
        if w not in n:
            return (d * len(rare) + 1) / mass[1]
        return (n[w] - (d if cls[w] == 1 else 0)) / mass[cls[w]]

    return sorted((i or -1, round(sum(math.log10(step[cls[u], cls[v]] * emit(v)) for u, v in zip([b"", *words], words)), 4)) for i, words, _ in texts)


def test_class_scores_against_brute_force(spark):
    rng = np.random.default_rng(6)
    names = [[f"{k}{c}" for k in range(7)] for c in "abc"]
    rows = [(k, " ".join(str(rng.choice(names[(x + k) % 3])) for x in range(int(rng.integers(1, 30)))) + (" odd%d" % k) * (k % 2)) for k in range(60)]
    rows += [(None, "0a 0b unseen 0c"), (70, None), (71, ""), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, round(r.score, 4)) for r in L.score_documents(df, classes=6, least=3, sweeps=2).collect())
    assert got == brute_class_model(rows, 6, 3, 2)


def test_class_model_is_a_distribution_and_beats_the_base(spark, monkeypatch):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = real.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("rid"), F.col("text").cast("binary").alias("text"), (Q.remainder(F.col("doc_id"), 7) != 2).alias("train"))
    monkeypatch.setattr(L, "GROUP_WORDS", 3000)  # several groups move at once
    model, counts, _ = L.train_model(rows)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    place = dict(zip(model.listed.tolist(), model.cls.tolist()))
    mass, listed = np.zeros(L.CLASSES), 0
    for r in counts.collect():
        c = place.get(L.word_hash(bytes(r.word)), L.RARE)
        mass[c] += r.n - (model.discount if c == L.RARE else 0)
        assert (c != L.RARE) == (r.n >= L.LEAST_COUNT or not r.word)
    mass[L.RARE] += 10**model.unknown
    used = mass > 1
    assert np.allclose(mass[used] / (10**model.mass)[used], 1) and used.sum() > L.CLASSES / 2
    held = [r for r in L.score_documents(real).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_listed_words_are_bounded(spark):
    df = spark.createDataFrame([(f"w{k}".encode(), 100 if k < 5 else 20) for k in range(300)] + [(b"", 7)], "word binary, n long")
    listed, n = L._listed(df, 10, 100)
    assert len(set(listed.tolist())) == len(listed) <= 130 and L.word_hash(b"") in listed and (n == 100).sum() == 5


def test_mix_deals_rows_alike_and_takes_any_column_name(spark, monkeypatch):
    """Rows without an id, or alike in all columns, are dealt over buckets; columns may have the operator's own names."""
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)
    rows = [(None, f"a b {k}", "s") for k in range(100)] + [(1, "c d e f", "s")] * 100 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df).collect()
    assert len(got) == 201
    taken, target = sum(r.taken for r in got if r.source), next(r.target for r in got if r.source)
    assert abs(taken - target) <= 2
    unique = spark.createDataFrame([(k, "x y z", "s") for k in range(10)], "doc_id long, text string, source string").selectExpr("*", "1 AS id", "2 AS copies", "3 AS copy", "4 AS gone")
    assert M.mixed(unique).columns == unique.columns and M.mixed(unique).count() == 15
    from factweave.llm.rows import without

    assert without(unique, "doc_id", unique.select(F.col("doc_id").alias("id")).filter("id < 4"), "test").count() == 6


def test_features_keep_the_slot_of_repeats_apart():
    ids, _ = Q.features(" ".join(f"w{k} w{k}" for k in range(60_000)), Q.Words(), bits=8)
    assert len(set(ids.tolist())) == len(ids) and ids[-1] == 255 and Q.shape("a" * 70 + "!!") == Q.shape("a" * 10 + "!!") == "x!"
