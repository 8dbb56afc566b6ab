import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from factweave.llm import exact_dedup as E
from factweave.llm import simhash as S


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_groups_are_those_of_equal_normalised_texts(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    got = E.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_keeps_whole_rows_once(docs, empty):
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter({norm(r.text): 1 for r in docs.collect()})
    unique = docs.filter("doc_id < 10")
    assert sorted(r.doc_id for r in E.drop_copies(unique).collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert E.exact_dedup(empty).count() == 0 and E.drop_copies(empty).count() == 0


def test_exact_beyond_the_broadcast_limit(real, monkeypatch):
    import factweave.plans.cut as cut

    monkeypatch.setattr(cut.sized_join, "__defaults__", (0,))
    got = {r.doc_id: r.keep_id for r in E.exact_dedup(real).collect()}
    first = {}
    for r in real.orderBy("doc_id").collect():
        first.setdefault(norm(r.text), r.doc_id)
    assert got == {r.doc_id: first[norm(r.text)] for r in real.collect()}


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, k, bits):
    fps = [fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, format(f, "016x"), least.get(find(i))) for i, ((doc, _), f) in enumerate(zip(rows, fps)))


def check(df, k, bits):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(df, shingle=k, max_bits=bits).collect())
    assert got == brute(rows, k, bits)


def test_simhash_against_brute_force(docs, real, empty):
    check(docs, 3, 2)
    check(real, 3, 2)
    check(real, 5, 6)
    assert S.simhash_components(empty).count() == 0


def test_simhash_links_of_crowds_and_of_probed_parts(spark, monkeypatch):
    """Crowds go by centres, and both layouts find the same links."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 30)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            f = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                f ^= int(np.int64(np.uint64(1) << np.uint64(bit)))
            fps.add(f)
    fps = sorted(fps)
    a = np.array(fps, np.int64).view(np.uint64)
    want = {(fps[i], fps[j]) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 2}

    def joined(edges):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            root[find(x)] = find(y)
        groups = defaultdict(set)
        for f in fps:
            groups[find(f)].add(f)
        return {frozenset(g) for g in groups.values()}

    classes = spark.createDataFrame([(f, 1) for f in fps], "fp long, least long")
    pairs = lambda df: {(r.a, r.b) for r in df.collect()}
    for dense in (2, 10_000):
        assert joined(pairs(S.links(classes, 2, dense))) == joined(want)
    real_allocate = S.allocate
    monkeypatch.setattr(S, "allocate", lambda w, p, n, b: real_allocate(w, p, n, b) if len(w) == 2 else (float("inf"), []))
    found = {(min(x, y), max(x, y)) for x, y in pairs(S.links(classes, 2, 10_000))}
    assert found == want


def test_simhash_thresholds_keep_the_pigeonhole():
    for widths, bits in (([32, 32], 2), ([21, 21, 22], 2), ([21, 21, 22], 6)):
        for pairs in ([0.0] * 3, [1e6, 0, 10], [5, 1e9, 1e9]):
            _, t = S.allocate(widths, pairs, 1000, bits)
            assert len(t) == len(widths) and sum(t) == bits - len(widths) + 1


def test_near_copies_leave_one_row(docs, empty):
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert got.count(10) == 1 and got.count(3) == 1 and not {4, 5, 7, None} & set(got)
    assert sorted(r.doc_id for r in S.drop_near_copies(docs.filter("doc_id < 10")).collect()) == [1, 3, 6, 9]
    assert S.drop_near_copies(empty).count() == 0


def near_groups(rows):
    """The groups of ids linked by a Jaccard similarity of 0.8 or more of their five-word shingles, over all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w)} if len(w) < 5 else {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    """``words`` with ``n`` of them, at least five apart, replaced by words of no other text."""
    out = list(words)
    for k in rng.choice(len(words) // 6, n, replace=False):
        out[6 * k + 2] = f"e{rng.integers(1 << 60)}"
    return out


def test_near_copies_with_edits_against_brute_force_jaccard(spark, real):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(25):
        base = [f"w{g}x{rng.integers(1 << 40)}" for _ in range(240)]
        rows += [base] + [edited(rng, base, n) for n in (1, 3, 4, 5, 6, 9)]
    line = "all of these texts hold this one line of eleven words".split()
    rows = [(k, " ".join(w[:50] + line + w[50:])) for k, w in enumerate(rows)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), real):
        want = near_groups([(r.doc_id, r.text) for r in df.collect()])
        assert {r.doc_id for r in S.drop_near_copies(df).collect()} == set(want.values())
        assert len(set(want.values())) < len(want)


def test_crowds_of_near_copies_join_their_original(spark):
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(1 << 40)}" for _ in range(240)]
    rows = [(k, " ".join(edited(rng, base, 4))) for k in range(300)] + [(900, " ".join(base))]
    rows += [(1000 + k, " ".join(base[:20] + [f"o{k}x{x}" for x in range(220)])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_groups(rows)
    assert {r.doc_id for r in S.drop_near_copies(df).collect()} == set(want.values()) and len(set(want.values())) == 201


def test_crowds_of_several_families_against_brute_force_jaccard(spark):
    """Families of near copies, some of them chains, and strangers that are half the same text: all of them share crowds."""
    rng = np.random.default_rng(9)
    common = [f"c{x}" for x in range(60)]
    rows = []
    for g in range(6):
        base = common + [f"g{g}x{rng.integers(1 << 40)}" for _ in range(180)]
        rows += [edited(rng, base, n) for n in rng.integers(0, 5, 45)]
        chain = base
        for _ in range(5):
            chain = chain[12:] + [f"t{rng.integers(1 << 40)}" for _ in range(12)]
            rows.append(chain)
    rows += [common + [f"s{k}x{x}" for x in range(20)] for k in range(150)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_groups(rows)
    assert {r.doc_id for r in S.drop_near_copies(df).collect()} == set(want.values())
    linked = S.components(S.near_pairs(df, "doc_id", "text", dense=4))
    assert {r.node: r.root for r in linked.collect()} == {i: w for i, w in want.items() if list(want.values()).count(w) > 1}
