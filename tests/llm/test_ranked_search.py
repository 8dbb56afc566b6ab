import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factweave.llm import ranked_search as R
from factweave.llm.queries import op13_ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("splits", [1, 5, 64])
def test_block_search_is_exact_and_prunes(splits, monkeypatch):
    monkeypatch.setattr(R, "SPLITS", splits)
    rng = np.random.default_rng(splits)
    for size, words in ((1, 1), (50, 3), (3000, 40)):
        picked = rng.random((size, words)) < rng.random(words)[None, :] ** 3
        docs, term_ids = np.nonzero(picked)
        impacts = (rng.pareto(2, len(docs)) * 50 + 1).astype(np.int64)
        dense = np.zeros((size, words), np.int64)
        dense[docs, term_ids] = impacts
        shuffled = rng.permutation(len(docs))
        block = R.Block(size, words, docs[shuffled], term_ids[shuffled], impacts[shuffled])
        ids = [R.Reversed(i) for i in range(size)]
        for _ in range(10):
            item = [(int(t), int(rng.integers(1, 3))) for t in rng.permutation(words)[: rng.integers(1, min(words, 8) + 1)]]
            scores = sum(dense[:, t] * q for t, q in item)
            want = sorted(((-int(s), i) for i, s in enumerate(scores) if s), key=lambda x: x)[:10]
            best = []
            scored = block.search(item, best, ids, 10)
            assert sorted((-s, d.key[1]) for s, d in best if s) == want
            assert scored <= size
    assert scored < size / 2


def test_range_maxima():
    rng = np.random.default_rng(3)
    docs = np.concatenate([np.arange(37), np.arange(5), [2]])
    term_ids = np.repeat([1, 0, 2], [37, 5, 1])
    impacts = rng.integers(1, 20, len(docs))
    block = R.Block(40, 4, docs, term_ids, impacts)
    for rank in range(3):
        a, b = block.starts[rank], block.starts[rank + 1]
        for low in range(a, b):
            for high in range(low + 1, b + 1):
                at = block.greatest(np.array([low]), np.array([high]))[0]
                assert low <= at < high and block.impacts[at] == block.impacts[low:high].max()


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op13_ranked_search(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(rows(got)) == plain(docs, sorted(items))


def test_many_copies_small_blocks_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_DOCS", 7)
    monkeypatch.setattr(R, "ITEM_BYTES", 200)
    rng = random.Random(2)
    docs = [(i, "the same copy of words") for i in range(60)] + [(i, " ".join(rng.choice("the same copy of Words é 的 x9".split()) for _ in range(rng.randrange(9)))) for i in range(60, 200)]
    rng.shuffle(docs)
    items = [(7, "the copy"), (8, "é é words"), (7, "THE COPY"), (9, None), (10, "nowhere"), (11, "的")]
    got = R.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(rows(got)) == sorted(plain(docs, items))


def test_odd_tables(spark, docs, empty):
    items = [("a", "alpha Beta 12345"), (None, "word5 tail3"), ("b", ""), ("a", "x")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], items)
    key = lambda r: (r[0] or "", r[1], r[3], r[2] or 0)
    got = rows(R.ranked_search(docs, asked))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert R.ranked_search(empty, asked).count() == 0 and R.ranked_search(docs, asked.limit(0)).count() == 0
    named = docs.select(docs.doc_id.cast("string").alias("name"), "text", "doc_id")
    assert len(rows(R.ranked_search(named, asked, id_col="name"))) == len(want)


def test_norms_of_any_size():
    n = np.array([0, 10**9], np.int64)
    assert R.length_norms(n, 10**10, 10**12).tolist() == [25, 25 + 75 * 10**19 // 10**12]
