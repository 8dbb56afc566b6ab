import random
import re
import zlib
from collections import Counter

import pytest

from factweave.llm import spelling as S
from factweave.llm.queries import misspelt, op12_spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """All pairs of words, and forms followed one by one."""
    out, forms = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 5 * n else None
        out[w] = [n, len(near), forms[w], counts.get(forms[w])]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (*out[w], root)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("letters", ["abc", "aéèÿ×z", "abcdefghijklmnopqrstuvwxyz"])
def test_groups_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 6, 7, 8]))) for _ in range(150)}
    for w in list(words)[:60]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    counts = {w: 5 ** rng.randrange(1, 7) + rng.randrange(2) for w in words if w}
    assert as_dict(S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_number_of_symbols_changes_no_result(spark, monkeypatch):
    rng = random.Random(8)
    counts = {"".join(rng.choice("abcdé") for _ in range(6)): rng.choice([5, 30, 200]) for _ in range(200)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for k in (1, 4, 13):
        monkeypatch.setattr(S, "symbols_for", lambda *_: k)
        assert as_dict(S.spelling_groups(words)) == plain(counts)


def test_symbols_and_neighbourhoods():
    assert S.symbols_for(0) == 4 and S.symbols_for(4**6) == 4 and S.symbols_for(4**6 + 1) == 5 and S.symbols_for(10**12) == 36
    dealt = S.letter_symbols([("e", 10), ("t", 6), ("a", 5)], 2)
    assert dealt["t"] == dealt["a"] != dealt["e"]


@pytest.mark.parametrize("word", ["", "a", "ab", "aab", "abba", "cccc", "abcab"])
def test_neighbourhood_is_full_and_has_nothing_twice(word):
    full = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + s + word[i + j :] for s in "abc" for j in (0, 1) for i in range(len(word) + 1 - j)}
    key = lambda w: int(S.keys_of(next(S.reduced([w], {}, 3))[1])[0])
    symbols = next(S.reduced([word, word], {}, 3))[1]
    made = [(int(r), int(x)) for rows, keys in S.neighbourhood(symbols, 3) for r, x in zip(rows, keys)]
    assert sorted(made) == sorted((r, key(w)) for r in (0, 1) for w in full)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    rng = random.Random(9)
    counts = {"".join(rng.choice("abcdefé") for _ in range(rng.randrange(5, 8))): 5 for _ in range(3000)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    whole = {tuple(r) for r in S.near_words(words).collect()}
    monkeypatch.setattr(S, "MOST_BITS", 15)
    monkeypatch.setattr(S, "SLICE", 50)
    assert {tuple(r) for r in S.near_words(words).collect()} == whole
    assert {(w, x) for w, _, x, _ in whole} == {(w, x) for w in counts for x in counts if one_edit(w, x)}


def counted(rows, changed=True):
    total = Counter()
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{doc}:{w}".encode())
            if changed and h % 199 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            if len(w) >= 6:
                total[w] += 1
    return total


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = {w: n for w, n in counted(rows).items() if n >= 5}
    got = op12_spelling(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    assert as_dict(got) == plain(counts)


def test_words_of_odd_tables(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(S, "HELD", 3)
    got = {r.word: r.n for r in S.word_counts(docs, change=misspelt).collect()}
    assert got == dict(counted([("" if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]))
    assert {r.word: r.n for r in S.word_counts(docs).collect()} == dict(counted([(0, r.text) for r in docs.collect()], changed=False))
    assert S.spelling_groups(S.word_counts(empty)).count() == 0
    long = spark.createDataFrame([(1, "Straße " * 400_000 + "é" * 70)], "doc_id long, text string")
    assert {r.word: r.n for r in S.word_counts(long).collect()} == {"straße": 400_000, "é" * 70: 1}
