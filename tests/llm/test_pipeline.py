"""Each stage on what the one before kept, against plain Python; then run() against the chain of stages."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import public_tokenizers

import corpus_pipeline as P
from factweave.llm.quality import quality_scores

from .test_dedup import near_groups, norm

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs, held = raw, [raw.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        held.append(docs.collect())
        assert k == 4 or docs.columns == raw.columns
    start, good, exact, near, mixed, tokens = held

    accepted = {r.doc_id for r in quality_scores(raw, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert sorted(good) == sorted(r for r in start if r.doc_id in accepted) and len(good) > 0.8 * len(start)

    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    assert sorted(exact) == sorted(first.values())

    kept = set(near_groups([(r.doc_id, r.text) for r in exact]).values())
    assert sorted(near) == sorted(r for r in exact if r.doc_id in kept)

    copies, words = Counter(r.doc_id for r in mixed), lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    whole = {r.doc_id: r for r in near}
    assert all(whole[r.doc_id] == r for r in mixed) and max(copies.values()) <= 2
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in near:
        size[r.source] += words(r)
        taken[r.source] += copies[r.doc_id] * words(r)
        longest[r.source] = max(longest[r.source], words(r))
    weights, targets, free = dict(zip(sorted(size), (3, 1, 2) * 99)), {}, set(size)
    while True:
        rest = 1.5 * sum(size.values()) - sum(targets.values())
        over = {s for s in free if rest * weights[s] / sum(weights[x] for x in free) > 2 * size[s]}
        if not over:
            break
        targets |= {s: 2 * size[s] for s in over}
        free -= over
    targets |= {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 for s in size)

    assert Counter(r.doc_id for r in tokens) == copies
    for r in tokens:
        ids = library.encode(whole[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(whole[r.doc_id].text.encode()).hexdigest()

    assert Counter((r.doc_id, r.ids_sha256) for r in P.run(spark, SF).collect()) == Counter((r.doc_id, r.ids_sha256) for r in tokens)


def test_stages_take_empty_tables_and_clashing_columns(spark, docs, empty):
    for k, (_, stage) in enumerate(P.STAGES):
        if k < 4:
            assert stage(spark, empty, SF).columns == docs.columns
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, docs, SF).count() > 0
