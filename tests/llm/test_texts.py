import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import chat as K
from factweave.llm import chunk_fingerprint as P
from factweave.llm import license_scan as S
from factweave.llm.license_texts import TEMPLATES


def fp(text):
    data = text.encode()
    return P.chunk_set(data, P.chunk_ends(data))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.binary(max_size=300))
def test_chunks_cover_and_respect_bounds(a, b):
    ends = P.chunk_ends(a + b)
    sizes = [y - x for x, y in zip([0, *ends], ends)]
    assert sum(sizes) == len(a + b) and all(x <= P.MOST for x in sizes) and all(x >= P.LEAST for x in sizes[:-1])
    start = ends[len(ends) // 2] if ends else 0
    assert P.chunk_ends(a + b, start) == [e for e in ends if e > start]


def test_insertions_move_few_chunks():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    edited = text[:700] + "inserted words here" + text[700:]
    assert P.containment(fp(text), fp(edited)) > 0.95
    assert P.parse(P.render(fp(text))) == fp(text)


def test_edited_texts_against_brute_force(docs, real, empty):
    for df in (real, docs):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), (F.xxhash64(F.coalesce("text", F.lit(""))) / 2).cast("long").alias("h")).collect()}
        order = sorted(rows, key=lambda r: ((r[0] is None), -(r[0] or 0), hashes[r[1]]))
        want = []
        for k, (i, x) in enumerate(order):
            y = order[(k + 1) % len(order)][1]
            cut = len(x) // 3
            e = x[: len(x) - cut] + y[:cut]
            want.append((i or -1, len(x), hashlib.sha256(e.encode()).hexdigest(), P.render(fp(x)), P.render(fp(e)), P.containment(fp(x), fp(e)), P.containment(fp(x), fp(y))))
        got = [(r.doc_id or -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in P.compare_edited(df).collect()]
        assert sorted(got) == sorted(want)
    assert P.compare_edited(empty).count() == 0


def test_edited_texts_take_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 2_000)
    rows = [(f"k{k:03}", f"text {k} " * 20) for k in range(50)] + [(None, f"without {k} " * 20) for k in range(50)]
    got = {r.doc_id: r for r in P.compare_edited(spark.createDataFrame(rows, "doc_id string, text string")).collect() if r.doc_id}
    texts = dict(rows)
    for k in range(1, 50):
        assert got[f"k{k:03}"].near_next == P.containment(fp(texts[f"k{k:03}"]), fp(texts[f"k{k - 1:03}"]))
    assert len(got) == 50


def test_edited_texts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 100_000)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    want = {i: P.containment(fp(x), fp(rows[(k + 1) % len(rows)][1])) for k, (i, x) in enumerate(rows)}
    assert {r.doc_id: r.near_next for r in P.compare_edited(df).collect()} == want


def test_licenses_are_found_and_confirmed(spark, docs, empty):
    mit = TEMPLATES["MIT"]
    rows = [
        (1, "Some prose.\n" + mit + "\nMore prose."), (2, "Nothing here of that kind."), (3, "Words.\nReleased under the MIT License.\nWords."), (4, mit.replace("free of charge", "at no cost") + "\nend"),
        (5, "This license to print money is not one."), (6, None), (7, ""),
    ]
    got = {r.doc_id: r for r in S.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].template == "MIT" and got[1].exact and got[3].template == "MIT/notice" and got[3].exact
    assert got[4].license == "MIT" and not got[4].exact and got[4].missing_words == 3 and "free of charge" in got[4].differences
    text = rows[0][1]
    assert text[got[1].start : got[1].end].startswith("Permission is hereby granted")
    assert {r.doc_id for r in S.scan_licenses(docs).collect()} == {12}
    assert S.scan_licenses(empty).count() == 0


def test_planted_lines_are_all_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = {"MIT/notice": "Released under the MIT License.", "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0."}
    got = {(r.doc_id, r.template) for r in S.scan_licenses(df).collect() if r.template in line}
    assert got == {(r.doc_id, name) for r in df.collect() for name, wording in line.items() if wording in r.text}


def test_every_license_of_a_block_is_found():
    scanner = S.Scanner(TEMPLATES)
    mit, apache, cc = TEMPLATES["MIT/licensed"], TEMPLATES["Apache-2.0/notice"], TEMPLATES["CC-BY-4.0/notice"]
    hits = lambda text: [(h[2], text[h[0] : h[1]] + ".", h[7]) for h in scanner.scan(text)]
    assert hits(f"Words.\n{mit} {apache}\nWords.") == [("MIT/licensed", mit, True), ("Apache-2.0/notice", apache, True)]
    assert hits("\n".join([mit, cc, apache, mit])) == [("MIT/licensed", mit, True), ("CC-BY-4.0/notice", cc, True), ("Apache-2.0/notice", apache, True), ("MIT/licensed", mit, True)]
    several = "\n".join([TEMPLATES["ISC"], TEMPLATES["MIT"], cc, TEMPLATES["Unlicense"], TEMPLATES["GPL-3.0/header"], TEMPLATES["Apache-2.0/header"]])
    assert [h[2] for h in scanner.scan(several) if h[7]] == ["ISC", "MIT", "CC-BY-4.0/notice", "Unlicense", "GPL-3.0/header", "Apache-2.0/header"]


def test_what_the_template_does_not_shorten_is_no_candidate(monkeypatch):
    """the compression was reported beside a wording and decided nothing. Nor does it lose a wording with as many words inserted as may be."""
    scanner, rng = S.Scanner(TEMPLATES), random.Random(3)
    mit = TEMPLATES["MIT"]
    shortened = scanner.saved
    asked = []
    monkeypatch.setattr(scanner, "saved", lambda block, name: asked.append(name) or (0.0 if name == "MIT" else shortened(block, name)))
    assert "MIT" not in {h[2] for h in scanner.scan(mit)} and "MIT" in asked
    monkeypatch.setattr(scanner, "saved", shortened)
    for name, own in scanner.words.items():
        spare = len(own) + 16 - rng.randrange(8)
        for others in (["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(spare)], rng.choices(own, k=spare)):
            at = sorted(rng.randrange(len(own)) for _ in others)
            kept = sorted(rng.sample(range(len(own)), scanner.need[name]))
            assert scanner.explains([w for k in kept for w in [own[k], *(x for x, i in zip(others, at) if i == k)]], name), name


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*K.CONTROL, "\\", ".", "n", "\n", "<", "|", ">", "[", "/", "s", "é"]), max_size=12).map("".join), st.lists(st.sampled_from(["user", "<s>", "\n", "\\", "n"]), max_size=4).map("".join))
def test_template_is_reversible(text, role):
    piece, start, end = K.format_turn(role, text)
    assert not any(c in K.escape(text) for c in K.CONTROL)
    assert list(K.Reader().feed(piece)) == [(role, text)] and K.unescape(piece[start:end]) == text
    reader = K.Reader()
    assert [t for k in range(len(piece)) for t in reader.feed(piece[k])] == [(role, text)]


def test_layouts_become_canonical_turns(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}), (2, {"instruction": "do", "input": "this", "output": "done"}), (3, {"prompt": "p", "completion": "c", "id": 5}),
        (4, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}), (5, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}),
        (6, {"unknown": 1}), (7, {"instruction": "do", "input": "", "output": ""}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(8, "no json"), (9, None)], "id long, record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in K.canonical_turns(df, "id", "record").filter("layout is not null").collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "do\n\nthis"), (2, 1, "assistant", "done"), (3, 0, "user", "p"), (3, 1, "assistant", "c"), (4, 0, "user", "q"), (4, 1, "assistant", ""), (5, 0, "user", "ab"), (7, 0, "user", "do"), (7, 1, "assistant", "")]
    assert sorted(r.conv_id for r in K.canonical_turns(df, "id", "record").filter("layout is null").collect()) == [6, 8, 9]


def test_every_mapping_gives_its_turns(spark):
    records = {
        "turn row": ({"turn": 0, "role": "human", "text": "hi"}, [("human", "hi")]),
        "messages": ({"id": "1", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        "message parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
        "from/value": ({"conversations": [{"from": "gpt", "value": "x"}]}, [("assistant", "x")]),
        "turns": ({"turns": [{"role": "user", "text": "q"}, {"role": "bot", "text": "r"}]}, [("user", "q"), ("assistant", "r")]),
        "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        "prompt/completion": ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
        "prompt/response": ({"prompt": "p", "response": ""}, [("user", "p"), ("assistant", "")]),
        "question/answer": ({"context": "c", "question": "q", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
    }
    assert set(records) == {m.name for m in K.MAPPINGS}
    df = spark.createDataFrame([(name, json.dumps(r)) for name, (r, _) in records.items()], "conv_id string, record string")
    got = {}
    for r in K.canonical_turns(df, "conv_id", "record").orderBy("conv_id", "turn").collect():
        assert r.layout == r.conv_id
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {name: turns for name, (_, turns) in records.items()}


def test_conversations_of_odd_tables(spark):
    """Empty tables, repeated rows, a very long text, null numbers and ids, and columns with the operator's own names."""
    long = "word [INST] \\ " * 50_000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (3, None, "assistant", long), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' AS record", "7 AS piece", "1 AS layout")
    made = lambda t: K.read_back(K.format_turns(K.canonical_turns(K.row_records(t), "conv_id", "record")))
    got = {r.conv_id: r for r in made(df).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 2, 2: 1, 3: 1, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\n" * 2).hexdigest()
    assert got[3].loss_chars == len(long) and got[3].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert made(df.limit(0)).count() == 0


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "</s>"), (2, 0, "assistant", "é" * 50_000), (2, 1, None, "x"), (3, None, "user", "late"), (3, 0, "user", "first"), (None, 0, "user", "a")] + [(4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in K.read_back(K.format_turns(K.canonical_turns(K.row_records(df), "conv_id", "record"))).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is None, x[1] or 0))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_every_template_is_recognised_as_itself(spark):
    """Each wording, alone, repeated and inside a very long text; a license that holds another's clauses is not taken for it."""
    prose = "Nothing of that kind stands here, only words. " * 3
    rows = [(k, f"{prose}\n{t}\n{prose}") for k, t in enumerate(TEMPLATES.values())]
    rows += [(1000, "\n".join([prose * 400, TEMPLATES["BSD-3-Clause"], prose * 400, TEMPLATES["MIT/notice"]])), (1001, rows[0][1]), (1001, rows[0][1])]
    got = {}
    for r in S.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.template, r.exact))
    for k, name in enumerate(TEMPLATES):
        assert got[k] == [(name, True)], name
    assert sorted(got[1000]) == [("BSD-3-Clause", True), ("MIT/notice", True)] and got[1001] == got[0] * 2


def test_notices_are_found_at_any_length_and_in_linear_time():
    import time

    scanner, mit = S.Scanner(TEMPLATES), "Released under the MIT License."
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)] + ["license", "permission", "the", "under", "warranty"]
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(11)) + " license. " for _ in range(n))
    for n in (60, 200, 400, 9_000):
        half = prose(n // 2)
        text = half + mit + " " + prose(n // 2)
        began = time.time()
        hits = [(h[0], h[2], h[7]) for h in scanner.scan(text)]
        assert (len(half), "MIT/notice", True) in hits and all(name.endswith(("notice", "licensed", "identifier")) for _, name, _ in hits)
        assert time.time() - began < 15
    for n in (80, 160, 3_000):
        text = " ".join(mit + " " + " ".join(rng.choice(words[:400]) for _ in range(12)) + "." for _ in range(n))
        began = time.time()
        assert [h[2] for h in scanner.scan(text)] == ["MIT/notice"] * n
        assert time.time() - began < 15


def test_scan_against_every_template_at_every_place():
    """Plain code: each template's words at each place of the text, word by word; the longest that is there exactly is the one reported."""
    rng = random.Random(11)
    scanner = S.Scanner(TEMPLATES)
    names = sorted(TEMPLATES)
    for _ in range(25):
        picked = [rng.choice(names) for _ in range(rng.randrange(1, 7))]
        text = "\n".join(x for name in picked for x in (TEMPLATES[name], "Quite other words " * rng.randrange(4) + "."))
        have = S.words(text)
        want, at = [], 0
        while at < len(have):
            here = [(len(w), n) for n, w in scanner.words.items() if have[at : at + len(w)] == w]
            if here:
                size = max(here)[0]
                want.append(min(n for k, n in here if k == size))
                at += size
            else:
                at += 1
        assert [h[2] for h in scanner.scan(text) if h[7]] == want
