import hashlib
import os
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from factweave.llm import token_counts as C  # noqa: E402
from factweave.llm import tokens as T  # noqa: E402
from factweave.llm.bpe import ByteBpe, Decoder, Digests, Encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
BPE = ByteBpe(PATH)
SIGNS = list("abcdefghij etaoin  \n\t'sdlmtrev.,!|123éñß的  　​😀\x1c\x85") + ["<|endoftext|>", "'ll", " 's", "՘", "࢏"]


def want(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=60).map("".join))
def test_tokens_are_those_of_the_library(text):
    assert list(Encoder(BPE).encode([text])) == [want(text)]


def test_long_pieces_and_texts_are_streamed():
    rng = random.Random(5)
    texts = ["a" * 20_000, "the" * 9_000, " " * 9_000, "!" * 5_000 + "é" * 5_000, "ab " * 40_000, "".join(rng.choice("aeht") for _ in range(30_000)), "<|endoftext|>" * 3]
    for text, ids in zip(texts, Encoder(BPE).encode(texts)):
        assert ids == want(text)
        d = Decoder(BPE)
        assert "".join(d.push(ids[k : k + 5]) for k in range(0, len(ids), 5)) + d.push([], final=True) == text


def test_every_piece_goes_through_the_transducer(monkeypatch):
    """What the encoder returns is what the machine emitted, for short pieces (kept as arcs) and long ones; their parts stay bounded."""
    fed, real = [], ByteBpe.transduce

    def watched(self, pieces):
        fed.extend(pieces)
        for k, tokens in real(self, pieces):
            assert len(tokens) <= self.window
            yield k, tokens

    monkeypatch.setattr(ByteBpe, "transduce", watched)
    bpe = ByteBpe(PATH)
    text = "the words of it, " * 50 + "x" * 3000 + " und " + "ab" * 9000
    assert Encoder(bpe).encode([text]) == [want(text)]
    assert set(fed) == {p.encode() for p in bpe.pieces(text)}


def test_memory_is_flat_on_one_long_piece():
    import tracemalloc

    bpe, peaks = ByteBpe(PATH), []
    for size in (1 << 17, 1 << 19):
        text, running = "qz" * (size // 2), Digests(bpe, [str(i) for i in range(len(bpe.text))])
        tracemalloc.start()
        for _, ids in Encoder(bpe).parts([text]):
            running.push(ids)
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * size)  # the piece itself, as text and as bytes
        tracemalloc.stop()
        assert running.close()[2] == hashlib.sha256(text.encode()).hexdigest()
    assert peaks[1] < peaks[0] + (1 << 18)


def test_tokens_before_the_lookahead_are_stable():
    rng = random.Random(9)
    for _ in range(60):
        word = "".join(rng.choice("theandingers") for _ in range(BPE.lookahead + 200)).encode()
        first = BPE.merge([word])[0]
        for more in (b"a", b"the", b"ing" * 9, bytes(rng.choice(b"theandingers") for _ in range(300))):
            other, end = BPE.merge([word + more])[0], 0
            for x, y in zip(first, other):
                end += len(BPE.text[x])
                if end > len(word) - BPE.lookahead:
                    break
                assert x == y


def test_decoder_replaces_broken_bytes():
    cut = want("的")[:1]
    assert Decoder(BPE).push(cut, final=True) == REFERENCE.decode(cut, skip_special_tokens=False)


def test_table_of_tokens(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    got = T.encode_documents(docs, carry=["source"]).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expect = sorted(((r.doc_id, len(want(r.text or "")), sha(",".join(map(str, want(r.text or "")))), sha(r.text or "")) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=key) == expect
    back = T.decode_documents(T.encode_documents(docs.filter("doc_id < 10")))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in rows if r.doc_id and r.doc_id < 10}
    assert T.encode_documents(empty).count() == 0


def test_token_counts(docs, real, empty):
    for df in (docs, real):
        rows = df.select("doc_id", "text").collect()
        expect = sorted((r.doc_id or -1, len((r.text or "").encode()), len(want(r.text or "")), len(want(r.text or "")) > 1024) for r in rows)
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(df).collect()) == expect
    assert C.token_counts(empty).count() == 0


def test_texts_are_split_safely():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice(SIGNS) for _ in range(400))
        parts = C.split_safely(text, 30)
        assert "".join(parts) == text and sum(len(want(p)) for p in parts) == len(want(text))


def test_texts_without_spaces_are_split_at_signs():
    """Prose without spaces, and code: chunks stay bounded, tokens stay the library's, strings of special tokens stay whole."""
    rng = random.Random(4)
    letters, signs = "的一是不了人我在有他這中大来上国", "，。、；！「」՘ꟍ'’<|>_-.,(){}=%&#"
    special = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(60):
        text = "".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "'ll", "e\u0301", *letters, *"abcXYZ019", *signs]) for _ in range(500))
        parts = C.split_safely(text, 30)
        assert "".join(parts) == text and max(map(len, parts)) < 400
        assert [i for p in parts for i in want(p)] == want(text)
        assert [i for p in parts for i in special.encode(p, add_special_tokens=False).ids] == special.encode(text, add_special_tokens=False).ids
    text = "".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) + rng.choice("，。") for _ in range(20_000))
    assert max(len(c) for c in BPE.chunks(text)) < (1 << 16) + 100
    assert Encoder(BPE).encode([text]) == [want(text)]


def test_long_pieces_merge_alike_by_heap_and_in_lockstep():
    rng = random.Random(8)
    for alphabet in ("ab", "theandingers", "的一是不了", "=-#"):
        for n in (1, 2, 130, 900):
            piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert [BPE.merge_long(piece)] == BPE.merge([piece])


def test_sentencepiece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "hello world", "  a  b " * 30_000]
    assert C.count_batch(texts, path) == [len(model.encode(t)) for t in texts]
