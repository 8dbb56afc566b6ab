import io
import os
import random
import struct
import zlib

import public_tokenizers
import pytest
import xxhash
import zstandard

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from factweave.llm import token_files as T  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_are_those_of_the_library():
    rng, encoder = random.Random(4), T.PieceEncoder(PATH)
    signs = [chr(c) for c in range(256)] + list("  \n\t'sdlmtrev.,!|123") * 4 + ["的", "\u2003", "\u0587"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(600)] + ["", "<|endoftext|> x", "it's we'll I'VE"]
    got = [b""] * len(texts)
    for k, data in encoder.encode(texts):
        got[k] += data
    assert got == [packed(ids_of(t)) for t in texts]


@pytest.mark.parametrize("limit", [7, 64, 1 << 16])
def test_long_texts_are_cut_where_no_piece_goes_on(monkeypatch, limit):
    monkeypatch.setattr(T, "CHUNK", limit)
    monkeypatch.setattr(T, "KEPT", 50)
    rng, encoder = random.Random(5), T.PieceEncoder(PATH)
    for text in ["a" * 500, "we'll " * 300, " " * 300 + "x", "it's  'll\n\n a" * 50, "".join(rng.choice("ab 's.\n") for _ in range(2000))]:
        assert b"".join(d for _, d in encoder.encode([text])) == packed(ids_of(text))


def test_file_is_the_published_seekable_format():
    out = io.BytesIO()
    import pyarrow as pa

    f = T.FrameFile(out, pa.int64())
    for doc, ids in ((5, [1, 2, 0]), (6, list(range(200_000))), (None, [0])):
        f.begin(doc)
        f.push(packed(ids))
        f.end()
    f.close()
    data = out.getvalue()
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    head, size = struct.unpack("<II", data[-9 - 12 * n - 8 : -9 - 12 * n])
    assert (head, size) == (0x184D2A5E, 12 * n + 9)
    at, raw_all = 0, b""
    for k in range(n):
        packed_size, raw_size, check = struct.unpack_from("<III", data, len(data) - 9 - 12 * (n - k))
        if raw_size:
            raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed_size])
            assert len(raw) == raw_size and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF == check
            raw_all += raw
        at += packed_size
    assert raw_all == packed([1, 2, 0]) + packed(range(200_000)) + packed([0])
    # any zstandard decoder reads the whole: the index and the seek table are skipped
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == raw_all


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r.start)


@pytest.mark.parametrize("files", [None, 3])
def test_files_against_the_library(spark, docs, real, tmp_path, monkeypatch, files):
    monkeypatch.setattr(T, "FILE_BYTES", 1 << 16)
    for name, table in (("a", docs), ("b", real)):
        folder = f"file://{tmp_path}/{name}{files}"
        T.write_token_files(table, folder, files=files)
        got = rows_of(T.read_checksums(spark, folder))
        want = sorted(((r.doc_id is None, r.doc_id or 0, packed(ids_of(r.text) + [0])) for r in table.collect()))
        assert [(r.doc_id is None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((w[1], len(w[2]) // 4, zlib.crc32(w[2])) for w in want)
        start = 0
        for r in got:
            assert r.start == start
            start += r.n_tokens


def test_only_requested_frames_are_read(spark, real, tmp_path):
    folder = f"file://{tmp_path}/c"
    T.write_token_files(real.select("text", real.doc_id.cast("string").alias("name")), folder, id_col="name", files=2)
    places = T.token_index(spark, folder)
    assert places.schema["id"].dataType.simpleString() == "string"
    chosen = places.filter("id in ('3', '77')")
    want = {str(r.doc_id): ids_of(r.text) + [0] for r in real.collect()}
    got = {r.id: r.ids for r in T.read_documents(chosen).collect()}
    assert got == {k: want[k] for k in ("3", "77")}
    # every frame that was not asked for may be broken
    rows = chosen.collect()
    for path in {r.path for r in places.collect()}:
        local = path.removeprefix("file://")
        data = bytearray(open(local, "rb").read())
        spared = [(f.offset, f.offset + f.packed) for r in rows if r.path == path for f in r.frames]
        end = T.FrameReader(T.open_uri(path, "r")).offsets[-2]
        for k in range(end):
            if not any(a <= k < b for a, b in spared):
                data[k] ^= 0xFF
        open(local, "wb").write(data)
    assert {r.id: r.ids for r in T.read_documents(chosen).collect()} == got
    with pytest.raises(Exception):
        T.read_documents(places.filter("id = '4'")).collect()


def test_a_changed_byte_is_noticed():
    raw = packed(range(1000))
    data = zstandard.ZstdCompressor().compress(raw)
    with pytest.raises(ValueError):
        T.checked(zstandard.ZstdDecompressor(), data, len(raw), (xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF) ^ 1)


def test_an_empty_table_and_no_end_id(spark, empty, docs, tmp_path):
    T.write_token_files(empty, f"file://{tmp_path}/d")
    assert T.read_checksums(spark, f"file://{tmp_path}/d").count() == 0
    T.write_token_files(docs, f"file://{tmp_path}/e", end_id=None)
    assert sorted(r.n_tokens for r in T.read_checksums(spark, f"file://{tmp_path}/e").collect()) == sorted(len(ids_of(r.text)) for r in docs.collect())
