"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each with ids of one document as little-endian unsigned 32-bit integers (a long document has
several), then a skippable frame with the document index (an Arrow stream: id, n_tokens), then the seek table of the published
seekable format: for each frame its compressed size, its raw size and the low 32 bits of the XXH64 of its raw bytes. A reader
takes the last nine bytes, the seek table and the index, and then decompresses the frames of the documents it wants, no others.

Tasks write their files straight to the shared folder, under names of their own attempt. A manifest that Spark commits lists the
files of the attempts that counted, so a lost executor or a repeated task leaves nothing that a reader would see.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrow import arrow_batches
from .bpe import byte_alphabet
from .tokens import default_vocabulary
from .worker import kept

#: Raw bytes of a frame at most, compressed bytes after which a file ends, and documents after which it ends.
FRAME_BYTES = 1 << 18
FILE_BYTES = 256 << 20
FILE_DOCS = 1 << 20
LEVEL = 3
#: Pieces that a worker keeps with their ids, and the longest that is kept.
KEPT = 300_000
KEPT_CHARS = 64
CHUNK = 1 << 16
#: Fixed values of the zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<III")

#: Letters, numbers and white space of the first 256 code points.
_L, _N, _S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb" \t-\r\x85\xa0"
_NARROW = re.compile(rb" ?[%b]+| ?[%b]+|'(?:[stmd]|re|ve|ll)| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+" % (_L, _N, _S, _L, _N, _S, _S, _S))


class PieceEncoder:
    """Ids by the tokenizers library. Where the vocabulary splits texts into pieces by the byte-level pattern, the library is asked once for each piece and worker.

    The pattern's classes are written out for texts of the first 256 code points; other texts, and those with the string of a special token, are given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.splits = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.signs = {b: sign for sign, b in byte_alphabet().items() if ord(sign) != b}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> Iterator[list[bytes]]:
        """Pieces of a narrow text, in lists of about ``CHUNK`` characters. A list ends before its last pieces, which may go on beyond the chunk."""
        data = text.encode("latin-1")
        at = 0
        while len(data) - at > CHUNK:
            found = _NARROW.findall(data, at, at + CHUNK)
            tail = 0
            while found and tail < 4:
                tail += len(found.pop())
            if not found:  # one piece is longer than the chunk
                found = [_NARROW.match(data, at)[0]]
                tail = CHUNK - len(found[0])
            yield found
            at += CHUNK - tail
        yield _NARROW.findall(data, at)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(text, ids) in order and in parts; what is not narrow comes in one part."""
        for k, text in enumerate(texts):
            narrow = self.splits and not self.special.search(text)
            if narrow:
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    narrow = False
            if not narrow:
                yield k, self.whole([text])[0]
                continue
            for found in self.pieces(text):
                yield k, self.ids(found)

    def ids(self, found: list[bytes]) -> bytes:
        """The ids of narrow pieces in a row. Pieces met lately are kept in two generations: a full one grows old, and what is met again moves on."""
        kept, long = self.kept, {}
        for p in {p for p in found if p not in kept}:
            if len(p) > KEPT_CHARS:
                long[p] = self.whole([p.decode("latin-1")])[0]
            else:
                kept[p] = self.old.get(p) or self.piece(p)
        data = b"".join([long[p] if p in long else kept[p] for p in found]) if long else b"".join(map(kept.__getitem__, found))
        if len(kept) > KEPT:
            self.old, self.kept = kept, {}
        return data

    def piece(self, piece: bytes) -> bytes:
        """The library's model on one piece, in the alphabet that stands for bytes."""
        signs = piece.decode("latin-1").encode().decode("latin-1").translate(self.signs)
        return b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(signs)])


def _encoder(path: str) -> PieceEncoder:
    """One for each worker and file."""
    return kept(("pieces", path), lambda: PieceEncoder(path))


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class FrameFile:
    """Writes one file; ``stream`` needs only ``write``."""

    def __init__(self, stream, id_type: pa.DataType, level: int = LEVEL) -> None:
        self.stream, self.id_type, self.compressor = stream, id_type, zstandard.ZstdCompressor(level=level)
        self.entries: list[bytes] = []
        self.doc_ids: list[object] = []
        self.lengths: list[int] = []
        self.size = 0
        self._held = bytearray()

    def begin(self, doc_id: object) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(0)

    def push(self, ids: bytes) -> None:
        """More ids of the document begun last."""
        self.lengths[-1] += len(ids) // 4
        self._held += ids
        while len(self._held) >= FRAME_BYTES:
            self._frame(bytes(self._held[:FRAME_BYTES]))
            del self._held[:FRAME_BYTES]

    def end(self) -> None:
        if self._held:
            self._frame(bytes(self._held))
            self._held.clear()

    def _frame(self, raw: bytes) -> None:
        self._put(self.compressor.compress(raw), raw)

    def _put(self, data: bytes, raw: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)
        self.entries.append(_ENTRY.pack(len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        held = io.BytesIO()
        columns = pa.table({"id": pa.array(self.doc_ids, self.id_type), "n_tokens": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(held, columns.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(columns)
        self._put(_skippable(SKIPPABLE_INDEX, held.getvalue()), b"")
        table = b"".join(self.entries) + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEK_MAGIC)
        self.stream.write(_skippable(SKIPPABLE_SEEK, table))


def open_uri(uri: str, mode: str):
    """A stream of a file in any store that Arrow knows: a mounted folder, HDFS, S3, GCS."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    system, path = fs.FileSystem.from_uri("file://" + "/" + rest.lstrip("/") if scheme == "file" else uri.replace("s3a://", "s3://", 1))
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


class FrameReader:
    """Seek table and index of one file; ``frames`` decompresses only what it is asked for."""

    def __init__(self, stream) -> None:
        self.stream = stream
        size = stream.size()
        n, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a file of frames with a seek table")
        table = self._at(size - _FOOTER.size - n * _ENTRY.size, n * _ENTRY.size)
        self.entries = list(_ENTRY.iter_unpack(table))
        self.offsets = [0]
        for packed, _, _ in self.entries:
            self.offsets.append(self.offsets[-1] + packed)
        index = self._at(self.offsets[n - 1] + 8, self.entries[n - 1][0] - 8)
        self.index = pa.ipc.open_stream(index).read_all()
        self._decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """(row of the index, first frame, number of frames), in order. A document's frames are those that hold its bytes, however large the writer made them."""
        frame = 0
        for k, n in enumerate(self.index.column("n_tokens").to_pylist()):
            first, raw = frame, n * 4
            while raw > 0:
                raw -= self.entries[frame][1]
                frame += 1
            yield k, first, frame - first

    def frames(self, first: int, count: int) -> Iterator[bytes]:
        for k in range(first, first + count):
            packed, raw, check = self.entries[k]
            yield checked(self._decompressor, self._at(self.offsets[k], packed), raw, check)


def checked(decompressor: zstandard.ZstdDecompressor, data: bytes, raw: int, check: int) -> bytes:
    """The raw bytes of a frame; raises if they are not those that were written."""
    out = decompressor.decompress(data, max_output_size=raw)
    if len(out) != raw or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum does not fit its bytes")
    return out


_MANIFEST = "part int, file int, path string, docs long, ids long, bytes long"


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 0, files: int | None = None, level: int = LEVEL) -> DataFrame:
    """Encodes every row of ``docs``, appends ``end_id`` (None: nothing), writes the files to ``folder`` in ascending order of the id and returns the manifest.

    The manifest has a row for each file: part and file (their order), path, docs, ids, bytes. Null ids come last; rows that repeat an id are ordered by their
    texts' hashes. A null text is empty. An empty table gives no file. ``folder`` has to be a store that all executors see.
    Rows are dealt by ranges of id and text hash, ``files`` of them (None: as many as the session's shuffle partitions, joined where they are small);
    rows alike in both are dealt by their place, so copies can't fill one task. A task holds a batch of texts, one frame and the index of one file.
    """
    path, base = vocabulary or default_vocabulary(), folder.rstrip("/")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_last(), "h", "place"]
    dealt = rows.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).select("id", "text")
    end = struct.pack("<I", end_id) if end_id is not None else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, attempt = _encoder(path), TaskContext.get().partitionId(), uuid.uuid4().hex
        out, stream, number = None, None, 0

        def finish() -> pa.RecordBatch:
            out.close()
            stream.close()
            row = {"part": part, "file": number, "path": name, "docs": len(out.doc_ids), "ids": sum(out.lengths), "bytes": out.size}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            parts = encoder.encode(texts)
            k, data = next(parts, (-1, b""))
            for row in range(len(texts)):
                if out and (out.size >= FILE_BYTES or len(out.doc_ids) >= FILE_DOCS):
                    yield finish()
                    out, number = None, number + 1
                if not out:
                    name = f"{base}/part-{part:06d}-{attempt}-{number:04d}.ids.zst"
                    stream = open_uri(name, "w")
                    out = FrameFile(stream, ids.type, level)
                out.begin(ids[row].as_py())
                while k == row:
                    out.push(data)
                    k, data = next(parts, (-1, b""))
                out.push(end)
                out.end()
        if out:
            yield finish()

    arrow_batches(docs.sparkSession)
    dealt.mapInArrow(run, _MANIFEST).write.parquet(f"{base}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``start``, the ids in the files before, dealt a file a task. One small row a file goes through one window."""
    order = Window.orderBy("part", "file")
    files = read_manifest(spark, folder).withColumn("start", F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return files.withColumn("seq", F.row_number().over(order)).select("seq", "path", "start").repartition(max(1, read_manifest(spark, folder).count()), "seq")


def _id_type(spark: SparkSession, folder: str, id_type: str | None) -> str:
    if id_type:
        return id_type
    first = read_manifest(spark, folder).select("path").first()
    if not first:
        return "bigint"
    with open_uri(first.path, "r") as stream:
        kind = FrameReader(stream).index.schema.field("id").type
    from pyspark.sql.pandas.types import from_arrow_type

    return StringType().simpleString() if pa.types.is_large_string(kind) else from_arrow_type(kind).simpleString()


def token_index(spark: SparkSession, folder: str, id_type: str | None = None) -> DataFrame:
    """Where each document lies: id, start (ids of all documents before it), n_tokens, path, frames (offset, packed, raw, check). Reads seek tables and indexes only.

    Filter or join it, then give it to ``read_documents``. ``id_type`` spares the look into the first file.
    """
    frame = "array<struct<offset:bigint,packed:bigint,raw:bigint,check:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_uri(path, "r") as stream:
                    reader = FrameReader(stream)
                    lengths = reader.index.column("n_tokens").to_pylist()
                    places = [[{"offset": reader.offsets[f], "packed": reader.entries[f][0], "raw": reader.entries[f][1], "check": reader.entries[f][2]} for f in range(first, first + n)] for _, first, n in reader.documents()]
                    starts = [start]
                    for n in lengths[:-1]:
                        starts.append(starts[-1] + n)
                    table = pa.table({
                        "id": reader.index.column("id"), "start": pa.array(starts[: len(lengths)], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "path": pa.array([path] * len(lengths), pa.string()),
                        "frames": pa.array(places, pa.list_(pa.struct([(c, pa.int64()) for c in ("offset", "packed", "raw", "check")]))),
                    })
                    yield from table.to_batches(max_chunksize=4096)

    return _files(spark, folder).select("path", "start").mapInArrow(run, f"id {_id_type(spark, folder, id_type)}, start long, n_tokens long, path string, frames {frame}")


def read_documents(places: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of the rows of ``token_index`` that are asked for; reads and decompresses their frames only, and checks them."""
    rows = places.select("id", "start", "n_tokens", "path", "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor, path, stream = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                wanted = row.column("path")[0].as_py()
                if wanted != path:
                    if stream:
                        stream.close()
                    path, stream = wanted, open_uri(wanted, "r")
                raw = bytearray()
                for f in row.column("frames")[0].as_py():
                    stream.seek(f["offset"])
                    raw += checked(decompressor, stream.read(f["packed"]), f["raw"], f["check"])
                ids = pa.Array.from_buffers(pa.uint32(), len(raw) // 4, [None, pa.py_buffer(bytes(raw))]).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([row.column("id"), row.column("start"), row.column("n_tokens"), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=["id", "start", "n_tokens", "ids"])
        if stream:
            stream.close()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, n_tokens long, ids array<bigint>")


def read_checksums(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type: str | None = None) -> DataFrame:
    """(``id_col``, start, n_tokens, ids_crc32) of every document, read from the files frame by frame; a file is one task and its ids are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_uri(path, "r") as stream:
                    reader = FrameReader(stream)
                    starts, sizes, sums = [], [], []
                    for _, first, count in reader.documents():
                        crc, n = 0, 0
                        for raw in reader.frames(first, count):
                            crc, n = zlib.crc32(raw, crc), n + len(raw) // 4
                        starts.append(start)
                        sizes.append(n)
                        sums.append(crc)
                        start += n
                    table = pa.table({"id": reader.index.column("id"), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})
                    yield from table.to_batches(max_chunksize=65536)

    found = _files(spark, folder).select("path", "start").mapInArrow(run, f"id {_id_type(spark, folder, id_type)}, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)
