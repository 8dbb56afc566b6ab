"""BPE encoding and decoding of a table of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_batches
from .bpe import ByteBpe, Decoder, Digests, Encoder
from .worker import kept


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bpe(path: str) -> tuple[ByteBpe, list[str]]:
    """One for each worker and file, so that arcs outlive a task."""

    def make() -> tuple[ByteBpe, list[str]]:
        bpe = ByteBpe(path)
        return bpe, [str(i) for i in range(len(bpe.text))]

    return kept(("bpe", path), make)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_tokens, ids (if wanted), ids_sha256, decoded_sha256, and ``carry`` columns as the struct ``row``.

    A null text is empty and has no tokens; repeated rows repeat theirs. A very long text is read in parts; its ids are held only if
    ``with_ids``. The vocabulary file's path is read on the executors. An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, names = _bpe(path)
        encoder = Encoder(bpe)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [pa.array([], pa.int32())]
            done: list[tuple[int, str, str]] = []
            running = Digests(bpe, names)
            for k, found in encoder.parts(texts):
                while len(done) < k:  # texts without tokens come in between
                    done.append(running.close())
                    running = Digests(bpe, names)
                running.push(found)
                if with_ids:
                    ids.append(pa.array(found, pa.int32()))
            while len(done) < len(texts):
                done.append(running.close())
                running = Digests(bpe, names)
            n, a, b = zip(*done) if done else ([], [], [])
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if with_ids:
                offsets = [0]
                for x in n:
                    offsets.append(offsets[-1] + x)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids))
            if carry:
                columns["row"] = batch.column("row")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema += f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    arrow_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(``id_col``, text) from token ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _bpe(path)
        for batch in batches:
            texts = [Decoder(bpe).push(ids or [], final=True) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    arrow_batches(encoded.sparkSession)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
