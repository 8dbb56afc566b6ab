"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a chunk ends, so that an insertion moves only the chunks it touches.
Chunking is normalised: before ``NORMAL`` bytes a boundary needs more zero bits than after it, none comes before
``LEAST`` bytes and one is forced at ``MOST``. A fingerprint is the set of its chunks' digests with their lengths;
the containment of one text in another is the share of its distinct chunks' bytes that the other has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_batches

LEAST, NORMAL, MOST = 16, 48, 192
_SPAN = 32
_STRICT, _LOOSE = np.uint32(0xFE000000), np.uint32(0xF0000000)
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
_DIGEST = (1 << 48) - 1
BLOCK_BYTES = 4 << 20
MOST_BLOCKS = 20_000


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` from the boundary ``start`` on; the last is its length."""
    if start >= len(data):
        return []
    base = max(0, start - _SPAN + 1)
    h = _GEAR[np.frombuffer(data, np.uint8)[base:]]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = loose[(h[loose] & _STRICT) == 0] + (base + 1)
    loose, strict, n, at, ends = (loose + (base + 1)).tolist(), strict.tolist(), len(data), start, []
    while n - at > LEAST:
        k = bisect_left(strict, at + LEAST)
        if k < len(strict) and strict[k] < at + NORMAL:
            at = strict[k]
        else:
            k = bisect_left(loose, at + NORMAL)
            at = min(loose[k] if k < len(loose) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes, ends: list[int], start: int = 0) -> dict[int, int]:
    """Digest -> length of each distinct chunk."""
    found = {}
    for end in ends:
        found[xxhash.xxh3_64_intdigest(data[start:end]) & _DIGEST] = end - start
        start = end
    return found


def render(chunks: dict[int, int]) -> str:
    """12 hex digits of digest and 4 of length for each chunk, sorted."""
    return "".join([f"{d:012x}{n:04x}" for d, n in sorted(chunks.items())])


def parse(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[k : k + 12], 16): int(fingerprint[k + 12 : k + 16], 16) for k in range(0, len(fingerprint), 16)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes in chunks that b has; an empty text is contained in an empty one only."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


class _Reversed:
    """Orders ids of any type the other way round."""

    def __init__(self, id_: object) -> None:
        self.id = id_

    def __lt__(self, other: _Reversed) -> bool:
        return other.id < self.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and self.id == other.id


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint) for each row; null texts are empty and have an empty fingerprint."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [d.as_py() or b"" for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([render(chunk_set(d, chunk_ends(d))) for d in data], pa.string())], names=["id", "fingerprint"])

    arrow_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, role, id, text) sorted inside partitions: blocks are ranges of ids, descending; a block's last row (role 1)
    is a copy of the next block's first, and for the last rows of the very first.

    Rows go by id, nulls last, then by a hash of the text, so that rows without an id fill many blocks as well. The blocks' first rows
    come from a sort of ids and hashes alone; then the texts are shuffled once. Blocks stream through a sort that spills, so that
    their size bounds no memory; ``MOST_BLOCKS`` bounds the list of their first rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.xxhash64(text) / 2).cast("long").alias("h"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = int(min(MOST_BLOCKS, max(1, -(-size // BLOCK_BYTES))))
    rank = F.struct(F.col("id").isNotNull().alias("known"), "id", (-F.col("h")).alias("h"))  # the greatest goes first
    ranges = rows.select(rank.alias("rank")).repartitionByRange(blocks, F.col("rank").desc())
    starts = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.max("rank").alias("rank")).collect()
    starts = sorted((tuple(r["rank"]) for r in starts), key=lambda k: (k[0], k[1] if k[0] else 0, k[2]), reverse=True)
    shared = docs.sparkSession.sparkContext.broadcast([(not known, _Reversed(id_) if known else 0, -h) for known, id_, h in starts])

    @F.pandas_udf("array<struct<block: int, role: int>>")
    def roles(id_: pd.Series, h: pd.Series) -> pd.Series:
        starts, out = shared.value, []
        for i, x in zip(id_.array, h.to_numpy().tolist()):
            unknown = i is None or i is pd.NA or i != i
            key = (unknown, 0 if unknown else _Reversed(i), x)
            block = max(0, bisect_right(starts, key) - 1)
            out.append([{"block": block, "role": 0}] + [{"block": (block or len(starts)) - 1, "role": 1}] * (starts[block] == key))
        return pd.Series(out)

    placed = rows.select("id", "text", "h", F.explode(roles("id", "h")).alias("r")).select("r.block", "r.role", "id", "h", "text")
    return placed.repartition(max(1, len(starts)), "block").sortWithinPartitions("block", "role", F.col("id").desc_nulls_last(), "h", "text").select("block", "role", "id", "text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """For each row, its fingerprint and that of an edited text whose last 1/``share`` comes from the next row's beginning.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next row is that
    of the next smaller id, after the last the first; null ids come last, rows that repeat an id go by a hash of the text. Ids may have
    any type that has an order. A null text is empty, a very long one is read whole. A single row is its own next. near_* is the
    containment of the row's chunks. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, id, text, data, ends, chunks) that waits for its next
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def settled(following: str, chunks: dict[int, int]) -> tuple:
            _, id_, text, data, ends, own = held
            k = len(text) // share
            kept = text[: len(text) - k].encode()
            edited = kept + following[:k].encode()
            same = ends[: bisect_left(ends, len(kept) + 1)]  # what ends within the kept part ends there in the edited text too
            start = same[-1] if same else 0
            other = chunk_set(data, same)
            other |= chunk_set(edited, chunk_ends(edited, start), start)
            return (id_, len(text), hashlib.sha256(edited).hexdigest(), render(own), render(other), containment(own, other), containment(own, chunks))

        for batch in batches:
            out: list[tuple] = []
            for block, role, id_, text in zip(*(batch.column(c).to_pylist() for c in ("block", "role", "id", "text"))):
                data = text.encode()
                ends = chunk_ends(data)
                chunks = chunk_set(data, ends)
                if held and held[0] == block:
                    out.append(settled(text, chunks))
                held = None if role else (block, id_, text, data, ends, chunks)
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field("id").type, *kinds])], names=names)

    arrow_batches(docs.sparkSession)
    rows = _beside_next(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
