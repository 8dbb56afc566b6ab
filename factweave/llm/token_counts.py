"""Token counts: batch encoding by the tokenizer's own library, in Arrow functions that return lengths only.

Batches are cut by bytes, not rows, so that a batch of long texts needs no more memory than one of short texts.
Texts beyond ``PIECE`` characters are split where no token can reach across; their counts add up.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_batches
from .bpe import SAFE
from .tokens import default_vocabulary
from .worker import kept

PIECE = 1 << 16
BATCH_CHARS = 1 << 18
LIMIT = 1024


def split_safely(text: str, size: int = PIECE) -> list[str]:
    """Parts of about ``size`` characters that give the same tokens one by one; a text without a safe place stays whole."""
    parts, at = [], 0
    while len(text) - at > size:
        safe = SAFE.search(text, at + size)
        if not safe:
            break
        parts.append(text[at : safe.start()])
        at = safe.start()
    return [*parts, text[at:]]


def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether texts may be split; one for each worker and file."""
    return kept(("counter", path), lambda: _make_counter(path))


def _make_counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task a core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], True


def count_batch(texts: list[str], path: str) -> list[int]:
    """Token counts of ``texts``, in calls of at most about ``BATCH_CHARS`` characters."""
    count, splits = _counter(path)
    totals, held, owners, size = [0] * len(texts), [], [], 0

    def flush() -> None:
        for k, n in zip(owners, count(held)):
            totals[k] += n
        held.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for part in split_safely(text) if splits else [text]:
            held.append(part)
            owners.append(k)
            size += len(part)
            if size >= BATCH_CHARS:
                flush()
                size = 0
    flush()
    return totals


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text is empty and has no tokens. Special strings inside a text count as the library takes them by default.
    An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_batch(batch.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    arrow_batches(docs.sparkSession)
    counted = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
