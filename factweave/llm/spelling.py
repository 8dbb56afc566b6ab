"""Spelling variants grouped by reduced-alphabet generation.

Letters are hashed to a few symbols. Words one edit apart have reduced words that are equal or one edit apart, so each word
generates the full one-edit neighbourhood of its reduced word (over the few symbols, not over all letters), which is joined with the
vocabulary's reduced words. What meets is verified on the words themselves.

The fewer the symbols, the smaller the neighbourhoods and the more words that meet in vain; ``symbols_for`` takes the fewest of
which the shortest reduced words outnumber the vocabulary. The choice changes the work, never the result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, sized_join
from .arrow import arrow_batches
from .runs import runs

LEAST_CHARS = 6
LEAST_COUNT = 5
#: How many times more often a word's form has to occur.
RATIO = 5
#: Letters of ``[A-Za-z]`` and U+00C0 to U+00FF, in UTF-8 with A-Z lower-cased.
WORD = re.compile(rb"(?:[a-z]+|(?:\xC3[\x80-\xBF])+)+")
#: Constants of the reduced words' polynomial and of their bitmap, which has at most 32 MB.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD1B54A32D192ED03)
MOST_BITS = 28
#: Symbols of a slice of reduced words.
SLICE = 1 << 16
#: Distinct words that a task counts before it hands them on, and letters that are dealt by their frequency.
HELD = 1 << 18
LETTERS = 4096


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, bytes], str] | None = None, pattern: re.Pattern[bytes] = WORD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` code points in all whole texts, A-Z lower-cased.

    ``change(doc id, word's bytes)`` may return another word for all of a word's occurrences in a row; it has to be pure. Null texts have no words.
    Tasks add up what they meet before the shuffle, so a word that a third of all rows holds costs a row a task.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                met: Counter[bytes] = Counter()
                for found in runs(pattern, text):
                    met.update(found)
                for raw, n in met.items():
                    if len(raw) >= least_chars:
                        word = change(doc, raw) if change else raw.decode()
                        if len(word) >= least_chars:
                            total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    arrow_batches(docs.sparkSession)
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols_for(words: int, least_chars: int = LEAST_CHARS) -> int:
    """The fewest symbols, from 4 to 36, with at least as many words of ``least_chars`` symbols as there are words."""
    return next((k for k in range(4, 36) if k**least_chars >= words), 36)


def letter_symbols(frequencies: list[tuple[str, int]], k: int) -> dict[str, int]:
    """Each letter's symbol from 1 to ``k``: letters in falling frequency go to the symbol that has the least so far."""
    load = [0] * k
    dealt = {}
    for letter, n in sorted(frequencies, key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        dealt[letter] = least + 1
        load[least] += n
    return dealt


def reduced(words: list[str], dealt: dict[str, int], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols from 1 to ``k`` as a row a word) of the words of each length, in slices of bounded size."""
    by_length = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word)].append(i)
    for length, places in by_length.items():
        step = max(1, SLICE // (length + 1))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            flat = [dealt.get(c) or 1 + ord(c) % k for i in part for c in words[i]]
            yield np.array(part), np.array(flat, np.uint64).reshape(len(part), length)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """Each reduced word as one number of 64 bits: a polynomial of its symbols. Two that share a number only meet in vain."""
    return (symbols * _powers(symbols.shape[1])[: symbols.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbourhood(symbols: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the reduced words themselves and of all that one inserted, deleted or replaced symbol makes of them, each result once a word."""
    n, length = symbols.shape
    powers = _powers(length + 1)
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(symbols * powers[:length], axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    rest = whole - before  # of the symbols from each place on
    rows = np.arange(n)
    yield rows, whole[:, 0]
    ends_run = np.concatenate([symbols[:, 1:] != symbols[:, :-1], np.ones((n, min(1, length)), bool)], axis=1)
    yield np.nonzero(ends_run)[0], (before[:, :-1] + rest[:, 1:] * INVERSE)[ends_run]
    for c in range(1, k + 1):
        sign = np.uint64(c)
        other = symbols != sign
        yield np.nonzero(other)[0], (whole + (sign - symbols) * powers[:length])[other]
        fits = np.concatenate([other, np.ones((n, 1), bool)], axis=1)  # the last place of a run of the same symbol
        yield np.nonzero(fits)[0], (before + sign * powers[: length + 1] + rest * BASE)[fits]


def _bits(keys: np.ndarray, log: int) -> np.ndarray:
    return (keys * MIX) >> np.uint64(64 - log)


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n, near, near_n): both orders of each two different words of ``words`` (word, n; words distinct) that one edit parts.

    Most of a neighbourhood is no reduced word. A bitmap of those that are, at most ``2**MOST_BITS`` bits whatever the vocabulary, reaches every task; what is not in it
    is left out before the join. A fuller bitmap lets more through, and loses nothing.
    """
    spark = words.sparkSession
    size, longest = words.agg(F.count(F.lit(1)), F.max(F.octet_length("word"))).first()
    k = symbols_for(size, least_chars)
    log = min(MOST_BITS, max(15, (32 * size).bit_length()))
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    dealt = letter_symbols([tuple(r) for r in letters.orderBy(F.desc("count"), "letter").limit(LETTERS).collect()], k)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, symbols in reduced(batch.column("word").to_pylist(), dealt, k):
                keys, take = keys_of(symbols), pa.array(places, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(_bits(keys, log).astype(np.int64)), batch.column("word").take(take), batch.column("n").take(take)], names=["key", "bit", "near", "near_n"])

    held = cut(words.select("word", "n").mapInArrow(reduce, "key long, bit long, near string, near_n long"), "spelling-reduced")
    place = F.col("bit") + 1
    marked = held.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = np.zeros(1 << (log - 3), np.uint8)
    for r in marked.toLocalIterator():
        bitmap[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for places, symbols in reduced(batch.column("word").to_pylist(), dealt, k):
                at, found = [], []
                for rows, keys in neighbourhood(symbols, k):
                    bits = _bits(keys, log)
                    some = (known[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at.append(places[rows[some]])
                    found.append(keys[some])
                take = pa.array(np.concatenate(at), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column("word").take(take), batch.column("n").take(take)], names=["key", "word", "n"])

    made = words.select("word", "n").mapInArrow(generate, "key long, word string, n long")
    met = sized_join(made, held.drop("bit"), ["key"], "inner", size * (2 * (longest or 0) + 96))
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()


def spelling_groups(words: DataFrame, ratio: int = RATIO, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row for each of ``words`` (word, n): word, n, n_near (near words), form, form_n, root.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n (ties: the smallest by
    code points) if it occurs at least ``ratio`` times as often, else null; root follows forms to the last. Counts of a repeated word add up, null
    words are left out. Words shorter than ``least_chars`` are compared, too; the bound only chooses the number of symbols. An empty table gives no rows.
    """
    words = cut(words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    size, longest = words.agg(F.count(F.lit(1)), F.max(F.octet_length("word"))).first()
    best = near_words(words, least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    row_bytes = 2 * (longest or 0) + 96
    whole = sized_join(words, best, ["word"], "left", size * row_bytes)
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n")))
    whole = cut(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["form"].alias("form"), form["n"].alias("form_n")), "spelling-forms")

    roots = whole.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps, and n grows at least ``ratio``-fold a step
        next_ones = roots.select(F.col("word").alias("at"), F.col("root").alias("on"))
        roots = cut(sized_join(roots, next_ones, roots.root == next_ones["at"], "left", size * row_bytes).select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "spelling-roots")
        if not roots.filter("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    whole = sized_join(whole, roots.drop("moved"), ["word"], "left", size * row_bytes)
    return whole.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
