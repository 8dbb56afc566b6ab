"""Ranked lexical search with range-maximum sparse tables.

Documents are dealt in blocks. A block has a posting list for each term of the queries: documents in ascending order of their ids, with
the term's whole-number impact, and over each list a sparse table of range maxima. An item's search is best first over intervals of
documents: the sum of the lists' range maxima bounds every score within an interval; the interval of the greatest bound is split at the
document of its greatest single impact, which is scored exactly, and the two rests are bounded anew. It ends when no bound can still
enter the item's best. Intervals are split some at a time, so that arrays do the work; what was found in a task's earlier blocks bounds its later ones.

Each task hands on at most ``k`` documents an item; those meet in a partial top-k. Query items are held in blocks of bounded size, each
of which passes over all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..plans.picks import pick
from .arrow import arrow_batches
from .runs import runs

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BEST = 10
#: Postings and documents of a block at most (a document is never parted), intervals split at a time, and bytes of query texts held at a time.
BLOCK_POSTINGS = 1 << 20
BLOCK_DOCS = 1 << 16
SPLITS = 64
ITEM_BYTES = 4 << 20


def terms(text: str | None) -> Iterator[list[bytes]]:
    return runs(TERM, text)


class Block:
    """Posting lists of a block's documents, the longest first, with a sparse table that reaches as far as lists are long.

    ``docs`` and ``term_ids`` are the postings (a pair once), ``impacts`` their whole-number impacts.
    """

    def __init__(self, size: int, vocabulary: int, docs: np.ndarray, term_ids: np.ndarray, impacts: np.ndarray) -> None:
        self.size = size
        df = np.bincount(term_ids, minlength=vocabulary)
        by_length = np.argsort(-df, kind="stable")
        self.rank = np.empty(vocabulary, np.int64)
        self.rank[by_length] = np.arange(vocabulary)
        self.starts = np.concatenate([[0], np.cumsum(df[by_length])])
        keys = self.rank[term_ids] * size + docs
        order = np.argsort(keys, kind="stable")
        self.keys, self.impacts = keys[order], impacts[order]
        self.docs = docs[order]
        lengths = df[by_length]
        table = [np.arange(len(keys), dtype=np.int32)]
        while (width := 1 << len(table)) <= (lengths[0] if len(lengths) else 0):
            n = self.starts[int(np.searchsorted(-lengths, -width, side="right"))] - width + 1  # windows that begin in lists of at least this length
            left, right = table[-1][:n], table[-1][width // 2 : width // 2 + n]
            table.append(np.where(self.impacts[right] > self.impacts[left], right, left))
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.table = np.concatenate(table)
        self.log = np.zeros(max(2, (lengths[0] if len(lengths) else 0) + 1), np.int64)
        for i in range(1, len(table)):
            self.log[1 << i :] = i

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the greatest impact in each [low, high) of one list; none may be empty."""
        level = self.log[high - low]
        base = self.offsets[level]
        left, right = self.table[base + low], self.table[base + high - (1 << level)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def bound(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of intervals, a column a term: the sum of the terms' greatest impacts, and the document of the greatest one."""
        places = np.zeros(low.shape, np.int64)
        some = high > low
        places[some] = self.greatest(low[some], high[some])
        impacts = np.where(some, self.impacts[places] * weights, 0)
        at = impacts.argmax(axis=1)
        rows = np.arange(len(low))
        return impacts.sum(axis=1), self.docs[places[rows, at]]

    def search(self, item: list[tuple[int, int]], best: list[tuple], ids: list, k: int) -> int:
        """Puts the block's documents into ``best``: a heap of at most ``k`` (score, order of the id reversed), the worst first. Returns the documents scored.

        ``item`` has (term, how often); ``ids`` are the documents' ``Reversed`` ids, falling.
        """
        item = [(self.rank[t], q) for t, q in item if self.starts[self.rank[t] + 1] > self.starts[self.rank[t]]]
        if not item:
            return 0
        ranks, weights = np.array([t for t, _ in item]), np.array([q for _, q in item], np.int64)
        first = ranks * self.size
        low, high = self.starts[ranks][None, :], self.starts[ranks + 1][None, :]
        bounds, splits = self.bound(low, high, weights)
        # (minus the bound, first document, split document, low, high); first documents are unlike in open intervals, so arrays are never compared
        waiting = [(-int(bounds[0]), 0, int(splits[0]), low[0], high[0])]
        scored = 0
        while waiting:
            taken = []
            while waiting and len(taken) < SPLITS:
                entry = heapq.heappop(waiting)
                if not self._may_enter(-entry[0], entry[1], best, ids, k):
                    if len(best) == k and -entry[0] < best[0][0]:
                        waiting.clear()
                    continue
                taken.append(entry)
            if not taken:
                break
            docs = np.array([t[2] for t in taken])
            low, high = np.stack([t[3] for t in taken]), np.stack([t[4] for t in taken])
            wanted = first[None, :] + docs[:, None]
            at = np.searchsorted(self.keys, wanted)
            inside = at < high
            inside[inside] = self.keys[at[inside]] == wanted[inside]
            scores = np.where(inside, self.impacts[np.where(inside, at, 0)] * weights, 0).sum(axis=1)
            scored += len(taken)
            for doc, score in zip(docs.tolist(), scores.tolist()):
                entry = (score, ids[doc])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            lows, highs = np.concatenate([low, at + inside]), np.concatenate([at, high])
            bounds, splits = self.bound(lows, highs, weights)
            begins = [t[1] for t in taken] + (docs + 1).tolist()
            for i in np.flatnonzero(bounds > 0).tolist():
                if self._may_enter(int(bounds[i]), begins[i], best, ids, k):
                    heapq.heappush(waiting, (-int(bounds[i]), begins[i], int(splits[i]), lows[i], highs[i]))
        return scored

    @staticmethod
    def _may_enter(bound: int, first_doc: int, best: list[tuple], ids: list, k: int) -> bool:
        """Whether a document of an interval may still enter: by its score, or by a smaller id at the same score."""
        return len(best) < k or bound > best[0][0] or (bound == best[0][0] and first_doc < len(ids) and ids[first_doc] > best[0][1])


class Reversed:
    """An id that sorts backwards, null first, so that in a heap of the worst first the smallest ids stay longest."""

    __slots__ = ("key", "place")

    def __init__(self, value: object, place: object = None) -> None:
        self.key, self.place = (value is None, value), place

    def __lt__(self, other: Reversed) -> bool:
        return other.key < self.key if other.key[0] != self.key[0] or not self.key[0] else False

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Reversed) and self.key == other.key

    def __gt__(self, other: Reversed) -> bool:
        return other < self


def _postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of every row: its terms with repeats, and those of the vocabulary with how often."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.__contains__
        for batch in batches:
            sizes, found, counts, offsets = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                n, met = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    met.update(filter(known, part))
                sizes.append(n)
                found.extend(map(vocabulary.__getitem__, met))
                counts.extend(met.values())
                offsets.append(len(found))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["id", "n", "terms", "counts"])

    arrow_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, counts array<long>")


def document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; tasks add up theirs, one row a term and task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["term", "n"])

    df = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    return df


def length_norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L of each document, in whole numbers of any size."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 63:
        return 25 + (75 * n * docs) // total
    return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)


def _search_block(docs: DataFrame, id_col: str, text_col: str, items: list[str | None], k: int) -> DataFrame:
    """(item, id, score) of at most ``k`` documents a task and item; items by place."""
    vocabulary: dict[bytes, int] = {}
    asked = []
    for text in items:
        met = Counter(t for part in terms(text) for t in part)
        asked.append([(vocabulary.setdefault(t, len(vocabulary)), q) for t, q in met.items()])
    postings = cut(_postings(docs, id_col, text_col, vocabulary), "search-postings")
    n_docs, total = postings.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(postings, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    id_type = postings.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            table = table.take(pa.compute.sort_indices(table, sort_keys=[("id", "ascending")]))  # nulls come last
            ids = [Reversed(x) for x in table.column("id").to_pylist()]
            lists = table.column("terms").combine_chunks()
            docs = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            term_ids = lists.flatten().to_numpy().astype(np.int64)
            tf = table.column("counts").combine_chunks().flatten().to_numpy()
            norms = length_norms(table.column("n").to_numpy(), n_docs, total)
            block = Block(len(ids), len(weights), docs, term_ids, weights[term_ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norms[docs])))
            for item, top in zip(asked, best):
                block.search(item, top, ids, k)

        rows = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, size = rows + part.num_rows, size + len(part.column("terms").flatten())
                if size >= BLOCK_POSTINGS or rows >= BLOCK_DOCS:
                    search()
                    rows = size = 0
        if held:
            search()
        found = [(i, doc.key[1], score) for i, top in enumerate(best) for score, doc in top if score > 0]
        yield pa.RecordBatch.from_pydict({"item": pa.array([f[0] for f in found], pa.int32()), "id": pa.array([f[1] for f in found], batch_type), "score": pa.array([f[2] for f in found], pa.int64())})

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(postings.schema["id"].dataType)
    return postings.filter("size(terms) > 0").select("id", "n", "terms", "counts").mapInArrow(run, f"item int, id {id_type}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = BEST) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): for each row of ``items`` its ``k`` rows of ``docs`` of the highest score above 0, equal scores by ascending id, null ids last.

    A term is a maximal run of letters and digits of ASCII and of all other signs from U+0080 on, A-Z lower-cased. Scores are whole numbers: the sum, over the item's terms with repeats,
    of w * ((10^9 tf) div (1000 tf + 8 m)), w = floor(1000 ln((2N+2) / (2df+1))), m = 25 + (75 n N) div L. Null and empty texts hold no terms and are
    not counted in N; items without a known term, and empty tables, give no rows; rows that repeat an id or an item are rows of their own.
    Items are read to the driver in blocks of about ``ITEM_BYTES``.
    """
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    spark, parts, held, names, size = docs.sparkSession, [], [], [], 0
    schema = f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"

    def search() -> None:
        nonlocal size
        found = _search_block(docs, id_col, text_col, held, k)
        order = [F.desc("score"), F.col("id").asc_nulls_last()]
        top = pick(found, ["item"], order, k).withColumn("rank", F.row_number().over(_by_item(order)).cast("int"))
        named = spark.createDataFrame(list(enumerate(names)), schema)
        parts.append(cut(top.join(named, "item").select("item_id", "rank", "id", "score"), "search-best"))
        held.clear()
        names.clear()
        size = 0

    for row in asked.toLocalIterator():
        held.append(row.text)
        names.append(row.item_id)
        size += len((row.text or "").encode()) + 64
        if size >= ITEM_BYTES:
            search()
    if held or not parts:
        search()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _by_item(order: list):
    from pyspark.sql import Window

    return Window.partitionBy("item").orderBy(*order)
