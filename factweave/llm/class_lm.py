"""Brown class-based bigram language model, learned from and applied to a whole table.

Words that occur ``LEAST_COUNT`` times or more are clustered; all others share one class, and so does the end of a text
with itself. p(word | before) = p(class | class before) * p(word | class). Transitions are interpolated with the classes'
shares. In the class of the rare words, emissions are discounted by D = n1 / (n1 + 2 n2), and the discount and one more
token go to the unknown word, so that each class's words add up to 1.

Exchange clustering starts with a class for each of the most frequent words. A sweep counts, in Spark, how often every
clustered word follows and precedes each class, and deals the words over groups of ``GROUP_WORDS`` neighbours by
frequency. Each group moves its words in turn to the classes in which the class bigrams are likeliest, against its own copy of
the class bigrams, which follows its moves; a table of one group is the sequential algorithm.

Words are known by 64-bit hashes. Hashes, classes and counts of the clustered words are broadcast; ``MOST_LISTED`` bounds
them, and where more words qualify the most frequent are taken. The counts of the rare words stay in a distributed table;
when scoring, each document's rare words are joined with them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut
from .arrow import arrow_batches
from .worker import forget
from .quality import remainder

CLASSES = 48
ENDS, RARE, FIRST = 0, 1, 2  # the class of the end, that of words which are not listed, and the first of the clustered words
LEAST_COUNT = 10
MOST_LISTED = 1 << 21
SWEEPS = 3
GROUP_WORDS = 20_000
TOGETHER, BLOCK_WORDS = 1e-3, 256
HELD_OUT = (7, 2)
FLUSH_WORDS = 400_000
FLUSH_KEYS = 2_000_000
END = b""  # no word is empty


def words_of(text: bytes | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes methods know ASCII only."""
    return (text or b"").lower().split()


def word_hash(word: bytes) -> int:
    """Signed, as Spark has no unsigned numbers."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Numbers:
    """Places of words in a sorted list of hashes, -1 for others; remembered for the words met lately."""

    def __init__(self, listed: np.ndarray) -> None:
        self.listed, self.known = listed, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > FLUSH_WORDS:
            self.known.clear()
        new = list({*words}.difference(self.known))
        if new:
            h = np.fromiter(map(word_hash, new), np.int64, len(new))
            at = np.searchsorted(self.listed, h)
            at = np.where(self.listed[np.minimum(at, len(self.listed) - 1)] == h, at, -1)
            self.known.update(zip(new, at.tolist()))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts, the end of a text counted as the empty word; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                counts.update(words_of(text.as_py()))
                counts[END] += 1
            if len(counts) > FLUSH_WORDS:
                yield flush()
        yield flush()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _listed(counts: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words that occur ``least`` times or more and of the end. Where they are more than ``most``,
    words go by steps of their count, and those of the last step by their hash."""
    words = counts.filter((F.col("n") >= least) | (F.octet_length("word") == 0))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(word_hash, batch.column("word").to_pylist())), pa.int64()), batch.column("n")], names=["h", "n"])

    step = F.when(F.octet_length("word") == 0, 1 << 20).otherwise(F.floor(F.log2("n") * 8)).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 512 steps
    total, wanted = 0, F.lit(True)
    for at, n in sorted(((r["step"], r["words"]) for r in sizes), reverse=True):
        if total + n > most:
            part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int((most - total) / n * (1 << 20))
            wanted = (step > at) | ((step == at) & part)
            break
        total += n
    found = words.filter(wanted).select("word", "n").mapInArrow(hashed, "h long, n long").toPandas().sort_values(["h", "n"])
    found = found.drop_duplicates("h", keep="last")
    return found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def encode(rows: DataFrame, listed: np.ndarray) -> DataFrame:
    """(rid, id, train, at, rare, tf) from rows (rid, id, train, text): the places of a text's words and its end among ``listed``, -1 for
    others, and these words with how often they occur."""
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        numbers = Numbers(shared.value)
        for batch in batches:
            at, sizes, rare, tf, kinds = [], [0], [], [], [0]
            for text in batch.column("text"):
                words = [*words_of(text.as_py()), END]
                found = numbers.of(words)
                others = Counter(words[k] for k in np.flatnonzero(found < 0).tolist())
                at.append(found.astype(np.int32))
                sizes.append(sizes[-1] + len(found))
                rare += others
                tf += others.values()
                kinds.append(len(rare))
            lists = [(sizes, pa.array(np.concatenate(at) if at else [], pa.int32())), (kinds, pa.array(rare, pa.binary())), (kinds, pa.array(tf, pa.int32()))]
            arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for offsets, values in lists]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), batch.column("train"), *arrays], names=["rid", "id", "train", "at", "rare", "tf"])

    schema = f"rid long, id {rows.schema['id'].dataType.simpleString()}, train boolean, at array<int>, rare array<binary>, tf array<int>"
    return cut(rows.select("rid", "id", "train", "text").mapInArrow(run, schema), "lm-encoded")


def _lines(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The places of a batch's words, one text after another: each starts after an end and has its own at last."""
    for batch in batches:
        yield np.append(np.int64(end), batch.column("at").flatten().to_numpy().astype(np.int64))


def neighbour_classes(train: DataFrame, shared: Broadcast, classes: int) -> DataFrame:
    """(key, n) with key = word * (2 * classes + 1) + slot: how often a word is followed by the class ``slot``, preceded by the class
    ``slot - classes``, and, in the last slot, followed by itself. Words that are not listed count as one more word."""
    width = 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, cls = int(np.flatnonzero(shared.value == ENDS)[0]), np.append(shared.value, RARE).astype(np.int64)  # cls[-1] is that of words which are not listed
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

        for line in _lines(batches, end):
            c, word = cls[line], np.where(line < 0, len(cls) - 1, line) * width
            held += [word[:-1] + c[1:], word[1:] + classes + c[:-1], word[:-1][(line[:-1] == line[1:]) & (line[1:] >= 0)] + 2 * classes]
            if sum(map(len, held)) > FLUSH_KEYS:
                yield flush()
        yield flush()

    return train.select("at").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def class_bigrams(train: DataFrame, shared: Broadcast, classes: int) -> np.ndarray:
    """How often a class follows another, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        end, cls = int(np.flatnonzero(shared.value == ENDS)[0]), np.append(shared.value, RARE).astype(np.int64)
        total = np.zeros(classes * classes, np.int64)
        for line in _lines(batches, end):
            c = cls[line]
            total += np.bincount(c[:-1] * classes + c[1:], minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(total)], names=["pair", "n"])

    out = np.zeros(classes * classes)
    for pair, n in train.select("at").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(classes, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _gains(T: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How much likelier the class bigrams T get with each of the words, taken out of its class g, in each class: words x classes."""
    f, k = _xlogx, np.arange(len(g))
    gain = np.zeros_like(right)
    for table, this, other in ((T, right, left), (T.T, left, right)):
        w, s = np.nonzero(this)
        n, base = this[w, s][:, None], table[:, s].T.copy()
        base[np.arange(len(w)), g[w]] -= n[:, 0]
        back = s == g[w]  # cells that the word has on its other side too
        base[back] -= other[w[back]]
        base[np.flatnonzero(back), s[back]] -= own[w[back]]
        np.add.at(gain, w, f(base + n) - f(base))
        total, sums = this.sum(axis=1) + own, np.tile(table.sum(axis=1), (len(g), 1))
        sums[k, g] -= total
        gain -= f(sums + total[:, None]) - f(sums)
    d = np.tile(np.diag(T), (len(g), 1))
    d[k, g] -= right[k, g] + left[k, g] + own
    return gain + f(d + right + left + own[:, None]) - f(d + right) - f(d + left) + f(d)


def exchange(words: np.ndarray, slots: np.ndarray, n: np.ndarray, cls: np.ndarray, table: np.ndarray) -> dict[int, int]:
    """The classes of ``words`` that move, in turn by how frequent they are: each goes to the class in which the class bigrams are likeliest.

    ``words``, ``slots``, ``n`` are rows of ``neighbour_classes``, ``cls`` the classes they were counted by and ``table`` those classes' bigrams.
    The neighbours' classes are those of the count; the table follows the moves. Words that together are less than ``TOGETHER`` of
    all tokens move at once.
    """
    classes, table, moved = len(table), table.astype(float), {}
    order = np.lexsort((slots, words))
    words, slots, n = words[order], slots[order], n[order]
    names, starts = np.unique(words, return_index=True)
    sizes = np.diff(np.append(starts, len(words)))
    weight = np.add.reduceat(np.where(slots < classes, n, 0), starts) if len(names) else np.empty(0)
    by_weight, most = np.lexsort((names, -weight)), TOGETHER * table.sum()
    at = 0
    while at < len(by_weight):
        size = max(1, int(np.searchsorted(np.cumsum(weight[by_weight[at : at + BLOCK_WORDS]]), most, "right")))
        block = by_weight[at : at + size]
        at += size
        both = np.zeros((len(block), 2 * classes + 1))
        rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in block])
        both[np.repeat(np.arange(len(block)), sizes[block]), slots[rows]] = n[rows]
        right, left, own = both[:, :classes], both[:, classes:-1], both[:, -1]
        g, k = cls[names[block]], np.arange(len(block))
        right[k, g] -= own
        left[k, g] -= own
        gain = _gains(table, right, left, own, g)
        gain[:, :FIRST] = -np.inf
        h = np.where(gain[k, g] >= gain.max(axis=1) - 1e-9, g, gain.argmax(axis=1))
        for k in np.flatnonzero(h != g):
            for c, sign in ((g[k], -1), (h[k], 1)):
                table[c] += sign * right[k]
                table[:, c] += sign * left[k]
                table[c, c] += sign * own[k]
            moved[int(names[block[k]])] = int(h[k])
    return moved


def sweep(train: DataFrame, listed: np.ndarray, n: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    """The classes after every clustered word has been moved once. Groups are neighbours in frequency, so that few groups hold words of weight."""
    spark, width = train.sparkSession, 2 * classes + 1
    shared = spark.sparkContext.broadcast(cls)
    counted = cut(neighbour_classes(train, shared, classes), "lm-neighbours")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = np.append(shared.value, RARE).astype(np.int64), np.zeros(classes * classes, np.int64)
        for batch in batches:
            word, slot = np.divmod(batch.column("key").to_numpy(), width)
            after = slot < classes
            total += np.bincount(of[word[after]] * classes + slot[after], batch.column("n").to_numpy()[after], classes * classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(total)], names=["pair", "n"])

    table = np.zeros(classes * classes)
    for pair, found in counted.mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        table[pair] = found
    rank = np.empty(len(listed), np.int64)
    rank[np.lexsort((listed, -n))] = np.arange(len(listed))
    told = spark.sparkContext.broadcast((cls, table.reshape(classes, classes), rank // GROUP_WORDS))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, _, group = told.value
        for batch in batches:
            word, slot = np.divmod(batch.column("key").to_numpy(), width)
            keep = word < len(group)
            keep[keep] = cls[word[keep]] >= RARE
            yield pa.RecordBatch.from_arrays([pa.array(group[word[keep]]), pa.array(word[keep]), pa.array(slot[keep]), pa.array(batch.column("n").to_numpy()[keep])], names=["part", "word", "slot", "n"])

    def move(pdf):
        import pandas as pd

        cls, table, _ = told.value
        moved = exchange(pdf["word"].to_numpy(), pdf["slot"].to_numpy(), pdf["n"].to_numpy(float), cls, table)
        return pd.DataFrame({"word": list(moved), "c": list(moved.values())}, dtype=np.int64)

    moved = counted.mapInArrow(grouped, "part long, word long, slot long, n long").groupBy("part").applyInPandas(move, "word long, c long").toPandas()
    out = cls.copy()
    out[moved["word"].to_numpy(np.int64)] = moved["c"].to_numpy(np.int64)
    return out


@dataclass
class Model:
    """What scoring broadcasts; ``MOST_LISTED`` and the number of classes bound it."""

    listed: np.ndarray  # hashes of the clustered words and the end, sorted
    counts: np.ndarray
    cls: np.ndarray
    transition: np.ndarray  # log10 p(class | class before)
    mass: np.ndarray  # log10 of a class's tokens; one more in the class of rare words
    unknown: float  # log10 of what the unknown word has of them
    discount: float
    tokens: int
    types: int


def train_model(rows: DataFrame, classes: int = CLASSES, least: int = LEAST_COUNT, sweeps: int = SWEEPS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of all counts, and the encoded texts, from rows (rid, id, train, text binary); it learns where ``train``."""
    spark = rows.sparkSession
    arrow_batches(spark)
    counts = cut(word_counts(rows.filter("train")), "lm-counts")
    tokens, types, n1, n2 = counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    listed, n = _listed(counts, least, MOST_LISTED)
    if not len(listed):  # no training text
        listed, n = np.array([word_hash(END)], np.int64), np.zeros(1, np.int64)
    end = int(np.searchsorted(listed, word_hash(END)))
    cls = np.full(len(listed), RARE, np.int64)
    frequent = [k for k in np.lexsort((listed, -n))[: classes - FIRST + 1] if k != end][: classes - FIRST]
    cls[frequent] = FIRST + np.arange(len(frequent))
    cls[end] = ENDS
    encoded = encode(rows, listed)
    train = encoded.filter("train")
    for _ in range(sweeps if tokens else 0):
        cls = sweep(train, listed, n, cls, classes)
    table = class_bigrams(train, spark.sparkContext.broadcast(cls), classes)
    share = (table.sum(axis=0) + 1) / (table.sum() + classes)
    transition = np.log10((table + share) / (table.sum(axis=1, keepdims=True) + 1))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    in_class = np.bincount(cls, n, classes)
    rare_types = types - int((cls != RARE).sum()) if tokens else 0
    in_class[RARE] = (tokens or 0) - np.delete(in_class, RARE).sum() + 1
    return Model(listed, n, cls, transition, np.log10(np.maximum(in_class, 1)), math.log10(discount * rare_types + 1), discount, tokens or 0, types), counts, encoded


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = HELD_OUT, **settings) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from rows whose crc32(id as text) mod ``held_out[0]`` is not ``held_out[1]``. A null text is empty and
    has its end as the only token. Scores are log10 probabilities of the whole text; base_score is that of the add-one
    unigram model. Repeated rows are scored alike, and each counts in training. Of words that are equally frequent the one with the
    lesser hash goes first. Very long texts are read whole. Without training rows base_score is 0. An empty table gives no rows.
    ``settings`` (classes, least, sweeps) go to ``train_model``.
    """
    spark: SparkSession = docs.sparkSession
    of, out = held_out
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), F.monotonically_increasing_id().alias("rid"))
    model, counts, encoded = train_model(rows.withColumn("train", remainder(F.col("id"), of) != out), **settings)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        cls = np.append(model.cls, RARE)  # the last place, -1, is that of words which are not listed
        base = np.append(np.log10(model.counts + 1.0), 0.0)
        taken = np.where(model.cls == RARE, model.discount, 0.0)
        emit = np.append(np.log10(np.maximum(model.counts - taken, 1e-9)), 0.0) - model.mass[cls]
        emit[:-1][model.counts == 0] = model.unknown - model.mass[RARE]
        seen = np.append(model.counts > 0, False)
        for batch in batches:
            tf, a, b, k = [], [], [], []
            for text in batch.column("at"):
                at = text.values.to_numpy()
                g = cls[at]
                tf.append(len(at))
                a.append(float(base[at].sum()))
                b.append(float(model.transition[np.append(ENDS, g[:-1]), g].sum() + emit[at].sum()))
                k.append(int(seen[at].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), *(pa.array(x, t) for x, t in ((tf, pa.int64()), (k, pa.int64()), (a, pa.float64()), (b, pa.float64())))], names=["rid", "id", "n_tokens", "n_known", "base", "score"])

    arrow_batches(spark)
    kind = rows.schema["id"].dataType.simpleString()
    heads = encoded.select("rid", "id", "at").mapInArrow(run, f"rid long, id {kind}, n_tokens long, n_known long, base double, score double")
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "tf")).alias("w")).select("rid", F.col("w.rare").alias("word"), F.col("w.tf").alias("tf")).join(counts, "word", "left")
    met = F.col("n").isNotNull()
    found = [F.when(met, F.col("tf")).otherwise(0).cast("long"), F.when(met, F.col("tf") * F.log10(F.col("n") + 1)).otherwise(0.0), F.col("tf") * F.when(met, F.log10(F.col("n") - model.discount)).otherwise(F.lit(model.unknown))]
    rare = rare.select("rid", F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("n_tokens"), *[c.alias(x) for c, x in zip(found, ("n_known", "base", "score"))])
    scored = heads.unionByName(rare).groupBy("rid").agg(F.max("id").alias("id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    floor = math.log10(model.tokens + model.types + 1)
    return scored.select(
        F.col("id").alias(id_col), (remainder(F.col("id"), of) == out).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
