"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits, the majority vote of the XXH64 hashes of a text's word shingles. Rows are reduced to
distinct fingerprints first. The bits are grouped so that correlated bits share a part, and a part i may differ in
t_i bits, where the t_i add up to max_bits - parts + 1: any two fingerprints within max_bits then agree on some part
within its t_i (-1: the part is not probed). A dynamic program over the parts picks the t_i of least estimated cost,
from the collisions that all fingerprints have on each part; it is run for two and for three parts. Probing joins a
part's values, and a full comparison of the bits verifies each candidate.

A part's value that more than ``DENSE`` fingerprints share would give pairs in square number. Their fingerprints
are linked instead through centres: two fingerprints are within 2r bits just if some centre is within r bits of
both, and a centre has at most as many fingerprints as a ball of radius r. That is exact and linear in the rows.

``drop_near_copies`` owes a shingle similarity, which 64 bits can't reach: its candidates are these links and, beside
them, the rows that share a shingle among the first hashes of both (``prefixes``), by an order that puts frequent
hashes last. Every candidate is verified by the exact similarity of the shingle sets. Where many rows share a hash, they
meet one another only as far as links found before do not connect them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut, sized_join
from ..plans.fixpoint import components
from .arrow import arrow_batches
from .rows import ids_are_unique, without
from .worker import forget

SHINGLE = 3
MAX_BITS = 2
DENSE = 64
SEED = 42
_BLOCK = 1 << 14
#: Least Jaccard similarity of near copies' shingle sets, as a fraction.
SIMILAR = (4, 5)
#: Rows that share a prefix hash and are compared with one another; more make a crowd.
CROWD = 32
#: Pairs that one copy of a text serves when candidates are verified.
_SERVED = 64
_MOST_LATE, _LATE = 1 << 20, 1 << 62
_KNOWN_WORDS, _KNOWN_SHINGLES, _SKETCH = 1 << 16, 1 << 16, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. Fewer words than ``shingle`` are one shingle; no words give zero."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    grams = iter([b" ".join(words)]) if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    votes, n = np.zeros(64, np.int64), 0
    while block := list(itertools.islice(grams, _BLOCK)):
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, block, repeat(SEED))), np.uint8)
        votes += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        n += len(block)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def shingles(text: bytes | None, shingle: int) -> set[bytes]:
    """The distinct shingles, of the same words as the fingerprint's. No words are one empty shingle."""
    words = (text or b"").lower().split()
    return {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is ``SIMILAR`` at least, in whole numbers."""
    both = len(a & b)
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; only the id and the text reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            fps = [simhash(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _together(fps: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints: 64 x 64, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]
            total += (bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], names=["i", "j", "n"])

    found = np.zeros((64, 64))
    for i, j, n in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        found[i, j] = n
    return found


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Splits the 64 bits into ``parts`` of near-equal size; each takes the free bit that correlates most with its own."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, found = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k >= parts - 64 % parts)
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free -= {part[0]}
        while len(part) < width:
            part.append(max(sorted(free), key=lambda b: corr[b, part].sum()))
            free -= {part[-1]}
        found.append(sorted(part))
    return found


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _flips(bits: list[int], most: int) -> list[int]:
    """All differences of at most ``most`` of ``bits``."""
    return [_mask(list(c)) for k in range(most + 1) for c in itertools.combinations(bits, k)]


def allocate(widths: list[int], pairs: list[float], n: int, max_bits: int) -> tuple[float, list[int]]:
    """Least cost and its thresholds, by dynamic programming over the parts.

    Probing a part of width w within t costs n rows for each value of the ball, and brings as many candidates as
    the part's exact collisions ``pairs`` times the ball.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, c in zip(widths, pairs):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, max_bits + 1):
                ball = sum(comb(w, k) for k in range(t + 1))
                new = (cost + (n + c) * ball, [*chosen, t])
                step[total + t] = min(step.get(total + t, new), new)
        best = step
    return best[max_bits - len(widths) + 1]


def links(classes: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that connect just what is linked within ``max_bits``."""
    if max_bits % 2 or not 2 <= max_bits <= 62:
        raise ValueError("max_bits must be even, and 2 at least")
    n = classes.count()
    together = _together(classes)
    layouts = {m: group_bits(together, n, m) for m in (2, 3)}
    parts = [(m, k, _mask(bits)) for m, groups in layouts.items() for k, bits in enumerate(groups)]
    values = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")) for m, k, mask in parts])).alias("s")).select("fp", "s.*")
    counted = cut(values.groupBy("m", "k", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets")
    pairs = {(m, k): float(c) for m, k, c in counted.groupBy("m", "k").agg(F.sum(F.least(F.col("n"), F.lit(dense)) * (F.col("n") - 1) / 2)).collect()}
    plans = {m: allocate([len(g) for g in groups], [pairs.get((m, k), 0.0) for k in range(m)], n, max_bits) for m, groups in layouts.items()}
    m = min(plans, key=lambda x: plans[x])
    thresholds = plans[m][1]

    hot = cut(counted.filter((F.col("m") == m) & (F.col("n") > dense)).select("k", "value", F.lit(True).alias("hot")), "simhash-hot")
    n_hot = hot.count()
    held, asked = [], []
    for k, t in enumerate(thresholds):
        if t < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(_mask(layouts[m][k])).cast("long"))
        held.append(classes.select(F.lit(k).alias("k"), value.alias("value"), "fp"))
        flips = F.array(*[F.lit(x).cast("long") for x in _flips(layouts[m][k], t)])
        asked.append(classes.select(F.lit(k).alias("k"), value.alias("v"), "fp", F.explode(flips).alias("flip")).select("k", F.col("v").bitwiseXOR(F.col("flip")).alias("value"), "fp") if t else held[-1])
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    held_all = sized_join(union(held), hot, ["k", "value"], "left", n_hot * 32)
    asked_all = held_all if asked == held else sized_join(union(asked), hot, ["k", "value"], "left", n_hot * 32)
    near = held_all.filter("hot is null").select("k", "value", F.col("fp").alias("a")).join(asked_all.filter("hot is null").select("k", "value", F.col("fp").alias("b")), ["k", "value"])
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    found = near.filter((F.col("a") < F.col("b") if asked == held else F.col("a") != F.col("b")) & exact).select("a", "b")
    if n_hot:
        crowd = held_all if asked == held else held_all.unionByName(asked_all)
        crowd = crowd.filter("hot").select("fp").distinct()
        centres = F.array(*[F.lit(x).cast("long") for x in _flips(list(range(64)), max_bits // 2)])
        crowd = crowd.select("fp", F.explode(centres).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        crowd = crowd.withColumn("a", F.min("fp").over(Window.partitionBy("centre"))).filter("a <> fp")
        found = found.unionByName(crowd.select("a", F.col("fp").alias("b")))
    return found.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``max_bits`` bits. Null and empty texts, and
    those of white space, have fingerprint zero and link like any other. Null ids are scored, but never name a
    component unless all its ids are null. Repeated rows share a component. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(links(classes, max_bits))
    named = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(names, "root").select("fp", "component_id"), "simhash-named")
    out = sized_join(rows, named, ["fp"], "inner", named.count() * 40)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _hashes(text: bytes | None, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """62-bit hashes of the distinct shingles, sorted. Words are hashed once; a shingle mixes the hashes of its words in order."""
    words = (text or b"").lower().split()
    if len(known) > _KNOWN_WORDS:
        known.clear()
    for w in {*words}.difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    mixed = np.full(len(words) - size + 1 if size else 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed >> np.uint64(2)).astype(np.int64)


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, last: Broadcast | None = None) -> DataFrame:
    """(id, n, top, hs, sketch): ``hs`` are the first hashes of a row's n distinct shingles, as many as similar rows can't all miss.

    The order is that of the hashes, but those in ``last`` (sorted) follow all others, with bit 62 set. A similar row shares at
    least n * SIMILAR of the shingles, so the n - ceil(n * SIMILAR) + 1 first hashes of both have one in common, in whatever
    order. ``top`` is the last of them. ``sketch`` has the parity of the number of hashes in each of ``_SKETCH`` * 64 residues: two
    rows differ in at least as many shingles as their sketches in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[bytes, int] = {}
        late = last.value if last else np.empty(0, np.int64)
        for batch in batches:
            hs, ns, sketches = [], [], []
            for text in batch.column("text"):
                h = _hashes(text.as_py(), shingle, known)
                sketches.append(np.packbits(np.bincount(h % (64 * _SKETCH), minlength=64 * _SKETCH).astype(np.uint8) & 1).view(np.int64))
                if len(late):
                    at = np.searchsorted(late, h)
                    h = np.sort(np.where(late[np.minimum(at, len(late) - 1)] == h, h | _LATE, h))
                ns.append(len(h))
                hs.append(h[: len(h) + 1 + -len(h) * SIMILAR[0] // SIMILAR[1]])
            if hs:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hs)]), pa.int32()), pa.array(np.concatenate(hs)))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(hs) + 1) * _SKETCH, pa.int32()), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ns, pa.int32()), pa.array([h[-1] for h in hs], pa.int64()), lists, sketch], names=["id", "n", "top", "hs", "sketch"])

    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n int, top long, hs array<long>, sketch array<long>")


def _need() -> Column:
    """How many hashes x and y must share up to the lesser top, at least, to be similar: beyond it they share at most all that the row has."""
    few, many = SIMILAR
    beyond = F.ceil(F.when(F.col("x.top") <= F.col("y.top"), F.col("x.n")).otherwise(F.col("y.n")) * few / many) - 1
    return F.ceil((F.col("x.n") + F.col("y.n")) * few / (few + many)) - beyond


def _sizes_fit() -> Column:
    few, many = SIMILAR
    return F.expr(f"x.n * {few} <= y.n * {many} and y.n * {few} <= x.n * {many}")


def _sharing(met: DataFrame, need: Column) -> DataFrame:
    """(a, b), a < b, each once, of the rows (x, y) that meet at ``need`` hashes or more."""
    met = met.withColumn("need", need.cast("int")).filter(_sizes_fit() & (F.least("x.colds", "y.colds") + F.least("x.crowds", "y.crowds") >= _need()))
    counted = met.groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
    return counted.filter("shared >= need").select("a", "b")


def _with_firsts(crowd: DataFrame, order: Column) -> DataFrame:
    """(a, b): each row of a crowd with the crowd's first row by ``order``."""
    firsts = cut(crowd.groupBy("h").agg(F.min(F.struct(order.alias("o"), "x"))["x"].alias("y")), "near-prefix-firsts")
    return _sharing(sized_join(crowd, firsts, ["h"], "inner", firsts.count() * 96).filter("x.id <> y.id"), F.lit(1))


def _across(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b) of crowds that links do not connect yet: the rows outside of a crowd's largest component with all others of other ones.

    They share no hash but those of crowds, or they would have been candidates, so that the crowds where they meet have to be enough.
    """
    roots = cut(components(found), "near-roots")
    rooted = sized_join(crowd.withColumn("node", F.col("x.id")), roots, ["node"], "left", roots.count() * 32).select("h", "x", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted, "near-rooted")
    parts = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = cut(parts.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("big"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("h", "big"), "near-largest")
    open_rows = sized_join(rooted, largest, ["h"], "inner", largest.count() * 40)
    few = open_rows.filter("root <> big").select("h", "x", F.col("root").alias("root_x"))
    met = few.join(open_rows.select("h", F.col("x").alias("y"), F.col("root").alias("root_y"), "big"), "h").filter("root_x <> root_y and (root_y = big or x.id < y.id)")
    few_, many = SIMILAR
    differ = sum((F.bit_count(F.col("x.sketch")[k].bitwiseXOR(F.col("y.sketch")[k])) for k in range(_SKETCH)), F.lit(0))
    alike = differ * (few_ + many) <= (F.col("x.n") + F.col("y.n")) * (many - few_)
    return _sharing(met.filter((F.least("x.crowds", "y.crowds") >= _need()) & alike), _need())


def _shared_hashes(docs: DataFrame, id_col: str, text_col: str, shingle: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """The rows' prefixes, and (id, h, m) of the prefix hashes that m > 1 rows hold.

    Hashes that more than ``dense`` rows hold are put last and the prefixes taken again, so that only rows made of little else meet
    in crowds. At most ``_MOST_LATE`` hashes are put last, the most frequent: that bounds the broadcast and changes no result.
    """
    spark, late = docs.sparkSession, None
    while True:
        rows = cut(prefixes(docs, id_col, text_col, shingle, late), "near-prefixes")
        sizes = cut(rows.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-prefix-sizes")
        if late is None:
            often = sizes.filter(F.col("m") > dense).orderBy(F.col("m").desc(), "h").limit(_MOST_LATE).select("h").toPandas()["h"]
            if len(often):
                late = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64)))
                continue
        held = sized_join(rows.select("id", F.explode("hs").alias("h")), sizes, ["h"], "inner", sizes.count() * 32)
        return rows, cut(held, "near-prefix-shared")


def _prefix_pairs(docs: DataFrame, id_col: str, text_col: str, shingle: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b), a < b, that share a hash which at most ``dense`` rows hold, and the rows (h, x) of crowds.

    A pair goes when the hashes that it shares can't add up to the similarity.
    """
    rows, held = _shared_hashes(docs, id_col, text_col, shingle, dense)
    crowd = F.col("m") > dense
    counts = held.groupBy("id").agg(F.count_if(crowd).cast("int").alias("crowds"), F.count_if(~crowd).cast("int").alias("colds"))
    told = rows.join(counts, "id").select("id", F.struct("id", "n", "top", "crowds", "colds", (F.size("hs") - F.col("crowds") - F.col("colds")).alias("own"), "sketch").alias("x"))
    told = cut(told, "near-prefix-rows")
    n = told.count()
    cold = sized_join(held.filter(~crowd), told.withColumn("x", F.col("x").dropFields("own", "sketch")), ["id"], "inner", n * 64).select("h", "x")
    met = cold.join(cold.withColumnRenamed("x", "y"), "h").filter("x.id < y.id")
    pairs = _sharing(met, _need() - F.least("x.crowds", "y.crowds"))
    return pairs, cut(sized_join(held.filter(crowd), told, ["id"], "inner", n * 160).select("h", "x"), "near-prefix-crowds")


def _fingerprint_pairs(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(a, b), a < b: each row with the least id of its fingerprint, and these of linked fingerprints."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "near-fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "near-classes")
    edges = cut(links(classes, max_bits), "near-links")
    size = classes.count() * 32
    same = sized_join(rows, classes, ["fp"], "inner", size).filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    for side in "ab":
        edges = sized_join(edges, classes.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")), [side], "inner", size)
    return same.unionByName(edges.select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b")))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``texts`` (id, text) are similar. A text in many pairs is copied, so that they can part."""
    whole = pairs
    for side, other in ("ab", "ba"):
        uses = cut(pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count(F.lit(1)) / _SERVED).alias("copies")), "near-uses")
        size = uses.count() * 40
        held = sized_join(texts, uses, ["id"], "inner", size).select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        dealt = sized_join(whole, uses.withColumnRenamed("id", side), [side], "inner", size)
        whole = dealt.withColumn("copy", F.pmod(F.xxhash64(other), "copies")).drop("copies").join(held, [side, "copy"]).drop("copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[bytes, set[bytes]] = {}
        held = 0

        def of(text: bytes) -> set[bytes]:
            nonlocal held
            if text not in known:
                found = shingles(text, shingle)
                if held + len(found) > _KNOWN_SHINGLES:
                    known.clear()
                    held = 0
                known[text] = found
                held += len(found)
            return known[text]

        for batch in batches:
            near = [similar(of(x.as_py()), of(y.as_py())) for x, y in zip(batch.column("text_a"), batch.column("text_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    arrow_batches(pairs.sparkSession)
    kind = pairs.schema["a"].dataType.simpleString()
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def near_pairs(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, max_bits: int = MAX_BITS, dense: int = CROWD) -> DataFrame:
    """(a, b), a < b: pairs of ids, which have to be unique, whose shingle sets are ``SIMILAR``; they connect all rows that such pairs connect.

    All similar pairs that share a prefix hash of at most ``dense`` rows are among them. In a crowd each row meets the first by two
    orders, and then the rows that the links found so far do not connect with it, so that no pair goes unseen whose link is missing.
    """
    pairs, crowd = _prefix_pairs(docs, id_col, text_col, shingle, dense)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    tried = pairs.unionByName(_fingerprint_pairs(docs, id_col, text_col, shingle, max_bits))
    if crowd.isEmpty():
        return cut(_verified(cut(tried.distinct(), "near-candidates"), texts, shingle), "near-found")
    tried = cut(tried.unionByName(_with_firsts(crowd, F.col("x.own"))).distinct(), "near-candidates")
    found = cut(_verified(tried, texts, shingle), "near-found")
    for step in ("linked", "across"):
        if step == "linked":
            links_of = cut(found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links")), "near-linked")
            ranked = sized_join(crowd.withColumn("id", F.col("x.id")), links_of, ["id"], "left", links_of.count() * 32)
            met = _with_firsts(ranked, F.struct(-F.coalesce("links", F.lit(0)), "x.own"))
        else:
            met = _across(crowd, found)
        more = cut(met.join(tried, ["a", "b"], "left_anti"), "near-candidates")
        found = found.unionByName(cut(_verified(more, texts, shingle), "near-found"))
        tried = tried.unionByName(more)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each group of rows linked by ``near_pairs`` the one with the smallest id.

    Null ids come last; of rows that repeat an id exactly one stays, by their order in the table. Where ids are unique, only the
    texts of candidates are written on the way.
    """
    if ids_are_unique(docs, id_col):
        found = components(near_pairs(docs, id_col, text_col, shingle, max_bits))
        return without(docs, id_col, found.filter("node <> root").select(F.col("node").alias("id")), "near-gone")
    kept = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("rid")), "near-rows")
    found = components(near_pairs(kept, "rid", "text", shingle, max_bits))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    members = cut(found.select(F.col("node").alias("rid"), F.col("root").alias("component_id")), "near-members")  # rows with a partner only
    n = members.count()
    members = cut(sized_join(kept.select("rid", "id"), members, ["rid"], "inner", n * 40), "near-member-ids")
    firsts = members.groupBy("component_id").agg(F.min(order)["rid"].alias("first"))
    gone = cut(members.join(firsts, "component_id").filter("rid <> first").select("rid"), "near-gone")
    return sized_join(kept, gone, ["rid"], "left_anti", n * 32).select("row.*")
