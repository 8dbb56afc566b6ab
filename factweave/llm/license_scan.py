"""License scan by conditional compression.

Sentences with a cue word, and what lies between near ones, form candidate blocks. Of a block, each template is held against windows of bounded width
in which enough of its words occur. Those words of a window that the template has are compressed alone and with the template as a zstandard raw dictionary; only a
window that the dictionary makes shorter goes on, and is confirmed by the exact differences in wording: the words of the template that it lacks or changes. Of all wordings that confirm, those of the fewest differences
are taken; what they leave is held against the templates again. A wording may have as many words inserted as it has, and sixteen more.
"""

from __future__ import annotations

import bisect
import difflib
import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_batches
from .license_texts import TEMPLATES
from .worker import kept

CUES = r"(?i)licen[sc]|permission|warrant|redistribut|spdx|public domain|free software|\bcc0\b|\bcc by"
#: Sentences without a cue that may lie between two of one block.
GAP = 2
#: Least share of a template's words that the block has in order.
COVERAGE = 0.9
_CUE = regex.compile(CUES)
_SENTENCE = regex.compile(r"[^\n]+?(?:[.!?:;](?=\s)|(?=\n)|$)", regex.M)
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-/][\p{L}\p{N}]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks, by code points: from the first to the last cue sentence with at most ``GAP`` others between any two."""
    spans = [m.span() for m in _SENTENCE.finditer(text)]
    runs: list[list[int]] = []
    for k, (a, b) in enumerate(spans):
        if _CUE.search(text, a, b):
            if runs and k - runs[-1][1] <= GAP + 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
    return [(spans[i][0], spans[j][1]) for i, j in runs]


class Scanner:
    """Compressors and word lists of the templates, built once a worker.

    A candidate of a template is a window of at most ``reach`` words, whatever the text's length. Windows begin where enough words of the template
    follow, which is necessary for its coverage, so each template passes over a text once and time grows with the text.
    """

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: words(t) for name, t in templates.items()}
        self.counts = {name: Counter(w) for name, w in self.words.items()}
        self.need = {name: math.ceil(COVERAGE * len(w) - 1e-9) for name, w in self.words.items()}
        self.reach = {name: 2 * len(w) + 16 for name, w in self.words.items()}
        self.ids = {w: k for k, w in enumerate({w for ws in self.words.values() for w in ws})}
        self.member = {name: np.isin(np.arange(len(self.ids) + 1), [self.ids[w] for w in ws]) for name, ws in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.given = {name: zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, t in templates.items()}

    def saved(self, block: str, name: str) -> float:
        """The share of the block's compressed size that the template saves as a dictionary."""
        data = block.lower().encode()
        return 1 - len(self.given[name].compress(data)) / len(self.plain.compress(data))

    def explains(self, window: list[str], name: str) -> bool:
        """Whether the template, as a dictionary, makes the window shorter. Only words that the template has are compressed, so that inserted ones can't hide a wording."""
        return self.saved(" ".join(w for w in window if w in self.counts[name]), name) > 0

    def confirm(self, have: list[str], name: str) -> tuple[int, int, int, int, str] | None:
        """(first, end, missing words, extra words, differences) of the words against the template, or None below the coverage."""
        want = self.words[name]
        match = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        hit = sum(m.size for m in match)
        if hit < self.need[name]:
            return None
        first, end = match[0].b, match[-1].b + match[-1].size
        inside = have[first:end]
        changes = [f"{tag} {' '.join(want[a:b])} > {' '.join(inside[c:d])}" for tag, a, b, c, d in difflib.SequenceMatcher(None, want, inside, autojunk=False).get_opcodes() if tag != "equal"]
        return first, end, len(want) - hit, len(inside) - hit, "; ".join(changes)

    def candidates(self, name: str, have: list[str], ids: np.ndarray, cued: np.ndarray, low: int, high: int) -> Iterator[tuple]:
        """(rank, window, hit) of the template's confirmed windows among the words from ``low`` to ``high``, from left to right."""
        reach, need, wanted = self.reach[name], self.need[name], self.counts[name]
        step = max(1, reach // 4)
        held = np.concatenate([[0], np.cumsum(self.member[name][ids[low:high]])])
        at = np.arange(high - low)
        ends = np.minimum(at + reach, high - low)
        starts = low + np.flatnonzero((held[1:] > held[:-1]) & (held[ends] - held[:-1] >= need) & (cued[low + ends] > cued[low + at]))
        k = 0
        while k < len(starts):
            begin = int(starts[k])
            end = min(begin + reach + step, high)
            window = have[begin:end]
            after = begin + step
            if sum((wanted & Counter(window)).values()) >= need and self.explains(window, name):
                found = self.confirm(window, name)
                if found and found[0] >= step:  # it may go on beyond this window: another begins with it
                    after = begin + found[0]
                elif found and cued[begin + found[1]] > cued[begin + found[0]]:
                    first, last, missing, extra, changes = found
                    after = begin + last
                    yield (missing + extra, -len(self.words[name]), name, begin + first, begin + last), (begin, end), (missing, extra, changes)
            k = int(np.searchsorted(starts, after))

    def scan(self, text: str) -> list[tuple]:
        """(start, end, template, saved, coverage, missing, extra, exact, differences) of each wording that a template explains; none overlap.

        Confirmed wordings are taken by the fewest differences, then the longest template, then the name; one that overlaps what is taken is confirmed anew in what is left of its window.
        """
        near = blocks(text)
        if not near:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        have = [text[a:b].lower() for a, b in places]
        ids = np.array([self.ids.get(w, len(self.ids)) for w in have], np.int64)
        mark = np.zeros(len(have) + 1, np.int64)
        begins, stops = [a for a, _ in places], [b for _, b in places]
        for a, b in near:  # a word belongs to a block if it overlaps it
            mark[bisect.bisect_right(stops, a) : bisect.bisect_left(begins, b)] = 1
        cued = np.concatenate([[0], np.cumsum(mark)])
        waiting = [c for name in self.words for c in self.candidates(name, have, ids, cued, 0, len(have))]
        heapq.heapify(waiting)
        taken: list[tuple[int, int]] = []
        found = []
        while waiting:
            rank, (begin, end), (missing, extra, changes) = heapq.heappop(waiting)
            _, _, name, first, last = rank
            k = bisect.bisect_left(taken, (first, first))
            over = [t for t in taken[max(0, k - 1) : bisect.bisect_left(taken, (end, end)) + 1] if t[0] < last and first < t[1]]
            if over:
                cuts = [begin, *(x for t in taken[max(0, bisect.bisect_left(taken, (begin, begin)) - 1) : bisect.bisect_left(taken, (end, end)) + 1] for x in t if t[0] < end and begin < t[1]), end]
                for low, high in zip(cuts[::2], cuts[1::2]):
                    if max(low, begin) < min(high, end):
                        for c in self.candidates(name, have, ids, cued, max(low, begin), min(high, end)):
                            heapq.heappush(waiting, c)
                continue
            bisect.insort(taken, (first, last))
            want = len(self.words[name])
            found.append((places[first][0], places[last - 1][1], name, self.saved(text[places[begin][0] : places[end - 1][1]], name), (want - missing) / want, missing, extra, not missing and not extra, changes))
        return sorted(found)


def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return kept(("licenses", templates), lambda: Scanner(dict(templates)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each wording in a row's text that a template explains: ``id_col``, block, start, end, template, license, saved,
    coverage, missing_words, extra_words, exact, differences.

    Only texts with a cue word reach Python, and they are read whole, however long. Null and empty texts, and an empty table, give no
    rows; repeated rows repeat theirs; other columns, whatever their names, are not read.
    Of templates with as few differences the longer wording wins, then the name.
    """
    chosen = tuple(sorted((templates or TEMPLATES).items()))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").rlike(CUES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(chosen)
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for n, hit in enumerate(scanner.scan(text)):
                    at.append(k)
                    out.append((n, *hit))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", "block", "start", "end", "template", "saved", "coverage", "missing_words", "extra_words", "exact", "differences"])

    arrow_batches(docs.sparkSession)
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, block int, start long, end long, template string, saved double, coverage double, missing_words int, extra_words int, exact boolean, differences string")
    return found.withColumn("license", F.split_part("template", F.lit("/"), F.lit(1))).withColumnRenamed("id", id_col)
