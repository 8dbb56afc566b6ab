"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Text is cut where no merge can reach across (before white space or punctuation that follows a word), so a chunk of any text can be
encoded alone. Inside a chunk the vocabulary's pattern gives pieces, and each piece, short or long, is fed to the
transducer (``transduce``): it reads a window, merges it, and emits the tokens that end at least ``lookahead`` bytes before the
window's end, or all of them where the piece ends. The next window starts at the last stable boundary, so memory stays
constant. Tokens go on in parts, to digests that run along.

The lookahead is computed from the merge list. What is still unknown at the right moves left only through a merge
(u, v) whose right part begins where an earlier, influenced merge began: u of the earlier one is on the left spine
of v. Chains of rising rank give the longest way, plus the longest token for the one that crosses the end.

Pieces met lately are kept with the tokens that the transducer gave, as arcs that have been built; pieces not met are
fed to it many at a time: short ones in lockstep, over flat arrays, windows of long ones each with a heap of its pairs.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import regex

#: Fixed values. Code points that became letters or numbers after the Unicode tables of the tokenizers library;
#: there they count as other signs.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)

CHUNK = 1 << 16
WINDOW = 4096
ARCS = 1 << 17
ARC_CHARS = 1024
#: Windows beyond this many bytes are merged by a heap: rounds over flat arrays would grow with the square of their length.
LOCKSTEP = 128
_NEWER = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
_ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(_ASCII_PIECES)
_HAS_NEWER = regex.compile(f"[{_NEWER}]")
_EXACT_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_NEWER}]]+| ?[\p{{N}}--[{_NEWER}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{_NEWER}]]+|\s+(?!\S)|\s+", regex.V1)
#: Places that no piece goes across: white space after a word or an ASCII sign, punctuation after a word. Left out are the apostrophe, which begins
#: pieces of its own kind, signs that strings of special tokens are made of, and what the library's tables take for other signs.
SAFE = regex.compile(rf"(?<=[!-~\p{{L}}\p{{N}}])(?=[ \n])|(?<=[[\p{{L}}\p{{N}}]--[{_NEWER}]])(?=[[\p{{P}}--[\x00-\x7F]]||[!\"#$%\&()*+,\-./:;=?@{{}}]])", regex.V1)
_NONE = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary and its merge list, read from a tokenizer file; special tokens of the file are met as whole tokens."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        signs = byte_alphabet()
        to_bytes = lambda t: bytes(map(signs.__getitem__, t))
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in signs for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.text = [b""] * size
        for t, i in [*vocab.items(), *((k.encode(), i) for k, i in self.special.items())]:
            self.text[i] = t
        self.single = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        sides = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in sides], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = np.append(keys[order], np.int64(1) << 62), np.append(order, _NONE)
        self._merged = np.array([vocab[a + b] for a, b in sides], np.int64)
        self._rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.lookahead = self._lookahead(sides)
        self.window = max(WINDOW, 4 * self.lookahead)
        self.arcs: dict[str, bytes] = {}

    @staticmethod
    def _lookahead(sides: list[tuple[bytes, bytes]]) -> int:
        left = {a + b: a for a, b in reversed(sides)}
        reach: dict[bytes, int] = {}
        most = 0
        for a, b in sides:
            spine, far = b, 0
            while spine:
                far = max(far, reach.get(spine, 0))
                spine = left.get(spine, b"")
            far += len(a)
            reach[a] = max(reach.get(a, 0), far)
            most = max(most, far)
        return most + max(len(a + b) for a, b in sides)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of each piece, all merged in lockstep: each round, every piece applies its lowest-ranked pair once."""
        out: list[list[int]] = [[] for _ in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        names = np.flatnonzero(sizes)
        tok = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        sizes = sizes[names]
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(tok), _NONE, np.int64)  # of a token with the one at its right in the same piece
        if len(tok) > 1:
            rank[:-1] = self._rank(tok[:-1], tok[1:])
        if len(tok):
            rank[starts + sizes - 1] = _NONE
        while len(names):
            least = np.minimum.reduceat(rank, starts)
            live = least < _NONE
            if not live.all():
                for k in np.flatnonzero(~live):
                    out[names[k]] = tok[starts[k] : starts[k] + sizes[k]].tolist()
                keep = np.repeat(live, sizes)
                tok, rank, names, sizes, least = tok[keep], rank[keep], names[live], sizes[live], least[live]
                starts = np.cumsum(sizes) - sizes
                if not len(names):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            piece = np.searchsorted(starts, at, "right") - 1
            at = at[np.concatenate(([True], piece[1:] != piece[:-1]))]  # the leftmost of each piece
            tok[at] = self._merged[least]
            gone = at + 1
            last = gone == starts + sizes - 1
            rank[at] = np.where(last, _NONE, self._rank(tok[at], tok[np.minimum(gone + 1, len(tok) - 1)]))
            inner = at > starts
            rank[at[inner] - 1] = self._rank(tok[at[inner] - 1], tok[at[inner]])
            keep = np.ones(len(tok), bool)
            keep[gone] = False
            tok, rank, sizes = tok[keep], rank[keep], sizes - 1
            starts = np.cumsum(sizes) - sizes
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The tokens of one long piece: its pairs in a heap by rank and place, the tokens as a linked list, so that each merge costs a step of the heap."""
        first = self.single[np.frombuffer(piece, np.uint8)]
        tok, n, rank_of, merged = first.tolist(), len(first), self._rank_of, self._merged
        rank = [*self._rank(first[:-1], first[1:]).tolist(), _NONE]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(rank) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 32)
            if rank[i] != r:  # a neighbour's merge came first
                continue
            gone = after[i]
            tok[i], tok[gone], rank[gone] = int(merged[r]), -1, _NONE
            right = after[i] = after[gone]
            if right < n:
                before[right] = i
                rank[i] = rank_of.get(tok[i] << 32 | tok[right], _NONE)
                if rank[i] < _NONE:
                    heapq.heappush(heap, rank[i] << 32 | i)
            else:
                rank[i] = _NONE
            left = before[i]
            if left >= 0:
                rank[left] = rank_of.get(tok[left] << 32 | tok[i], _NONE)
                if rank[left] < _NONE:
                    heapq.heappush(heap, rank[left] << 32 | left)
        return [t for t in tok if t >= 0]

    def _merged_each(self, buffers: list[bytes]) -> list[list[int]]:
        short = iter(self.merge([b for b in buffers if len(b) <= LOCKSTEP]))
        return [next(short) if len(b) <= LOCKSTEP else self.merge_long(b) for b in buffers]

    def transduce(self, pieces: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """The machine: (piece, tokens) in parts as they become stable, each piece's in order, all pieces fed together.

        A piece is read by windows. A window that ends it gives all its tokens; else those that end ``lookahead`` before the window's end
        are emitted, as no later byte can change them, and the next window starts behind them.
        """
        live = [(k, 0) for k in range(len(pieces))]
        while live:
            buffers, later = [pieces[k][at : at + self.window] for k, at in live], []
            for (k, at), buffer, tokens in zip(live, buffers, self._merged_each(buffers)):
                if at + len(buffer) < len(pieces[k]):
                    end, stable = 0, 0
                    while end + len(self.text[tokens[stable]]) <= len(buffer) - self.lookahead:
                        end += len(self.text[tokens[stable]])
                        stable += 1
                    later.append((k, at + end))
                    tokens = tokens[:stable]
                yield k, tokens
            live = later

    def _build(self, pieces: set[str]) -> None:
        """Arcs of the pieces that have none: the machine's tokens, kept as 32-bit numbers. Those beyond ``ARC_CHARS`` are not kept but emitted each time."""
        new = sorted(p for p in pieces.difference(self.arcs) if len(p) <= ARC_CHARS)
        found: list[list[int]] = [[] for _ in new]
        for k, tokens in self.transduce([p.encode() for p in new]):
            found[k] += tokens
        self.arcs.update((p, array("i", tokens).tobytes()) for p, tokens in zip(new, found))

    def pieces(self, chunk: str) -> list[str]:
        return (_EXACT_PIECES if not chunk.isascii() and _HAS_NEWER.search(chunk) else _PIECES).findall(chunk)

    def encode_many(self, chunks: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(chunk, tokens) in order and in parts. Chunks hold no special token and end where no piece is cut."""
        cut = [self.pieces(c) for c in chunks]
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        self._build(set().union(*cut) if cut else set())
        arcs = self.arcs
        for k, pieces in enumerate(cut):
            try:
                yield k, np.frombuffer(b"".join(map(arcs.__getitem__, pieces)), np.int32)
            except KeyError:  # a long piece is among them
                for p in pieces:
                    if p in arcs:
                        yield k, np.frombuffer(arcs[p], np.int32)
                    else:
                        yield from ((k, np.array(t, np.int32)) for _, t in self.transduce([p.encode()]))

    def chunks(self, text: str) -> Iterator[str | int]:
        """The text in order: special tokens as ids, the rest in chunks of about ``CHUNK`` that end at safe boundaries."""
        at = 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            end = m.start() if m else len(text)
            while at < end:
                to = min(at + CHUNK, end)
                if to < end:
                    safe = SAFE.search(text, to, end)
                    to = safe.start() if safe else end
                yield text[at:to]
                at = to
            if m:
                yield self.special[m.group()]
                at = m.end()


class Encoder:
    """Encodes texts as one stream each; ``texts`` of a batch share the work on pieces not met before."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe

    def parts(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, tokens) in order and in parts; what is read ahead is bounded by ``16 * CHUNK`` characters and one chunk."""
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            for k, ids in self.bpe.encode_many([c for _, c in held]):
                yield held[k][0], ids
            held.clear()

        for k, text in enumerate(texts):
            for c in self.bpe.chunks(text):
                if isinstance(c, int):
                    yield from flush()
                    yield k, np.array([c], np.int32)
                    size = 0
                    continue
                held.append((k, c))
                size += len(c)
                if size > 16 * CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """One list for each text, in order."""
        out: list[list[int]] = [[] for _ in texts]
        for k, ids in self.parts(texts):
            out[k] += ids.tolist()
        return out


class Decoder:
    """Tokens to text, a block at a time: bytes that do not end a sign wait for the next block."""

    def __init__(self, bpe: ByteBpe) -> None:
        self._text, self._state = bpe.text, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int], final: bool = False) -> str:
        return self._state.decode(b"".join(map(self._text.__getitem__, ids)), final)


class Digests:
    """Running digests of a text's tokens: of the decimal ids joined by commas, and of the decoded text in UTF-8."""

    def __init__(self, bpe: ByteBpe, names: list[str]) -> None:
        self._names, self._decoder = names, Decoder(bpe)
        self.n, self._ids, self._decoded = 0, hashlib.sha256(), hashlib.sha256()

    def push(self, found: np.ndarray) -> None:
        if ids := found.tolist():
            self._ids.update((("," if self.n else "") + ",".join(map(self._names.__getitem__, ids))).encode())
            self._decoded.update(self._decoder.push(ids).encode())
            self.n += len(ids)

    def close(self) -> tuple[int, str, str]:
        self._decoded.update(self._decoder.push([], final=True).encode())
        return self.n, self._ids.hexdigest(), self._decoded.hexdigest()
