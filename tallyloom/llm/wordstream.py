"""Pre-tokens of many texts at once, as arrays, for a word-level BPE tokenizer file.

Character classes and lower case come from the tokenizer's own normalizer and pre-tokenizer, asked
once for each code point that occurs, so the arrays agree with the library. Where a word starts
depends on `AROUND` code points at most, so texts of any length are read in slices of `SLICE` code
points with that much context. A memo of fixed size turns a word into its value (a token count,
token ids): a 64-bit hash finds its place and the code points themselves are compared, so two words
never share a value; only words that the memo lacks are worked out one by one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

SPACE, LETTER, DIGIT, OTHER, ODD = 1, 2, 3, 4, 255
#: Code points flattened at once; bounds a worker's memory whatever the texts' lengths.
SLICE = 1 << 18
#: Code points on either side that decide whether a word starts (two behind a contraction, two before).
AROUND = 8
#: Words that the memo keeps have at most so many code points.
LONGEST = 256
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Pretokenizer:
    """Classes, lower case and word boundaries of a tokenizer file (kind: words with an end mark)."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in json.loads(self.tok.to_str())["added_tokens"]}
        self.special_at = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.kind = np.zeros(0x110000, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        mixed = np.arange(1, 0x110001, dtype=np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(by)
        self.mixed = mixed
        n = SLICE + 4 * AROUND
        self.power, self.inverse = self._powers(_MULTIPLIER, n), self._powers(pow(_MULTIPLIER, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base & (2**64 - 1), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _learn(self, points: np.ndarray) -> None:
        pre, norm = self.tok.pre_tokenizer.pre_tokenize_str, self.tok.normalizer.normalize_str
        for p in points.tolist():
            made = norm(chr(p))
            if len(made) != 1:
                self.kind[p] = ODD
                continue
            self.lower[p] = ord(made)
            pieces = len(pre(made + made))
            self.kind[p] = SPACE if pieces == 0 else DIGIT if pieces == 2 else LETTER if len(pre("a" + made)) == 1 else OTHER

    def plain(self, text: str) -> str:
        """The text, normalised by the library where an array lookup for each code point would not do."""
        if len(text) <= SLICE:
            return self._plain(text)
        out, at = [], 0
        while len(text) - at > SLICE:
            found = _STARTER.search(text, at + SLICE)
            if not found:
                break
            out.append(self._plain(text[at : found.start()]))
            at = found.start()
        return "".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> str:
        if text.isascii() or unicodedata.is_normalized("NFC", text):
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            kinds = self.kind[points]
            if not kinds.all():
                self._learn(np.unique(points[kinds == 0]))
                kinds = self.kind[points]
            if text.isascii() or not (kinds == ODD).any():
                return text
        text = self.tok.normalizer.normalize_str(text)
        points = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        self._learn(points[self.kind[points] == 0])
        # what the library has made is final: a code point that it would change again is kept as it is
        for p in points[self.kind[points] == ODD].tolist():
            self.kind[p] = LETTER if len(self.tok.pre_tokenizer.pre_tokenize_str("a" + chr(p))) == 1 else OTHER
        return text

    def marks(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and lower case of code points of texts made by `plain`, and whether a word starts there."""
        kind, low = self.kind[points], self.lower[points]
        if not kind.all():
            self._learn(np.unique(points[kind == 0]))
            kind, low = self.kind[points], self.lower[points]
        start = np.empty(len(kind), bool)
        start[:1] = kind[:1] != SPACE
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == DIGIT
        start &= kind != SPACE
        tick = np.flatnonzero((low[:-3] == 39) & start[:-3])
        if len(tick):  # 's 't 'm 'd and 're 've 'll are words of their own
            a, b = low[tick + 1], low[tick + 2]
            short = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
            long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for at, n in ((tick[short], 2), (tick[long], 3)):
                start[at + 1] = False
                after = at + n
                start[after] |= kind[after] == LETTER
        return kind, low, start

    def words(self, points: np.ndarray) -> Words:
        """The words of code points that end in blanks or in context that is not asked for."""
        kind, low, start = self.marks(points)
        edges = np.flatnonzero(start | (kind == SPACE))
        own = np.flatnonzero(start[edges])
        return Words(low, edges, edges[own], np.append(edges, len(points))[own + 1])

    def hashes(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit polynomial hashes of words within a slice."""
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(self.mixed[low] * self.power[: len(low)], out=total[1:])
        return ((total[end] - total[begin]) * self.inverse[begin]) ^ (end - begin).astype(np.uint64)

    def _edge(self, text: str, first: int, stop: int, last: bool) -> int:
        """The last, or first, place in [first, stop) where a word starts or a blank stands; -1 if none."""
        left = max(0, first - AROUND)
        kind, _, start = self.marks(_points(text[left : stop + AROUND] + " " * AROUND))
        found = np.flatnonzero((start | (kind == SPACE))[first - left : stop - left])
        return first + int(found[-1 if last else 0]) if len(found) else -1

    def cut(self, text: str, size: int = SLICE) -> Iterator[tuple[str, bool]]:
        """A text in pieces of at most `size`, cut where words start; a longer word is a piece by itself (True)."""
        at = 0
        while len(text) - at > size:
            cut = self._edge(text, at + 1, at + size + 1, True)
            if cut >= 0:
                yield text[at:cut], False
            else:
                cut = at + size + 1
                while cut < len(text):
                    found = self._edge(text, cut, min(cut + size, len(text)), False)
                    if found >= 0:
                        cut = found
                        break
                    cut = min(cut + size, len(text))
                yield text[at:cut], True
            at = cut
        yield text[at:], False


#: Code points that no normalization joins with what stands before them.
_STARTER = re.compile("[\x00-\x7f\u0400-\u0482\u3041-\u3096\u30a1-\u30fa\u3400-\u9fff]")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Words(NamedTuple):
    """Lower-cased code points, where words start or blanks stand, and each word's begin and end."""

    low: np.ndarray
    edges: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def text(self, a: int, b: int) -> str:
        return self.low[a:b].tobytes().decode("utf-32-le")


class Slice(NamedTuple):
    """Code points with context on both sides, and (part, first, stop) of what is to be read there."""

    points: np.ndarray
    pieces: list[tuple[int, int, int]]


def slices(parts: list[str], size: int = SLICE) -> Iterator[Slice]:
    """Short parts together, long ones window by window; at most `size` code points at once."""
    pad, run, n = " " * AROUND, [], 0

    def joined() -> Slice:
        stop = AROUND + np.cumsum([len(parts[k]) + 1 for k in run])
        return Slice(_points(pad + "\n".join(parts[k] for k in run) + pad), [(k, s - len(parts[k]) - 1, s - 1) for k, s in zip(run, stop.tolist(), strict=True)])

    for k, part in enumerate(parts):
        if run and n + len(part) + 1 > size:
            yield joined()
            run, n = [], 0
        if len(part) < size:
            run.append(k)
            n += len(part) + 1
            continue
        for a in range(0, len(part), size):
            b = min(a + size, len(part))
            left = part[max(0, a - AROUND) : a]
            yield Slice(_points(pad[len(left) :] + left + part[a:b] + part[b : b + AROUND] + pad), [(k, AROUND, AROUND + b - a)])
    if run:
        yield joined()


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[at : at + n] equals b[bt : bt + n], for each of many runs (none empty)."""
    base = np.cumsum(n) - n
    i = np.arange(int(n.sum()))
    bad = np.flatnonzero(a[i + np.repeat(at - base, n)] != b[i + np.repeat(bt - base, n)])
    out = np.ones(len(n), bool)
    out[np.searchsorted(base, bad, "right") - 1] = False
    return out


class Memo:
    """A direct-mapped table from word to value, of fixed size; `work_out` gives what it lacks."""

    #: Code points of words kept before the table is started anew.
    MOST_POINTS = 8 << 20

    def __init__(self, work_out: Callable[[list[str]], np.ndarray], bits: int = 19):
        self.bits, self.work_out = bits, work_out
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.sizes, self.places = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.points, self.used = np.empty(self.MOST_POINTS + (1 << 20), np.uint32), 0

    def clear(self) -> None:
        self.sizes[:] = 0  # no word has size 0
        self.used = 0

    def get(self, words: Words, begin: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The value of each word [begin, end); the words themselves are compared, not only their hashes."""
        if self.used > self.MOST_POINTS:
            self.clear()
        slot = ((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)
        n = end - begin
        out, hit = self.values[slot], (self.keys[slot] == hashed) & (self.sizes[slot] == n)
        at = np.flatnonzero(hit)
        if len(at):
            hit[at] = _same(words.low, begin[at], self.points, self.places[slot[at]].astype(np.int64), n[at])
        lacking = np.flatnonzero(~hit)
        if len(lacking):
            number: dict[str, int] = {}
            back = [number.setdefault(words.text(a, b), len(number)) for a, b in zip(begin[lacking].tolist(), end[lacking].tolist(), strict=True)]
            new = self.work_out(list(number))
            out[lacking] = new[back]
            self._keep(words.low, lacking[np.unique(back, return_index=True)[1]], begin, n, slot, hashed, out)
        return out

    def _keep(self, low: np.ndarray, some: np.ndarray, begin: np.ndarray, n: np.ndarray, slot: np.ndarray, hashed: np.ndarray, out: np.ndarray) -> None:
        some = some[n[some] <= LONGEST]
        size = n[some]
        base = np.cumsum(size) - size
        total = int(size.sum())
        if self.used + total > len(self.points):
            return
        self.points[self.used : self.used + total] = low[np.arange(total) + np.repeat(begin[some] - base, size)]
        at = slot[some]
        self.keys[at], self.values[at], self.sizes[at], self.places[at] = hashed[some], out[some], size, self.used + base
        self.used += total
