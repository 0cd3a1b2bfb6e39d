"""Token counts from a compiled finite-state transducer, without building tokens.

BPE is compiled to a deterministic transducer over the bytes of a word. After each prefix exactly
one token can stand last: the one that forms a valid pair with the token that stood last before
it. So a state needs only, for each start that some token can still grow from, the place in the
token trie, the token that stood last there and the count there relative to now. A transition
carries the change of the token count; the last byte of a word reads the end-of-word alphabet.
States and transitions are made when first met and the first `MOST_STATES` are kept, so the cost of
a known word is one lookup a byte; what lies beyond them is worked out each time.

Every text is read in chunks of `CHUNK` code points, cut anywhere. A chunk is a map from the
transducer state it is entered in to the state it is left in and the tokens emitted: its `head`
goes on with a word of the chunk before and is read from the entry state, the words that lie whole
in it emit a constant, and a word that goes on beyond it is read up to the edge. A chunk without an
edge of words has a head alone and maps every state to where its bytes lead. Maps compose
(`ChunkMap.then`), and a parallel prefix scan, log n levels deep, gives the state and count at every
chunk's end; a map remembers what it did to a state, so each chunk's bytes are read once.

Defined results: null text counts as empty: no bytes, no tokens, not over the limit; repeated rows
are counted each on its own; special strings in a text count as one token, the library's default;
texts and words of any length are read in bounded slices; a column that bears the new name is
replaced, as `withColumn` does.
"""

from __future__ import annotations

import json
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import add_columns, table
from .wordstream import Memo, Pretokenizer, Words, byte_letters, slices

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: States, and decisions on pairs, that are kept; beyond them transitions are worked out as they are met. Bounds a worker's memory.
MOST_STATES, MOST_PAIRS = 50_000, 200_000
CHUNK = 1 << 12
_END, _NONE = 256, -1
#: A state: for each start a token can grow from, its place in the trie, the token before it and the count there.
State = tuple[tuple[int, int, int], ...]
START: State = ((0, _NONE, 0),)


class Transducer:
    """Counts the tokens of a word's bytes by transitions; compiled as words come."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, letters = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(suffix) and token != suffix
            own = [letters[c] for c in (token[: -len(suffix)] if last else token)]
            return (*own[:-1], own[-1] + _END) if last else tuple(own)

        self.text = {i: symbols(t) for t, i in model["vocab"].items() if all(c in letters for c in t.removesuffix(suffix))}
        vocab = model["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        #: How a token is made and when; made in two ways, whole words decide on pairs instead.
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in self.merge.items()}
        self.one_way = len(self.made) == len(self.merge)
        self.base = {s[0]: i for i, s in self.text.items() if len(s) == 1}
        self.trie: dict[int, int] = {}
        self.token, self.inner = [_NONE], [False]
        for i, s in self.text.items():
            node = 0
            for x in s:
                after = self.trie.get(node << 9 | x)
                if after is None:
                    after = self.trie[node << 9 | x] = len(self.token)
                    self.token.append(_NONE)
                    self.inner.append(False)
                    self.inner[node] = True
                node = after
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.items = [START]
        self.number = {START: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain BPE of a symbol string, to decide on pairs."""
        own = [self.base[x] for x in symbols]
        while len(own) > 1:
            best = min(((self.merge.get((own[i], own[i + 1]), (1 << 30, 0)), i) for i in range(len(own) - 1)), key=lambda x: (x[0][0], x[1]))
            (rank, new), at = best
            if rank == 1 << 30:
                break
            own[at : at + 2] = [new]
        return own

    def valid(self, before: int, token: int) -> bool:
        """Whether BPE leaves the two tokens (or the one, after nothing) as they are."""
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            alone = () if before == _NONE else self.text[before]
            want = [token] if before == _NONE else [before, token]
            decide = self._apart(before, token) if before != _NONE and self.one_way else self.merged(alone + self.text[token]) == want
            known = decide
            if len(self.pairs) < MOST_PAIRS:
                self.pairs[key] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before one that makes the two tokens, seen by undoing their last merges in turn."""
        limit, base = 1 << 62, (-1, 0, 0)
        while True:
            across = self.merge.get((a, b))
            if across is not None and across[0] < limit:
                return False
            left, right = self.made.get(a, base), self.made.get(b, base)
            if left[0] > right[0]:
                limit, a = left[0], left[2]
            elif right[0] >= 0:
                limit, b = right[0] + 1, right[1]  # the same merge further left comes first
            else:
                return True

    def _stand(self, state: State, symbol: int) -> tuple[list, int, int]:
        """After a symbol: what can still grow, the token that stands last, and the tokens emitted."""
        grown, last, emitted = [], _NONE, 0
        for node, before, count in state:
            after = self.trie.get(node << 9 | symbol)
            if after is None:
                continue
            if self.inner[after]:
                grown.append((after, before, count))
            token = self.token[after]
            if last == _NONE and token != _NONE and self.valid(_NONE, token) and (before == _NONE or self.valid(before, token)):
                last, emitted = token, count + 1
        if last == _NONE:
            raise ValueError("no token can stand last here")
        return grown, last, emitted

    def _open(self, state: State, symbol: int) -> tuple[State, int]:
        """The state after a byte that doesn't end the word, and the tokens emitted."""
        grown, last, emitted = self._stand(state, symbol)
        return (*((node, before, count - emitted) for node, before, count in grown), (0, last, 0)), emitted

    def _room(self) -> bool:
        return len(self.items) < MOST_STATES and len(self.step) < 4 * MOST_STATES

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Work out a transition of a numbered state and keep it."""
        if symbol >= _END:
            at, emitted = 0, self._stand(self.items[state], symbol)[2]
        else:
            after, emitted = self._open(self.items[state], symbol)
            at = self.number.get(after)
            if at is None:
                at = self.number[after] = len(self.items)
                self.items.append(after)
        self.step[state << 9 | symbol] = (at, emitted)
        return at, emitted

    def _next(self, at: int, state: State, symbol: int) -> tuple[int, State, int]:
        """(number, state, emitted) after a byte within a word; the number is -1 for a state that is not kept."""
        if at >= 0:
            found = self.step.get(at << 9 | symbol) or (self._compile(at, symbol) if self._room() else None)
            if found:
                return found[0], self.items[found[0]], found[1]
        after, emitted = self._open(state, symbol)
        return self.number.get(after, -1), after, emitted

    def run(self, state: State, data: bytes, closes: bool) -> tuple[State, int]:
        """The state that bytes of a word lead to and the tokens emitted; the last byte ends the word if it `closes`."""
        total, at = 0, self.number.get(state, -1)
        for x in data[:-1] if closes else data:
            at, state, n = self._next(at, state, x)
            total += n
        if not closes:
            return state, total
        return START, total + self._stand(state, data[-1] + _END)[2]

    def ids(self, word: bytes) -> np.ndarray:
        """The tokens of one word, from the tokens that stand last after each of its bytes."""
        last, at, state = np.zeros(len(word), np.int64), 0, START
        for i, x in enumerate(word[:-1]):
            at, state, _ = self._next(at, state, x)
            last[i] = state[-1][1]
        last[-1] = self._stand(state, word[-1] + _END)[1]
        out, at = np.zeros(len(word), np.int64), len(word)
        n = 0
        while at > 0:
            out[n] = last[at - 1]
            at -= len(self.text[int(out[n])])
            n += 1
        return out[:n][::-1]

    def count(self, word: str) -> int:
        """The number of tokens of one short word."""
        own, step = word.encode("utf-8", "surrogatepass"), self.step
        at = total = 0
        for i, x in enumerate(own[:-1]):
            found = step.get(at << 9 | x)
            if found is None:
                if not self._room():
                    return total + self.run(self.items[at], own[i:], True)[1]
                found = self._compile(at, x)
            at = found[0]
            total += found[1]
        x = own[-1] + _END
        found = step.get(at << 9 | x)
        if found is None:
            found = self._compile(at, x) if self._room() else (0, self._stand(self.items[at], x)[2])
        return total + found[1]


class ChunkMap:
    """From the state a chunk is entered in to the state it is left in and the tokens emitted on the way.

    `closes` tells whether the chunk holds an edge of words: then it is left in `tail` whatever the
    entry state, and `count` tokens come beside those of its head. A composed map has a `first`
    map, and an `after` map unless first closes.
    """

    def __init__(self, fst: Transducer, head: bytes = b"", closes: bool = True, count: int = 0, tail: State = START, first: ChunkMap | None = None, after: ChunkMap | None = None):
        self.fst, self.head, self.closes, self.count, self.tail, self.first, self.after = fst, head, closes, count, tail, first, after
        self.known: dict[State, tuple[State, int]] = {}

    def __call__(self, state: State) -> tuple[State, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self._read(state)
        return found

    def _read(self, state: State) -> tuple[State, int]:
        if self.first is None:
            left, n = self.fst.run(state, self.head, self.closes) if self.head else (state, 0)
        else:
            left, n = self.first(state)
            if self.after is not None:
                left, more = self.after(left)
                n += more
        return (self.tail, n + self.count) if self.closes else (left, n)

    def then(self, after: ChunkMap) -> ChunkMap:
        """This chunk and the one after it as one map."""
        if self.closes:  # what follows starts in a known state
            tail, count = after(self.tail)
            return ChunkMap(self.fst, closes=True, count=count, tail=tail, first=self)
        return ChunkMap(self.fst, closes=after.closes, tail=after.tail, first=self, after=after)


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """For each chunk the map of all chunks up to it: pairs are combined, scanned, and filled in between."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([a.then(b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else pairs[i // 2 - 1].then(maps[i]))
    return out


class Counter:
    """Token counts of whole texts for one tokenizer file."""

    _made: dict[tuple[str, int], Counter] = {}

    @classmethod
    def shared(cls, path: str, chunk: int = CHUNK) -> Counter:
        if (path, chunk) not in cls._made:
            cls._made[path, chunk] = cls(path, chunk)
        return cls._made[path, chunk]

    def __init__(self, path: str, chunk: int = CHUNK):
        self.pre, self.fst, self.chunk = Pretokenizer(path), Transducer(path), chunk
        self.memo = Memo(lambda words: np.fromiter(map(self.fst.count, words), np.int64, len(words)), bits=21)

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of whole texts: special strings, and the scans of the parts between them."""
        counts, parts, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if "<|" in text:
                counts[i] += len(self.pre.special_at.findall(text))
                pieces = self.pre.special_at.split(text)
            for piece in pieces:
                if piece:
                    parts.append(self.pre.plain(piece))
                    owner.append(i)
        maps: list[list[ChunkMap]] = [[] for _ in parts]
        for points, pieces in slices(parts):
            for k, made in self._maps(self.pre.words(points), pieces):
                maps[k].append(made)
        for i, own in zip(owner, maps, strict=True):
            counts[i] += prefix_scan(own)[-1](START)[1]
        return counts

    def _maps(self, words: Words, pieces: list[tuple[int, int, int]]):
        """(part, map) of each chunk in a slice."""
        cuts = [(k, p, min(p + self.chunk, b)) for k, a, b in pieces for p in range(a, b, self.chunk)]
        start, stop = np.array([c[1] for c in cuts]), np.array([c[2] for c in cuts])
        edges = np.append(words.edges, len(words.low) + 1)
        first = edges[np.searchsorted(edges, start)]  # the first edge of words in or after the chunk
        low, high = np.searchsorted(words.begin, first), np.searchsorted(words.end, stop, "right")
        high = np.maximum(low, high)  # the words that lie whole in the chunk
        whole = np.repeat(low, high - low) + _count_up(high - low)
        emitted = np.zeros(len(words.begin) + 1, np.int64)
        if len(whole):
            begin, end = words.begin[whole], words.end[whole]
            emitted[whole + 1] = self.memo.get(words, begin, end, self.pre.hashes(words.low, begin, end))
        emitted = np.cumsum(emitted)
        whole_count = (emitted[high] - emitted[low]).tolist()
        beyond = np.append(words.begin, len(words.low) + 1)[high]  # where a word starts that goes on beyond
        rows = zip(cuts, first.tolist(), whole_count, beyond.tolist(), strict=True)
        for (k, p, q), f, count, tail_at in rows:
            head = words.text(p, min(f, q)).encode("utf-8", "surrogatepass") if f > p else b""
            tail, n = START, 0
            if f <= tail_at < q:
                tail, n = self.fst.run(START, words.text(tail_at, q).encode("utf-8", "surrogatepass"), False)
            yield k, ChunkMap(self.fst, head, f <= q, count + n, tail)


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of many sizes in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def token_counts(docs: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Add the token count of a text column to a table; all its other columns stay."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def count(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(Counter.shared(path, chunk).counts([t or "" for t in texts]), pa.int64())]

    return add_columns(docs, text, {name: LongType()}, count)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = token_counts(docs.select("doc_id", n_bytes, "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
