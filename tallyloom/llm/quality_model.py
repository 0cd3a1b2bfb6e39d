"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded twice: by its surface
(character classes, word lengths, repetition) and by its words, the mean of learned embeddings of
hashed words and word pairs. A small layer embeds both; gated attention, tanh(Vh) * sigmoid(Uh),
gives each passage a weight within its document; the weighted sum of the embeddings is the
document's representation, and its logistic score says how likely label 1 is. All weights are
learned from document labels alone, on a bounded sample of labelled rows (`TRAIN_ROWS`, and fewer
where their texts have more than `TRAIN_CHARS` characters in all; chosen by a hash of the id, each
with its whole text); every document is scored on all its passages.

Defined results: null or empty text is a bag of one blank passage and gets a score like any other;
repeated rows are scored each on its own; without any labelled row every score is 0.5; a null
doc_id is not held out and never learned from; of rows that share a labelled doc_id, one is learned
from (the least by its text's hash); a doc_id of any type will do. Long texts are encoded in slices
of about `SLICE` bytes, so memory grows with their passages alone. A column that bears the new name
is replaced, as `withColumn` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._common import add_columns, small_batches, table

PASSAGE = 64
#: Labelled rows that the model is fitted on at most, in expectation, and characters in all of them.
TRAIN_ROWS, TRAIN_CHARS = 6000, 24_000_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, SEED = 32, 16, 12, 64, 0.01, 7
#: Batches that are learned from at least, however few rows there are.
STEPS = 150
#: Passages that are seen in all, beyond which few rows are not learned from more often.
MOST_SEEN = 200_000
#: Hash buckets of words and word pairs, and the length of their embeddings.
BUCKETS, LEXICAL = 1 << 12, 8
#: Bytes of texts that are encoded at once.
SLICE = 1 << 20

_SIGNS = b"#*$%&|<>!?.,;:'\"()[]{}/\\_-+=@~^`"
_BLANK, _LOWER, _VOWEL, _UPPER, _DIGIT, _HIGH, _REST = range(7)
CLASSES = 7 + len(_SIGNS)


def _classes() -> np.ndarray:
    out = np.full(256, _REST, np.uint8)
    out[list(b" \t\n\x0b\x0c\r")] = _BLANK
    out[ord("a") : ord("z") + 1] = _LOWER
    out[list(b"aeiou")] = _VOWEL
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[128:] = _HIGH
    for i, c in enumerate(_SIGNS):
        out[c] = 7 + i
    return out


_CLASS = _classes()
FEATURES = CLASSES + 8


class Bags(NamedTuple):
    """Encoded passages: surface features, passages of each text, buckets of their words and pairs, and how many each has."""

    x: np.ndarray
    bags: np.ndarray
    terms: np.ndarray
    sizes: np.ndarray

    def of(self, rows: np.ndarray) -> Bags:
        """The bags of some texts, in that order."""
        first = np.cumsum(self.bags) - self.bags
        passages = _ranges(first[rows], self.bags[rows])
        at = np.cumsum(self.sizes) - self.sizes
        return Bags(self.x[passages], self.bags[rows], self.terms[_ranges(at[passages], self.sizes[passages])], self.sizes[passages])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of many runs in turn."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


def joined(parts: list[Bags]) -> Bags:
    return Bags(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def encode(texts: list[str | None], size: int = SLICE) -> Bags:
    """The encoded passages of many texts."""
    out, run, n = [], [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > size:
            if run:
                out.append(_encode(run))
            parts = [_encode([part]) for part in _pieces(raw, size)]
            whole = joined(parts)
            out.append(whole._replace(bags=np.array([whole.bags.sum()])))
            run, n = [], 0
            continue
        run.append(raw)
        n += len(raw)
        if n > size:
            out.append(_encode(run))
            run, n = [], 0
    if run or not out:
        out.append(_encode(run))
    return joined(out)


def _pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of whole passages, all but the last; a piece grows until it holds one."""
    at, want = 0, size
    while len(raw) - at > want:
        kind = _CLASS[np.frombuffer(raw, np.uint8, want, at)] != _BLANK
        kind[1:] &= ~kind[:-1].copy()
        begin = np.flatnonzero(kind)
        whole = (len(begin) - 1) // PASSAGE * PASSAGE
        if whole > 0:
            cut = at + int(begin[whole])
            yield raw[at:cut]
            at, want = cut, size
        else:
            want *= 2
    yield raw[at:]


def _encode(raw: list[bytes]) -> Bags:
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    kind = _CLASS[data]
    solid = kind != _BLANK
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    begin = np.flatnonzero(start)
    stop = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1  # the text ends with a blank
    first = np.searchsorted(begin, ends - [len(r) + 1 for r in raw])
    words = np.diff(first, append=len(begin))
    bags = np.maximum(1, -(-words // PASSAGE))
    offset = np.cumsum(bags) - bags
    n = int(bags.sum())
    out = np.zeros((n, FEATURES), np.float32)
    if not len(begin):
        return Bags(out, bags, np.empty(0, np.uint16), np.zeros(n, np.int64))
    doc = np.repeat(np.arange(len(raw)), words)
    passage = offset[doc] + (np.arange(len(begin)) - first[doc]) // PASSAGE
    of_char = passage[np.cumsum(start)[solid] - 1]
    chars = np.bincount(of_char * CLASSES + kind[solid], minlength=n * CLASSES).reshape(n, CLASSES)
    size = stop - begin
    total = np.zeros(len(data) + 1, np.uint64)
    power = np.cumprod(np.full(len(data), 0x9E3779B97F4A7C15, np.uint64))
    np.cumsum((data.astype(np.uint64) + 1) * power, out=total[1:])
    hashed = (total[stop] - total[begin]) * _inverse(power[begin])
    count = np.bincount(passage, minlength=n)
    some, all_chars = np.maximum(count, 1), np.maximum(chars.sum(1), 1)
    order = np.lexsort((hashed, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=n)
    near = passage[1:] == passage[:-1]
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & near
    share = lambda mask: np.bincount(passage[mask], minlength=n) / some
    last = kind[stop - 1]
    out[:, :CLASSES] = chars / all_chars[:, None]
    out[:, CLASSES:] = np.stack(
        (
            np.log1p(count),
            chars.sum(1) / some,
            distinct / some,
            share(same),
            share(size <= 3),
            share(size >= 12),
            share(kind[begin] == _UPPER),
            share(last >= 7),
        ),
        1,
    )
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    pairs = ((hashed[:-1] * np.uint64(0xBF58476D1CE4E5B9) + hashed[1:]) * np.uint64(0x94D049BB133111EB) >> shift)[near]
    terms = np.concatenate(((hashed * np.uint64(0xD6E8FEB86659FD93) >> shift), pairs)).astype(np.uint16)
    of_term = np.concatenate((passage, passage[1:][near]))
    return Bags(out, bags, terms[np.argsort(of_term, kind="stable")], np.bincount(of_term, minlength=n))


def _inverse(x: np.ndarray) -> np.ndarray:
    """Inverses of odd numbers modulo 2^64, by Newton's steps."""
    out = x.copy()
    for _ in range(5):
        out *= np.uint64(2) - x * out
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean row of each of many runs of rows in turn; 0 for an empty run."""
    out = np.zeros((len(sizes), values.shape[1]), values.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        at = np.cumsum(sizes) - sizes
        out[some] = np.add.reduceat(values, at[some]) / sizes[some, None]
    return out


def _blocks(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[slice, slice]]:
    """Passages in runs with about `most` terms, and the terms of each run."""
    ends = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        before = int(ends[k] - sizes[k])
        stop = max(k + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(k, stop), slice(before, int(ends[stop - 1]))
        k = stop


class AttentionModel:
    """Gated-attention multiple-instance classifier; parameters are small arrays."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.spread = mean, spread
        self.p = {
            "E": rng.normal(0, 0.1, (BUCKETS, LEXICAL)),
            "W": draw(len(mean) + LEXICAL, HIDDEN),
            "b": np.zeros(HIDDEN),
            "V": draw(HIDDEN, ATTENTION),
            "U": draw(HIDDEN, ATTENTION),
            "w": draw(ATTENTION),
            "c": draw(HIDDEN),
            "d": np.zeros(1),
        }

    def _inputs(self, own: Bags) -> np.ndarray:
        lexical = np.empty((len(own.sizes), LEXICAL))
        for some, terms in _blocks(own.sizes):
            lexical[some] = _means(self.p["E"][own.terms[terms]], own.sizes[some])
        return np.concatenate(((own.x - self.mean) / self.spread, lexical), 1)

    def _forward(self, own: Bags) -> dict:
        p, bags, at = self.p, own.bags, np.cumsum(own.bags) - own.bags
        x = self._inputs(own)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        a = e / np.repeat(np.add.reduceat(e, at), bags)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "at": at, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, own: Bags) -> np.ndarray:
        return self._forward(own)["y"]

    def _gradients(self, own: Bags, label: np.ndarray) -> dict:
        p, bags, f = self.p, own.bags, self._forward(own)
        miss = (f["y"] - label) / len(label)
        dz = np.repeat(miss[:, None] * p["c"], bags, 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), bags))
        gate = de[:, None] * p["w"]
        dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dh *= f["h"] > 0
        lexical = (dh @ p["W"][-LEXICAL:].T) / np.maximum(own.sizes, 1)[:, None]
        words = np.zeros((BUCKETS, LEXICAL))
        for some, terms in _blocks(own.sizes):
            each = np.repeat(lexical[some], own.sizes[some], 0)
            words += np.stack([np.bincount(own.terms[terms], each[:, k], BUCKETS) for k in range(LEXICAL)], 1)
        return {"E": words, "W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ miss, "d": np.array([miss.sum()])}

    def fit(self, known: Bags, label: np.ndarray) -> AttentionModel:
        """Adam over shuffled batches of bags, a fixed number of epochs."""
        rng = np.random.default_rng(SEED)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        epochs = max(EPOCHS, min(-(-STEPS * BATCH // len(label)), MOST_SEEN // len(known.x)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(label))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                found, step = self._gradients(known.of(own), label[own]), step + 1
                for name, g in found.items():
                    g = g + 1e-4 * self.p[name] if self.p[name].ndim > 1 else g
                    m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> AttentionModel | None:
    """Fit on about `rows` labelled documents that are not held out, whole; None where there are none."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("__label"))
    dealt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    n = known.count()
    some = known.where(dealt < rows / max(n, 1))  # about `rows` rows, whatever the table holds
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    total = own.agg(F.sum(F.char_length("text"))).first()[0] or 0
    fewer = own.where(dealt < min(1.0, chars / max(total, 1)) * rows / max(n, 1))
    keyed = fewer.select(F.struct(F.col("doc_id").cast("string").alias("id"), "__label", F.xxhash64("text").alias("held")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = encode(batch.column(3).slice(k, 1).to_pylist())
                made = [own.x.astype("<f4"), own.terms.astype("<u2"), own.sizes.astype("<i8")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(k, 1) for i in range(3)), *(pa.array([c.tobytes()], pa.binary()) for c in made)], ["id", "label", "held", "x", "terms", "sizes"])

    # repeated rows of a document count once, so what reaches the driver is bounded by the sample
    encoded = keyed.select("key.*", "text").mapInArrow(run, "id string, label double, held long, x binary, terms binary, sizes binary")
    first = F.min_by(F.struct("x", "terms", "sizes"), F.coalesce("held", F.lit(0))).alias("own")
    got = sorted(encoded.groupBy("id", "label").agg(first).collect(), key=lambda r: (r["id"], r["label"]))
    if not got:
        return None
    parts = []
    for r in got:
        x = np.frombuffer(r["own"]["x"], "<f4").reshape(-1, FEATURES)
        parts.append(Bags(x, np.array([len(x)]), np.frombuffer(r["own"]["terms"], "<u2"), np.frombuffer(r["own"]["sizes"], "<i8")))
    bags = joined(parts)
    bags = bags._replace(x=bags.x.astype(np.float64))
    model = AttentionModel(bags.x.mean(0), bags.x.std(0) + 1e-3)
    return model.fit(bags, np.array([min(max(r["label"], 0.0), 1.0) for r in got]))


def score(docs: DataFrame, model: AttentionModel | None, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score to a table; all its other columns stay."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.full(len(texts), 0.5) if model is None else model.score(encode(texts)), pa.float64())]

    return add_columns(docs, text, {name: DoubleType()}, run)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
