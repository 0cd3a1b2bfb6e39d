"""SimHash near-duplicates found through anchor points of a covering code.

Anchors are the codewords of Golay x Golay x {0}: the perfect binary [23, 12] Golay code (covering
radius 3) on bits 0-22 and again on bits 23-45, and the zero word on bits 46-63. Every fingerprint
has one nearest anchor, its home. If two fingerprints differ in at most two bits, the home of one
lies within covering radius plus two of the other, split over the two code blocks; so a
fingerprint is replicated to each anchor (2^24 of them, 61 a fingerprint on average, 484 at most)
that some fingerprint within two bits of it can have as home, and pairs are compared per anchor.
No pair within the threshold is missed, at any size.

Texts are fingerprinted where they are read; only 8-byte fingerprints are shuffled, each distinct
one once, so copies cost nothing beyond a partial aggregation; a fingerprint that many rows share is
a hot key, whose component is broadcast to them (`by_key`). Links become components through star
contraction over cut tables (see `components`).

Defined results: null and blank texts have fingerprint zero and link like any other; equal
fingerprints form one component; a component is named by its smallest doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import add_columns, by_key, durable, table, unused
from .components import component_labels

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Bytes of a text whose shingles are hashed at once.
BLOCK = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_MASK = (1 << 23) - 1
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011


def _blocks(data: bytes, size: int) -> Iterator[bytes]:
    """Bytes in blocks of about `size`, cut at blanks; a longer word stays whole."""
    at = 0
    while len(data) - at > size:
        found = _BLANK.search(data, at + size)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def fingerprint(text: str | None, size: int = SHINGLE, block: int = BLOCK) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer; 0 without words."""
    if not text:
        return 0
    hashed, rest, n, ones = xxhash.xxh64_intdigest, [], 0, np.zeros(64, np.int64)
    for part in _blocks(text.encode("utf-8", "surrogatepass").lower(), block):
        found = rest + part.split()
        if len(found) < size:
            rest = found
            continue
        whole = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = [0, *ends[:-size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
        h = np.fromiter([hashed(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(stops))
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n, rest = n + len(h), found[len(found) - size + 1 :]
    if not n:
        return hashed(b" ".join(rest), SEED) if rest else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


class Golay:
    """Syndrome decoding of the perfect [23, 12] code, and the codewords near each coset."""

    _one: list[Golay] = []

    @classmethod
    def shared(cls) -> Golay:
        if not cls._one:
            cls._one.append(cls())
        return cls._one[0]

    def __init__(self):
        rest = np.zeros(1 << 12, np.int64)  # remainder of m * x^11 by the generator
        for m in range(1 << 12):
            x = m << 11
            for bit in range(22, 10, -1):
                if x >> bit & 1:
                    x ^= _GENERATOR << (bit - 11)
            rest[m] = x
        self.rest = rest
        self.code = (np.arange(1 << 12) << 11) | rest
        leaders = [0, *[1 << i for i in range(23)]]
        leaders += [1 << i | 1 << j for i in range(23) for j in range(i)]
        leaders += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        leaders = np.array(leaders, np.int64)
        self.leader = np.zeros(1 << 11, np.int64)
        self.leader[self.syndrome(leaders)] = leaders
        far = np.bitwise_count(self.leader[:, None] ^ self.code[None, :])
        # moves[e]: by coset, words (12 bits) of codewords that e flips, no fewer, can make nearest; -1 fills up
        self.moves = [np.zeros((1 << 11, 1), np.int64)]
        for e in (1, 2):
            near = far == 3 + e
            most = int(near.sum(1).max())
            order = np.argsort(~near, axis=1, kind="stable")[:, :most]
            self.moves.append(np.where(np.take_along_axis(near, order, 1), order, -1))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return (x & 0x7FF) ^ self.rest[x >> 11]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word of the nearest codeword, and the coset."""
        s = self.syndrome(x)
        return (x ^ self.leader[s]) >> 11, s


def homes(fp: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint (int64 bit patterns), as 24 bits."""
    g = Golay.shared()
    a, _ = g.home(fp & _MASK)
    b, _ = g.home((fp >> 23) & _MASK)
    return (a << 12) | b


def reach(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for each anchor that can be home of something within two bits."""
    g = Golay.shared()
    a, sa = g.home(fp & _MASK)
    b, sb = g.home((fp >> 23) & _MASK)
    own, rows, anchors = np.arange(len(fp)), [], []
    for ea, eb in ((0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (0, 2)):  # flips spent in each block
        ma, mb = g.moves[ea][sa][:, :, None], g.moves[eb][sb][:, None, :]
        there = (ma >= 0) & (mb >= 0)
        both = ((a[:, None, None] ^ ma) << 12) | (b[:, None, None] ^ mb)
        anchors.append(both[there])
        rows.append(np.broadcast_to(own[:, None, None], there.shape)[there])
    return np.concatenate(rows), np.concatenate(anchors)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint (long, the bit pattern) to a table; all its other columns stay."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))]

    return add_columns(docs, text, {name: LongType()}, run)


def near_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of distinct fingerprints (column fp) that differ in one or two bits."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(homes(x).astype(np.int32)), batch.column(0)], ["anchor", "x"])

    def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for k in range(0, len(y), 4096):
                rows, anchors = reach(y[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), pa.array(y[k : k + 4096][rows])], ["anchor", "y"])

    home = fps.select("fp").mapInArrow(at_home, "anchor int, x long")
    near = fps.select("fp").mapInArrow(within_reach, "anchor int, y long")
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= THRESHOLD
    # merged at every size: Spark sizes either side by the fingerprints it is made of, but `near` has 61 rows for each
    return home.hint("merge").join(near.hint("merge"), (home["anchor"] == near["anchor"]) & (F.col("x") < F.col("y")) & close).select("x", "y")


def group_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, part, component_id) for each document; `part` is one fingerprint of its component."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    at = durable(fingerprints(own.withColumn("text_hash", F.xxhash64("text"))).drop("text"), "fp")
    first = durable(at.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    links = durable(near_pairs(first), "links")
    moved = component_labels(links, "x", "y")  # only fingerprints that have a link
    moved = durable(moved.join(first, moved["node"] == first["fp"]).select("fp", F.col("label").alias("part"), "first", "n"), "moved")
    least = moved.groupBy("part").agg(F.min("first").alias("component_id"))
    named = moved.select("fp", "part").join(least, "part")
    known = first.join(named, "fp", "left")
    component = F.when(F.col("part").isNull(), F.col("first")).otherwise(F.col("component_id"))
    known = durable(known.select("fp", F.coalesce("part", "fp").alias("part"), component.alias("component_id"), "n"), "known")
    return by_key(at, known, "fp", "n").select("doc_id", "text_hash", "fp", "part", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id, null last.

    Rows that share the doc_id are told apart by a 64-bit hash of the text, the least of which stays;
    of rows that share both, one stays (any one, if other columns differ).
    """
    key, held, n = unused(docs, "__key"), unused(docs, "__held"), unused(docs, "__n")
    rows = group_near(docs).groupBy("part", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("held"), F.col("n").alias("n"))
    first = rows.groupBy("part").agg(F.min(order).alias("first"))
    # merged at every size, as its file is many times smaller than what a broadcast takes of the driver
    first = durable(first.select(F.col("first.id").alias(key), F.col("first.held").alias(held), F.col("first.n").alias(n)), "kept").hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(held))
    once = docs.join(first.where(F.col(n) == 1), same, "left_semi")
    repeated = first.where(F.col(n) > 1)
    if repeated.isEmpty():
        return once
    again = docs.join(repeated, same, "left_semi").withColumn(held, F.xxhash64("text"))
    return once.union(again.dropDuplicates(["doc_id", held]).drop(held))
