"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of the most frequent letter n-grams (1 to 3) of a language, by rank. A text
gets the profile nearest to its own list: the distance adds, for each of the text's grams, how far
its rank lies from the rank in the profile (`TOP` where the profile lacks it).

Profiles are learned from a bounded sample of labelled rows (`TRAIN_PER_LANG` for each language,
chosen by a hash of the id); every text is then scored whole, in one pass, with no shuffle of text.

Defined results: null text or text without a letter gives `und` and score 0; ties between
languages go to the first by name; repeated rows are scored each on its own; no labelled rows
means no profiles, and every text is `und`; a null doc_id is not held out and not learned from.
Grams are counted in slices of `SLICE` code points, so a long text takes memory for its distinct
grams and not for all of them. Columns that bear the new names are replaced, as `withColumn` does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ._common import add_columns, small_batches, table, unused

#: Grams kept of a profile and of a text; labelled texts a language's profile is fitted on.
TOP = 300
TRAIN_PER_LANG = 1500
#: Languages that a model holds at most; more are an error, not cut off.
MOST_LANGS = 500
#: Code points whose grams are counted at once.
SLICE = 1 << 18

_FOLDED: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point: 0 if it isn't a letter, else the letter itself."""
    if not _FOLDED:
        _FOLDED.append(np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000))
    return _FOLDED[0]


def gram_codes(text: str, size: int = SLICE) -> Iterator[np.ndarray]:
    """Codes of all letter n-grams of a text, n = 1 to 3, words padded with one mark on each side, slice by slice.

    A code packs up to three 21-bit code points; the mark is 1. Grams with the mark inside, and
    the mark alone, are left out. Nothing for a text without letters.
    """
    low, before, last, some = text.lower(), np.empty(0, np.int64), 0, False
    for k in range(0, len(low) + 1, size):
        at = _fold()[np.frombuffer(low[k : k + size].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if k == 0:
            at = np.concatenate(([0], at))
        if k + size > len(low):
            at = np.concatenate((at, [0]))
        if not len(at):
            continue
        some = some or bool(at.any())
        keep = at != 0
        keep[1:] |= at[:-1] != 0
        keep[0] |= last != 0 or k == 0
        last = at[-1]
        new = at[keep]
        new[new == 0] = 1
        c = np.concatenate((before, new))
        n, before = len(before), c[-2:]
        two = (c[:-1] << 21) | c[1:]
        three = ((c[:-2] << 42) | two[1:])[c[1:-1] != 1]
        old = int(n == 2 and c[1] != 1) if n < 2 else 0  # grams of three all end in what is new, as two marks are carried
        if some:
            yield np.concatenate((new[new != 1], two[max(0, n - 1) :], three[old:]))


def gram_counts(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs, over all parts."""
    found, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for codes in parts:
        own, m = np.unique(codes, return_counts=True)
        if len(found):
            own, back = np.unique(np.concatenate((found, own)), return_inverse=True)
            m = np.bincount(back, np.concatenate((n, m))).astype(np.int64)
        found, n = own, m
    return found, n


def top_grams(counts: tuple[np.ndarray, np.ndarray], top: int = TOP) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, n = counts
    if len(found) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        found, n = found[n >= least], n[n >= least]
    return found[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    """Rank-order profiles by language name."""

    def __init__(self, ranked: dict[str, list[int]], top: int = TOP):
        self.top, self.langs = top, sorted(ranked)
        self.codes, self.ranks = [], []
        for lang in self.langs:
            own = np.asarray(ranked[lang], np.int64)
            order = np.argsort(own)
            self.codes.append(own[order])
            self.ranks.append(order)

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        out, own = np.ones(len(self.langs)), np.arange(len(grams))
        for k, (codes, ranks) in enumerate(zip(self.codes, self.ranks, strict=True)):
            at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
            found = codes[at] == grams
            gap = np.where(found, np.abs(ranks[at] - own), self.top)
            out[k] = gap.sum() / (self.top * len(grams))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how clearly it is nearest: its rival's share of the two distances."""
        grams = top_grams(gram_counts(gram_codes(text)), self.top) if text and self.langs else ()
        if len(grams) == 0:
            return "und", 0.0
        far = self.distances(grams)
        best = int(far.argmin())
        if len(far) == 1:
            return self.langs[0], float(1 - far[0])
        rival = float(np.delete(far, best).min())
        both = rival + float(far[best])
        return self.langs[best], rival / both if both else 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, top: int = TOP, per_lang: int = TRAIN_PER_LANG) -> Profiles:
    """Fit profiles on (doc_id, text, lang) rows: about `per_lang` texts of each language, by hash of the id."""
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    if not counts:
        return Profiles({}, top)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_lang / r["n"])])
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.where(dealt < F.element_at(share, F.col("lang")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                found, n = gram_counts(codes for text in texts for codes in gram_codes(text))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    seen = sample.select("lang", "text").mapInArrow(grams, "lang string, code long, n long")
    summed = seen.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = summed.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "code", "rank").collect()
    by: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        by.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by, top)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score to any table; all its columns stay."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        found = [profiles.predict(x) for x in texts]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return add_columns(docs, text, {lang: StringType(), score: DoubleType()}, run)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """The documents whose language is known with a score of `least` or more, in their own columns."""
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    found = predict(docs, profiles, "text", lang, score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(training_rows(docs))
    found = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")
