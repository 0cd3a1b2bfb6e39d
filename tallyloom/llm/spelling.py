"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are counted by built-in expressions (`word_counts`). Two words are near if one inserted, deleted
or replaced code point makes one of them the other. Postings of common grams hold a large part of all
words, so the index isn't one table of them: it is built per block. A block holds the words of one
length (and those one longer) that agree outside a free region, the place of the edit; a word's
first two blocks are its halves, and a block of over `BLOCK` words is split again by the halves of
its region, until the region is one code point, where a block is as small as the alphabet. An edit lies
in one half, so no pair is lost and each is found in one block.

Within a block, every padded bigram of the region has a posting list by position. For each word the
lists at its own positions (for a longer word also one place earlier) are merged by a heap, and the
words that occur often enough, all grams of the region but those one edit can touch, are verified.

Defined results: null texts have no words; a null doc_id reads as an empty id; repeated rows count each;
without words the result is empty; texts of any length are cut into blocks between words; other columns
are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, small_batches, table

#: What a word is made of, the code points it has at least, and its occurrences at least.
LETTERS, SHORTEST, OFTEN = r"[A-Za-zÀ-ÿ]", 7, 2
#: A run of letters loses a code point where the checksum of its id and itself is divisible by this.
NOISE = 31
#: Times a form is as frequent as the word at least.
RATIO = 10
#: Words of a block at most, before it is split; code points of a text that are taken at once.
BLOCK, SLICE = 128, 1 << 16
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, n): the noised runs of letters of all texts that are long and frequent enough.

    Runs shorter than `SHORTEST` never become words, so the pattern passes them over.
    """
    t = F.col(f"`{text}`")
    # a slice takes the letters behind it along, so it ends where a run does
    slices = F.when(F.length(t) <= SLICE, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{SLICE}}}{LETTERS}*"), F.lit(0)))
    some = docs.where(t.isNotNull()).select(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(slices).alias("t"))
    runs = some.select("id", F.explode(F.regexp_extract_all("t", F.lit(rf"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _CAPITALS, _CAPITALS.lower()).alias("run")).withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    noised = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    found = runs.select(F.when(F.col("h") % NOISE == 0, noised).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= SHORTEST)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (word, n, more, base, s, e) dealt to both halves of the region [s, e), with the key of what lies outside it.

    `more` is 1 in blocks of the words one shorter (of length `base`), where the region is one longer.
    """
    mid = ((F.col("s") + F.col("e")) / 2).cast("int")
    halves = F.array(F.struct(F.col("s").alias("s"), mid.alias("e")), F.struct(mid.alias("s"), F.col("e").alias("e")))
    dealt = rows.withColumn("half", F.explode(halves)).withColumn("s", F.col("half.s")).withColumn("e", F.col("half.e")).drop("half")
    outside = F.xxhash64("base", "s", "e", F.substring("word", F.lit(1), F.col("s")), F.substring("word", F.col("e") + F.col("more") + 1, F.char_length("word")))
    return dealt.withColumn("key", outside)


def _last(e: Column, s: Column) -> Column:
    return e - s <= 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once. `words` has one row a word and is read several times."""
    spark = words.sparkSession
    small_batches(spark)
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("more")).withColumn("base", size - F.col("more")).withColumn("s", F.lit(0)).withColumn("e", F.col("base"))
    found: list[DataFrame] = []
    block = ["key", "base", "s", "e"]
    while True:
        rows = _blocks(rows)
        held = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("held"), F.min("more").alias("least"))
        held = durable(held.where((F.col("held") > 1) & (F.col("least") == 0)).drop("least"), "blocks")
        large = (F.col("held") > BLOCK) & ~_last(F.col("e"), F.col("s"))
        whole = rows.join(held.where(~large).drop("held"), block).groupBy(*block).agg(F.collect_list(F.struct("word", "n", "more")).alias("all"))
        whole = whole.select("base", "s", "e", F.col("all.word").alias("words"), F.col("all.n").alias("ns"), F.col("all.more").alias("more"))
        found.append(durable(whole.mapInArrow(_pairs, "a string, a_n long, b string, b_n long"), "near"))
        split = held.where(large)
        if split.isEmpty():
            break
        rows = durable(rows.join(split.drop("held"), block).drop("key"), "split")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, a_n, b, b_n = [], [], [], []
        for base, s, e, words, ns, more in zip(*(c.to_pylist() for c in batch.columns)):
            for i, j in near_in_block(words, more, base, s, e):
                a.append(words[i]), a_n.append(ns[i]), b.append(words[j]), b_n.append(ns[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(a_n, pa.int64()), pa.array(b, pa.string()), pa.array(b_n, pa.int64())], ["a", "a_n", "b", "b_n"])


def near_in_block(words: list[str], more: list[int], base: int, s: int, e: int) -> Iterator[tuple[int, int]]:
    """Pairs of places of near words in a block whose first differing code point lies in [s, e) (or at the very end)."""
    postings: dict[tuple[int, str], list[int]] = {}
    short = [k for k, m in enumerate(more) if not m]
    grams = {}
    for k, (word, m) in enumerate(zip(words, more)):
        padded = f"\0{word}\1"
        grams[k] = [padded[p : p + 2] for p in range(s, e + m + 1)]
    for k in short:
        for p, g in enumerate(grams[k]):
            postings.setdefault((p, g), []).append(k)
    for k, m in enumerate(more):
        lists = []
        for p, g in enumerate(grams[k]):
            for at in (p, p - 1) if m else (p,):
                got = postings.get((at, g))
                if got and (m or got[-1] > k):
                    lists.append(got)
        bound = e - s - 1 + m
        for j in _often(lists, bound, short):
            if (m or j > k) and _one_edit(words[j], words[k], s, e, base):
                yield k, j


def _often(lists: list[list[int]], bound: int, every: list[int]) -> Iterator[int]:
    """Members of at least `bound` of the sorted lists, by merging them with a heap; of none needed, all."""
    if bound <= 0:
        yield from every
    elif len(lists) >= bound:
        last, n = -1, 0
        for k in heapq.merge(*lists):
            n = n + 1 if k == last else 1
            last = k
            if n == bound:
                yield k


def _one_edit(short: str, other: str, s: int, e: int, base: int) -> bool:
    """Whether one edit makes `short` the other word (as long or one longer), first differing in the block's region."""
    if short[:s] != other[:s]:
        return False
    i = s
    while i < base and short[i] == other[i]:
        i += 1
    if not (i < e or i == e == base):
        return False
    if len(other) == base:
        return i < base and short[i + 1 :] == other[i + 1 :]
    return short[i:] == other[i + 1 :]


def variant_forms(words: DataFrame) -> DataFrame:
    """Of (word, n): word, n, form, root, n_near, form_n.

    A form is at least `RATIO` times as frequent as its word, so following forms ends after as many
    steps as the largest count has digits; the way is doubled in each round.
    """
    words = durable(words, "words")
    pairs = near_pairs(words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other"))).alias("best"))
    most = -F.col("best.less")
    known = words.join(best, "word", "left")
    formed = most >= RATIO * F.col("n")
    known = durable(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, most).alias("form_n")), "forms")
    way = known.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = durable(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        way = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return known.join(way, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(word_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
