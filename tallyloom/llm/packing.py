"""Packing into optimal length buckets and token-budget batches.

A document's length is its number of tokens (operator 3), so the budget is one of tokens. The
lengths of all documents go into one exact global histogram, a row for each distinct length, which
the driver holds. Dynamic programming over it finds the boundaries of at most `BUCKETS` buckets with
the least padding in total; the cost is Monge, so n log n steps a bucket are enough. Inside a
bucket every document is padded to the bucket's boundary; documents stand by length and are cut
into batches of as many as the token budget holds. Ranks come from range-dealt partitions
(`ranked`), so a bucket with a third of all rows spans as many tasks as it needs.

Defined results: null text has length 0 and is packed like any other; equal lengths stand by
doc_id; repeated rows are each packed; a document longer than the budget is a batch of its own,
whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, ranked, table
from .token_counts import token_counts

BUCKETS, BUDGET = 8, 16_384


def _last_cuts(least: np.ndarray, top: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least cost up to each length with one more bucket, and the cut before that bucket.

    The cost is Monge, so cuts rise with the length: those of every second length bound the cuts
    between them, and all rounds of halving look at n log n candidates.
    """
    n = len(top)
    best, at = np.full(n, np.iinfo(np.int64).max // 2), np.zeros(n, np.int64)
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step:
        j = np.arange(step, n, 2 * step)
        low, after = at[j - step], j + step
        high = np.minimum(np.where(after < n, at[np.minimum(after, n - 1)], n), j - 1)
        size = high - low + 1
        begin = np.cumsum(size) - size
        i = np.arange(int(size.sum())) + np.repeat(low - begin, size)
        row = np.repeat(j, size)
        cost = least[i] + top[row] * (c[row + 1] - c[i + 1]) - (s[row + 1] - s[i + 1])
        best[j] = np.minimum.reduceat(cost, begin)
        hits = np.flatnonzero(cost == np.repeat(best[j], size))
        at[j] = i[hits[np.searchsorted(hits, begin)]]
        step >>= 1
    return best, at


def best_boundaries(longest: list[int], counts: list[int], sums: list[int], buckets: int = BUCKETS) -> list[int]:
    """Boundaries that minimise padding, from bins in ascending order; ties go to the earlier cut."""
    n = len(longest)
    if not n:
        return []
    top, c, s = np.array(longest, np.int64), np.cumsum([0, *counts]), np.cumsum([0, *sums])
    least = top * c[1:] - s[1:]
    cuts = []
    for _ in range(1, min(buckets, n)):
        least, at = _last_cuts(least, top, c, s)
        cuts.append(at)
    j = n - 1
    out = [int(top[j])]
    for at in reversed(cuts):
        j = int(at[j])
        out.append(int(top[j]))
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Add bucket, bucket_len, batch, slot and padding to rows of (doc_id, length)."""
    kept = durable(lengths.select("doc_id", F.col("length").cast("long").alias("length")), "lengths")
    found = kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")  # a row for each distinct length
    tops, counts = (found[c].to_numpy() for c in ("length", "n"))
    edges = best_boundaries(tops, counts, tops * counts, buckets) or [0]
    bucket = sum((F.col("length") > e).cast("int") for e in edges[:-1]) if len(edges) > 1 else F.lit(0)
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    placed = ranked(kept.withColumn("bucket", bucket), ["bucket"], [F.asc("length"), F.asc("doc_id")], "rank")
    placed = placed.withColumn("bucket_len", bounds[F.col("bucket")])
    holds = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div greatest(bucket_len, 1L)"))
    placed = placed.withColumn("holds", holds)
    return placed.select(
        "doc_id",
        "length",
        "bucket",
        "bucket_len",
        F.expr("`rank` div holds").alias("batch"),
        F.expr("`rank` % holds").alias("slot"),
        (F.col("bucket_len") - F.col("length")).alias("padding"),
    )


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length) of documents, with the token counts of operator 3."""
    return token_counts(docs.select("doc_id", "text"), name="length").select("doc_id", "length")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_lengths(table(spark, sf_dir, "documents")))
