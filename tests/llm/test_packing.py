"""Packing counts tokens, and its boundaries are the best there are."""

import random

import pytest

import corpus_pipeline
from tallyloom.llm import packing


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_counts_tokens(spark, library, tmp_path):
    rng = random.Random(8)
    solid = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30_000))
    texts = [solid, "日本語" * 400, None, "", *["plain words, " * rng.randint(1, 300) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for found in (packing.op8_packing(spark, str(tmp_path)), corpus_pipeline.pack_documents(spark, docs, "")):
        got = found.collect()
        assert {r["doc_id"]: r["length"] for r in got} == want
        batches = {}
        for r in got:
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        assert all(len(own) * own[0]["bucket_len"] <= max(packing.BUDGET, own[0]["bucket_len"]) for own in batches.values())
        mine = next(r for r in got if r["doc_id"] == 0)
        assert len(batches[mine["bucket"], mine["batch"]]) == 1


def least_padding(lengths, buckets):
    """Every cut tried, over the exact lengths."""
    lengths = sorted(lengths)
    n = len(lengths)
    least = [0] + [float("inf")] * n
    for _ in range(buckets):
        least = [0] + [min(least[i] + sum(lengths[j - 1] - x for x in lengths[i:j]) for i in range(j)) for j in range(1, n + 1)]
    return least[n]


def test_boundaries_are_optimal_above_1024(spark):
    rng = random.Random(6)
    few = [1100, 1101, 1500, 1501, 2500, 2510, 5000, 5010, 17000, 17100]
    for lengths in ([rng.choice(few) for _ in range(60)], [int(rng.lognormvariate(7.5, 1)) for _ in range(60)], [*range(2000, 2040)] * 2):
        df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
        assert sum(r["padding"] for r in packing.pack(df).collect()) == least_padding(lengths, packing.BUCKETS)


def test_boundaries_of_many_lengths():
    rng = random.Random(7)
    for n in range(1, 40):
        tops = sorted(rng.sample(range(40_000), n))
        counts = [rng.randint(1, 3) for _ in tops]
        for buckets in (1, 2, 3, 8):
            edges = packing.best_boundaries(tops, counts, [t * c for t, c in zip(tops, counts, strict=True)], buckets)
            lengths = [t for t, c in zip(tops, counts, strict=True) for _ in range(c)]
            assert sum(min(e for e in edges if e >= t) - t for t in lengths) == least_padding(lengths, buckets)
            assert len(edges) == min(buckets, n)
