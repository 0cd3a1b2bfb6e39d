"""Recall for all works against the search for named targets, and the pairs it sums."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import bags, recall, search


def frames(spark, seed, works=60):
    rng = random.Random(seed)
    bag, units = [], []
    for w in range(works):
        family = w % 12
        own = [f"f{family}-{rng.randrange(40)}" for _ in range(rng.choice([0, 3, 20, 60]))] + [f"own{w}-{k}" for k in range(rng.choice([0, 5]))]
        own += ["license"] * rng.choice([1, 1, 2]) + (["makefile"] if w % 2 else [])
        bag += [(f"w{w}", f"p{k}", b) for k, b in enumerate(own)]
        units += [(f"w{w}", f"s{family % 6}-{rng.randrange(15)}") for _ in range(rng.choice([0, 0, 4, 12]))]
    units += [("nobody", "s1-1")]
    names = [(f"w{w}", f"name {w % 5}", f"c{w % 3}") for w in range(works) if w % 4]
    return spark.createDataFrame(bag, "work_id string, path string, blob string"), spark.createDataFrame(units, "work_id string, shape string"), spark.createDataFrame(names, "work_id string, display_name string, commit string")


@pytest.mark.parametrize(("k", "light"), [(1, 32), (4, 8), (30, 5), (100, 2)])
def test_same_rows_as_the_search_by_name(spark, k, light):
    bag, units, names = frames(spark, k)
    every = [r.work_id for r in bag.select("work_id").distinct().collect()]
    want = search.head_candidates(bag, units, every, k, names).collect()
    got = recall.head_recall(bag, units, k, names, light).select(*want[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(every) * min(k, len(every) - 1)


def test_a_value_of_all_works_makes_no_square_of_pairs(spark):
    rows = [(f"w{w}", f"p{k}", f"f{w // 6}-{k}") for w in range(300) for k in range(10)] + [(f"w{w}", "LICENSE", "license") for w in range(300)]
    bag = spark.createDataFrame(rows, "work_id string, path string, blob string")
    sized = recall._sized(bags.counts(bag, "blob").withColumnRenamed("blob", "value"))
    pairs = recall.recall_pairs(sized, sized.where("false"), 3)
    assert pairs.count() == 300 * 5 and bags.overlaps(bags.counts(bag, "blob"), "blob").count() == 300 * 299
    assert pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n <> 5").isEmpty()


def test_what_most_works_share_brings_no_pair_that_cannot_win(spark):
    """Two values of a family and three of all works: the sum of both is the floor, which three alone don't reach."""
    rows = [(f"w{w}", v) for w in range(60) for v in [*(f"f{w // 6}-{k}" for k in range(2)), *(f"all{k}" for k in range(3)), *(f"own{w}-{k}" for k in range(8)), None]]
    bag = spark.createDataFrame(rows, "work_id string, blob string")
    sized = recall._sized(bags.counts(bag, "blob").withColumnRenamed("blob", "value"))
    assert sized.groupBy("work_id").agg(F.sum("n").alias("n"), F.max("total").alias("total")).where("n <> 13 or total <> 14").isEmpty()
    assert recall.recall_pairs(sized, sized.where("false"), 3).count() == 60 * 5
    own = bag.withColumn("path", F.lit("p"))
    got = recall.head_recall(own, own.where("false").select("work_id", F.col("blob").alias("shape")), 5).collect()
    assert len(got) == 60 * 5 and all((int(r.target[1:]) // 6, r.blob_shared) == (int(r.candidate[1:]) // 6, 5) for r in got)


def test_works_without_a_like(spark):
    bag = spark.createDataFrame([("a", "p", "1"), ("b", "p", "2"), ("c", "p", "3")], "work_id string, path string, blob string")
    units = spark.createDataFrame([], "work_id string, shape string")
    got = {(r.target, r.candidate, r.score, r["rank"]) for r in recall.head_recall(bag, units, 1).collect()}
    assert got == {("a", "b", 0.0, 1), ("b", "a", 0.0, 1), ("c", "a", 0.0, 1)}
    assert recall.head_recall(bag.where("false"), units, 3).count() == 0


def test_pairs_are_never_broadcast_and_frequent_values_count(spark, monkeypatch):
    rows = [(f"w{w}", b) for w in range(6) for b in ["every", f"x{w % 2}"]]
    counted = bags.counts(spark.createDataFrame(rows, "work_id string, value string"), "value")
    sized = recall._sized(counted)
    works = sized.select("work_id").distinct()
    pairs = recall._shuffled(works.select(F.col("work_id").alias("target")).crossJoin(works.select(F.col("work_id").alias("candidate"))).where("target <> candidate"))
    wanted = {(f"w{a}", f"w{b}"): 1 + (a % 2 == b % 2) for a in range(6) for b in range(6) if a != b}
    monkeypatch.setattr(recall, "COOL", 4)
    summed = recall._summed(pairs, sized, works)
    assert {(r.target, r.candidate): r.shared for r in summed.collect()} == wanted
    other = sized.select(F.col("work_id").alias("target"), "value")
    assert "BroadcastHashJoin" not in pairs.join(other, "target")._jdf.queryExecution().executedPlan().toString()
