"""Reachability in commit graphs against a plain walk; rows of a round in a merge-rich history."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import commitgraph

FORM = "work_id string, id long, parent_id long, at long"


def walk(rows, starts):
    parents, known = defaultdict(set), {(w, i) for w, i, _, _ in rows}
    for w, i, p, _ in rows:
        if p is not None and (w, p) in known:
            parents[w, i].add((w, p))
    depth = {s: 0 for s in starts if s in known}
    level = list(depth)
    while level:
        level = list({p for c in level for p in parents[c] if p not in depth and not depth.update({p: depth[c] + 1})})
    return depth


def graph(seed, n):
    rng, rows = random.Random(seed), []
    for w, size in (("a", n), ("b", n // 3), ("c", 1)):
        for i in range(size):
            for p in {rng.randrange(max(0, i - 9), i) for _ in range(rng.choice([1, 1, 2, 3]))} if i else {None}:
                rows.append((w, i * 7 % 10007, None if p is None else p * 7 % 10007, i))
        rows.append((w, 99999, 88888, -1))  # a parent that is not there
    return rows


@pytest.mark.parametrize("block", [3, 40, 1 << 16])
def test_reached(spark, block):
    rows = graph(block, 200)
    starts = [("a", 150 * 7 % 10007), ("a", 120 * 7 % 10007), ("b", 60 * 7 % 10007), ("c", 0), ("c", 5), ("d", 0)]
    commits = spark.createDataFrame(rows + rows[:30], FORM)
    got = commitgraph.reached(commits, spark.createDataFrame(starts, "work_id string, id long"), "at", block)
    assert {(r.work_id, r.id): r.depth for r in got.collect()} == walk(rows, starts) and got.count() == len(walk(rows, starts))


def test_objects_and_early_stop(spark):
    rows = graph(1, 300)
    starts = [("a", 299 * 7 % 10007), ("b", 99 * 7 % 10007)]
    objects = [(w, i, f"o{(i * 31) % 50}") for w, i, _, _ in rows]
    wanted = ["o1", "o2", "o77"]
    commits, at = spark.createDataFrame(rows, FORM), spark.createDataFrame(starts, "work_id string, id long")
    reach = walk(rows, starts)
    want = {(w, o) for w, i, o in objects if (w, i) in reach and o in wanted}
    table = spark.createDataFrame(objects, "work_id string, id long, object_id string")
    asked = spark.createDataFrame([(o,) for o in wanted], "object_id string")
    got = commitgraph.reached_objects(commits, at, table, asked, "at", 20)
    assert {tuple(r) for r in got.collect()} == want
    assert commitgraph.reached_objects(commits, at, table, asked.where("object_id = 'o77'"), "at", 20).isEmpty()


def test_a_merge_rich_history_costs_its_edges(spark):
    """Two parents each: no round carries more than a row for each commit that its block's edges lead out to."""
    n = 20_000
    commits = spark.range(n).select(F.lit("w").alias("work_id"), "id", F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("parent_id")).where("parent_id >= -1")
    commits = commits.withColumn("parent_id", F.when(F.col("parent_id") >= 0, F.col("parent_id"))).withColumn("at", F.col("id"))
    seen, steps = 0, 0
    for some in commitgraph.rounds(commits, spark.createDataFrame([("w", n - 1)], "work_id string, id long"), "at", 4096):
        k = some.count()
        assert k <= 4096
        seen, steps = seen + k, steps + 1
    assert (seen, steps) == (n, 5)


def test_an_order_that_is_none(spark):
    rows = [("a", 1, 2, 5), ("a", 2, None, 9)]
    with pytest.raises(ValueError, match="before its child"):
        commitgraph.reached(spark.createDataFrame(rows, FORM), spark.createDataFrame([("a", 1)], "work_id string, id long"), "at")


def test_nothing(spark):
    none = spark.createDataFrame([], FORM)
    assert commitgraph.reached(none, none.select("work_id", "id"), "at").count() == 0


def test_a_long_history_takes_few_rounds(spark, monkeypatch):
    """No round for each block of a history; side lines, shortcuts, several works and starts, and a busy stretch among them."""
    rng, rows = random.Random(4), []
    for w, size in (("a", 640), ("b", 200), ("c", 1)):
        for i in range(size):
            near = {i - 1, i - 2} if w == "a" and rng.random() < 0.3 else {i - 3} if w == "b" else {i - 1}
            if w == "a" and 300 < i < 311:
                near |= {rng.randrange(i) for _ in range(4)}
            rows += [(w, i, p, i) for p in near if p >= 0] or [(w, i, None, i)]
    starts = [("a", 639), ("a", 500), ("b", 199), ("b", 100), ("c", 0), ("d", 1)]
    steps, durable = [], commitgraph.durable
    monkeypatch.setattr(commitgraph, "durable", lambda df, what="cut": (steps.append(what), durable(df, what))[1])
    found = commitgraph.reached(spark.createDataFrame(rows, FORM), spark.createDataFrame(starts, "work_id string, id long"), "at", 40).collect()
    assert {(r.work_id, r.id): r.depth for r in found} == walk(rows, starts) and len(found) == len(walk(rows, starts))
    assert "reached" in steps and steps.count("settled") < 8  # 16 blocks
