"""Head records against a plain twin; pages of occurrences, read on from any page."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import bags, headrecord, pages, recall, search

ORDER = ["path", "line", "symbol"]


def frames(spark):
    rng = random.Random(4)
    bag = [(f"w{w}", f"{rng.choice(['', 'a/', 'a/b/'])}f{rng.randrange(9)}.c", f"b{rng.randrange(25)}") for w in range(9) for _ in range(rng.choice([0, 5, 30]))] + [("w8", "z", "only")]
    units = [(f"w{w}", f"{rng.choice(['', 'a/', 'a/b/'])}f{rng.randrange(9)}.c", k, f"s{k}", f"x{rng.randrange(8)}") for w in range(9) for k in range(rng.choice([0, 6, 25]))]
    works = [(f"w{w}", 2020 + w, "competition", "", ["memory"] if w % 2 else [], "main", f"work {w}") for w in range(7)]
    return (
        bag,
        units,
        spark.createDataFrame(bag, "work_id string, path string, blob string"),
        spark.createDataFrame(units, "work_id string, path string, line long, symbol string, shape string"),
        spark.createDataFrame(works, "work_id string, year int, repository_type string, reference_kind string, module_ids array<string>, review_branch string, display_name string"),
    )


def counts(left, right):
    shared = sum((left & right).values())
    a, b = (round(shared / sum(x.values()), 6) if x else 0.0 for x in (left, right))
    return {"shared_instances": shared, "target_total_instances": sum(left.values()), "candidate_total_instances": sum(right.values()), "target_containment": a, "candidate_containment": b, "balanced": min(a, b)}


def test_head_records(spark):
    rows, unit_rows, bag, units, works = frames(spark)
    found = recall.head_recall(bag, units, 4)
    got = {r.target: json.loads(r.text) for r in headrecord.head_records(found, bag, units, works, ORDER).collect()}
    held = lambda w, *at: Counter(tuple(r[i] for i in at) for r in rows if r[0] == w)
    shaped = lambda w, *at: Counter(tuple(r[i] for i in at) for r in unit_rows if r[0] == w)
    assert set(got) == {r[0] for r in rows}
    for target, record in got.items():
        assert record["schema"].endswith("search_candidates.v3") and record["target_work_id"] == target and len(record["candidates"]) == min(4, len(got) - 1)
        scores = [c["combined_recall_score"] for c in record["candidates"]]
        assert scores == sorted(scores, reverse=True)
        for c in record["candidates"]:
            w = c["work_id"]
            blob, ast = c["blob_overlap"], c["ast_overlap"]
            assert blob["content_instances"] == counts(held(target, 2), held(w, 2)) and blob["path_aligned_instances"] == counts(held(target, 1, 2), held(w, 1, 2))
            assert blob["shared_unique_blobs"] == len(held(target, 2) & held(w, 2)) and blob["relocated_instances"] == blob["content_instances"]["shared_instances"] - blob["path_aligned_instances"]["shared_instances"]
            assert ast["shape_instances"] == counts(shaped(target, 4), shaped(w, 4)) and ast["path_aligned_shape_instances"] == counts(shaped(target, 1, 4), shaped(w, 1, 4))
            assert c["combined_recall_score"] == max(blob["content_instances"]["balanced"], ast["shape_instances"]["balanced"])
            assert (c["year"], c["module_ids"]) == ((2020 + int(w[1:]), ["memory"] if int(w[1:]) % 2 else []) if int(w[1:]) < 7 else (0, []))
            left, by_dir = shaped(w, 4), defaultdict(lambda: [0, 0])
            for r in sorted((r for r in unit_rows if r[0] == target), key=lambda r: r[1:4]):
                own = by_dir[r[1].rpartition("/")[0] or "(root)"]
                own[1] += 1
                if left[(r[4],)]:
                    left[(r[4],)] -= 1
                    own[0] += 1
            want = [(d, {"shared_instances": n, "target_instances": m}) for d, (n, m) in sorted(by_dir.items(), key=lambda x: (-x[1][0], x[0]))]
            assert list(c.get("overlap_by_target_directory", {}).items()) == want


def test_pages_of_a_comparison(spark):
    rows, _, bag, _, _ = frames(spark)
    sides = [bag.where(F.col("work_id").isin("w0", "w1", "w2", "w3")).select("path", "blob"), bag.where(F.col("work_id").isin("w4", "w5", "w6", "w7", "w8")).select("path", "blob")]
    made = pages.pair_pages(*sides, 7).persist()
    told = {r.part: r for r in pages.manifest(made).collect()}
    assert max(r.n for r in made.collect()) == 7
    left, right = (Counter((r[1], r[2]) for r in rows if r[0] in ws) for ws in (("w0", "w1", "w2", "w3"), ("w4", "w5", "w6", "w7", "w8")))
    got = pages.read_from(made, "path_aligned_occurrences", 0, "path string, blob string, instances long").orderBy("page", "line").collect()
    assert [(r.path, r.blob, r.instances) for r in got] == sorted((*k, n) for k, n in (left & right).items())
    assert told["path_aligned_occurrences"].rows == len(got) and told["path_aligned_occurrences"].pages == -(-len(got) // 7)
    rest = pages.read_from(made, "right_residual_occurrences", 0, "blob string, path string, instances long").collect()
    assert sum(r.instances for r in rest) == bags.residual(sides[1], sides[0]).count()
    later = pages.read_from(made, "shared_content_occurrences", 2, "blob string, side string, path string, instances long")
    assert later.count() == told["shared_content_occurrences"].rows - 14 and later.agg(F.min("page")).first()[0] == 2


def test_a_broken_page_is_an_error(spark):
    made = pages.history_pages(spark.createDataFrame([("c", f"p{k}", "b", 1) for k in range(9)], "candidate string, path string, blob string, n long"), 4)
    assert pages.read_from(made, "matched_target_occurrences", 1, "candidate string, path string").count() == 5
    with pytest.raises(Exception, match="page broken: 1"):
        pages.read_from(made.withColumn("text", F.when(F.col("page") == 1, F.replace("text", F.lit("p4"), F.lit("p5"))).otherwise(F.col("text"))), "matched_target_occurrences", 0, "path string").collect()


def test_directories_of_a_pair_as_one_by_one(spark):
    _, _, _, units, _ = frames(spark)
    pairs = spark.createDataFrame([(a, b) for a in ("w1", "w4", "w7") for b in ("w0", "w2", "w5")], "target string, candidate string")
    got = {(r.target, r.candidate, r.directory): (r.shared_instances, r.target_instances) for r in headrecord.directories(pairs, units, ORDER).collect()}
    for a, b in {k[:2] for k in got}:
        from tallyloom.functions import paths as P

        one = bags.greedy_directories(units.where(F.col("work_id") == a), units.where(F.col("work_id") == b), "shape", P.parent_dir(F.col("path")), [F.col(c) for c in ORDER])
        assert {r.directory: (r.shared_instances, r.target_instances) for r in one.collect()} == {d: v for (x, y, d), v in got.items() if (x, y) == (a, b)}
