"""Bag algebra against Counter arithmetic, with the awkward cases of multisets."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.operators import bags, search

rows = st.lists(st.tuples(st.sampled_from(["a", "a/b", "c/d/e", "f"]), st.sampled_from(["x", "y", "z"])), max_size=12)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def bag(spark, own, work="w"):
    return spark.createDataFrame([(work, p, b, i) for i, (p, b) in enumerate(own)], "work_id string, path string, blob string, ord long")


def plain_residual(left, right):
    """Exact (path, value) matches are used up first, then the same value elsewhere, in order of path."""
    exact, content = Counter(right), Counter(b for _, b in right)
    rest = []
    for p, b in sorted(left):
        if exact[p, b] > 0:
            exact[p, b] -= 1
            content[b] -= 1
        else:
            rest.append((p, b))
    out = []
    for p, b in rest:
        if content[b] > 0:
            content[b] -= 1
        else:
            out.append((p, b))
    return out


@SLOW
@given(left=rows, right=rows)
def test_residual_and_shared(spark, left, right):
    a, b = bag(spark, left, "l"), bag(spark, right, "r")
    got = bags.residual(a.select("path", "blob"), b).collect()
    assert Counter(map(tuple, got)) == Counter(plain_residual(left, right))
    shared = sum((Counter(x for _, x in left) & Counter(x for _, x in right)).values())
    assert len(got) == len(left) - shared
    summary = search.comparison(a, b).first()
    assert (summary["left_total"], summary["right_total"], summary["shared"]) == (len(left), len(right), shared)
    assert summary["path_aligned"] == sum((Counter(left) & Counter(right)).values())
    assert summary["relocated"] == max(0, summary["shared"] - summary["path_aligned"])


def test_shared_is_a_bag_count(spark):
    counted = bags.counts(bag(spark, [("p", "x")] * 3, "a").union(bag(spark, [("q", "x")] * 2 + [("q", "y")], "b")), "blob")
    pair = bags.containment(bags.overlaps(counted, "blob"), bags.totals(counted)).where("target = 'a'").first()
    assert (pair["shared"], pair["shared_unique"], pair["target_total"], pair["candidate_total"]) == (2, 1, 3, 3)
    assert pair["balanced"] == pytest.approx(2 / 3)


def test_ratio_of_an_empty_side(spark):
    got = spark.createDataFrame([(0, 0), (1, 0), (1, 2)], "a int, b int").select(bags.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == [0.0, 0.0, 0.5]


def test_head_search_keeps_zero_scores_and_skips_itself(spark):
    all_works = bag(spark, [("p", "x"), ("p", "y")], "t").union(bag(spark, [("p", "x")], "a")).union(bag(spark, [("p", "q")], "b"))
    units = spark.createDataFrame([("t", "s1"), ("b", "s2")], "work_id string, shape string")
    got = search.head_candidates(all_works, units, ["t", "nobody"], 30).collect()
    assert [(r["target"], r["candidate"], r["blob_shared"], r["rank"]) for r in got] == [("t", "a", 1, 1), ("t", "b", 0, 2)]


def test_history_search_drops_works_without_a_hit(spark):
    history = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "z"), ("b", "q"), ("t", "x")], "work_id string, object_id string")
    target = bag(spark, [("p", "x"), ("q", "x"), ("r", "y")], "t")
    got = search.history_search(target, history, "t").collect()
    assert [(r["candidate"], r["shared_unique"], r["shared"], r["target_total"]) for r in got] == [("a", 1, 2, 3)]


def test_greedy_directories_share_a_capacity(spark):
    target = spark.createDataFrame([("d1/a", "s", 1), ("d2/b", "s", 1), ("c", "s", 1), ("c", "u", 2)], "path string, shape string, line int")
    candidate = spark.createDataFrame([("s",), ("s",)], "shape string")
    got = bags.greedy_directories(target, candidate, "shape", P.parent_dir(F.col("path")), [F.col("path"), F.col("line")])
    assert {r["directory"]: (r["shared_instances"], r["target_instances"]) for r in got.collect()} == {"(root)": (1, 2), "d1": (1, 1), "d2": (0, 1)}


def test_paths_and_scopes(spark):
    texts = ["src/a.c", "srcx/a.c", "src", "a\\b", " /x/y/ ", "././k.rs", ".hidden", "x.tar.gz", "dir.d/file", None]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    p = F.col("p")
    got = df.select(P.under(p, F.lit("src")).alias("u"), P.clean_prefix(p).alias("c"), P.clean_rel(p).alias("r"), P.file_suffix(p).alias("s"), P.language(p).alias("l")).collect()
    assert [r["u"] for r in got] == [True, False, True, False, False, False, False, False, False, None]
    assert [r["c"] for r in got][3:5] == ["a/b", "x/y"] and got[5]["r"] == "k.rs"
    assert [r["s"] for r in got] == [".c", ".c", "", "", "", ".rs", "", ".gz", "", None]
    assert got[0]["l"] == "c" and got[5]["l"] == "rust" and got[9]["l"] is None
    kept = df.where(P.in_scope(p, ["src/", " srcx"], ["src/a.c"])).collect()
    assert [r["p"] for r in kept] == ["srcx/a.c", "src"]


def test_places_are_a_total_order(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v long")
    got = search.in_order(df, [F.col("v")]).collect()
    assert sorted((r["place"], r["v"]) for r in got) == [(i + 1, i) for i in range(50)]


def test_ancestors_stop_at_the_root(spark):
    commits = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 1), (4, 2)], "id long, parent_id long")
    assert {(r["id"], r["depth"]) for r in search.ancestors(commits, 4).collect()} == {(4, 0), (2, 1), (1, 2), (0, 3)}
    merged = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)] + [(29, 3)], "id long, parent_id long")
    got = {r["id"]: r["depth"] for r in search.ancestors(merged, 29).collect()}
    assert got == {i: 29 - i if i > 3 else 1 + 3 - i for i in range(30)}
    assert search.ancestors(commits, 99).count() == 0


def test_running_sums_of_a_hot_group(spark):
    from tallyloom.operators.running import running_sum

    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 500, i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {(r["g"], r["o"]): r["before"] for r in running_sum(df, "g", [F.col("o")], "v", "before").collect()}
    total = Counter()
    for g, o, v in sorted(rows):
        assert got[g, o] == total[g]
        total[g] += v
    assert len(got) == len(rows)


def test_overlaps_by_blocks_of_works(spark):
    """Hot values, repeated ones and nulls, over several blocks; pairs are summed where they meet, never shuffled or joined by target."""
    rows = [(f"w{w}", f"p{w % 3}", b, 0) for w in range(150) for b in ["every", f"x{w % 7}", f"y{w // 2}", *["twice"] * (w % 3)]] + [("w1", "p", None, 0), ("w2", "p", None, 0)]
    own = spark.createDataFrame(rows, "work_id string, path string, blob string, ord long").cache()
    held = {}
    for w, p, b, _ in rows:
        if b is not None:
            held.setdefault(w, []).append((p, b))
    wanted = {}
    for t, mine in held.items():
        for c, other in held.items():
            if t != c:
                both = Counter(b for _, b in mine) & Counter(b for _, b in other)
                wanted[t, c] = (both.total(), len(both), max(0, both.total() - (Counter(mine) & Counter(other)).total()))
    total = bags.works_of(own)
    full = bags.containment(bags.overlaps(bags.counts(own, "blob"), "blob", works=total), total)
    assert "hashpartitioning(target" not in full._jdf.queryExecution().executedPlan().toString()
    assert {(r.target, r.candidate): (r.shared, r.shared_unique) for r in full.collect()} == {k: v[:2] for k, v in wanted.items()}
    moved = search.all_relocated(own)
    assert {(r.target, r.candidate): r.relocated for r in moved.collect()} == {k: v[2] for k, v in wanted.items()}


def test_rows_of_all_pairs_are_shuffled_once(spark, monkeypatch):
    """Neither counts nor pairs are shuffled to meet names and totals of works, whatever Spark thinks of their size."""
    rows = [(f"w{w}", f"p{w % 3}", f"b{w % 5}", 0) for w in range(60)]
    own = spark.createDataFrame(rows, "work_id string, path string, blob string, ord long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        total = bags.works_of(own)
        full = bags.containment(bags.overlaps(bags.single(own, "blob"), "blob", works=total), bags.beside(total))
        for found in (full, search.all_relocated(own)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2
        few = full.count()
        monkeypatch.setattr(bags, "MOST_BYTES", 0)  # more works than may be broadcast: all is shuffled, and the same
        shuffled = bags.containment(bags.overlaps(bags.single(own, "blob"), "blob", works=total), bags.beside(total))
        assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert shuffled.exceptAll(full).isEmpty() and shuffled.count() == few == 60 * 11
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_in_few_bytes_stay_apart(spark):
    keys = ["ab", "AB", "aB", "abc", "0abc", "0ABC", "", "\1\xab", "\xab", "b", "0b", "zz", "ff" * 32, "é", "ab ", " ab"]
    rows = [(w, k) for w in ("l", "r") for k in keys] + [("l", None), ("r", None)]
    got = bags.overlaps(bags.single(spark.createDataFrame(rows, "work_id string, blob string"), "blob"), "blob").collect()
    assert {(r.target, r.candidate, r.shared, r.shared_unique) for r in got} == {("l", "r", len(keys), len(keys)), ("r", "l", len(keys), len(keys))}
    twice = bags.overlaps(bags.single(spark.createDataFrame([("l", 1), ("r", 1), ("r", 2)], "work_id string, blob long"), "blob"), "blob")
    assert {r.shared for r in twice.collect()} == {1}


def test_rows_without_a_path_share_content_alone(spark):
    rows = [("l", None, "x"), ("l", "p", "x"), ("r", None, "x"), ("r", "p", "x"), ("r", "q", None)]
    got = search.all_relocated(spark.createDataFrame(rows, "work_id string, path string, blob string")).collect()
    assert {(r.target, r.candidate, r.relocated) for r in got} == {("l", "r", 1), ("r", "l", 1)}
