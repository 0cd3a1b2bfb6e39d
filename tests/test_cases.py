"""Whole tasks over small frames."""

import pytest
from pyspark.sql import functions as F

from tallyloom import cases
from tallyloom.operators import evidence
from tallyloom.sources.adapters import RELATIONS

BAG = "work_id string, path string, blob string"


def test_comparison_within_scopes(spark):
    left = spark.createDataFrame([("l", "a/x", "1"), ("l", "a/y", "2"), ("l", "b/x", "3")], BAG)
    right = spark.createDataFrame([("r", "a/x", "1"), ("r", "c/z", "2"), ("r", "c/z", "2")], BAG)
    row = cases.compare_commits(left, right, left_include=["a/"], right_exclude=["d"]).first()
    assert (row["left_total"], row["right_total"], row["shared"], row["path_aligned"], row["relocated"]) == (2, 3, 2, 1, 1)
    assert row["left_containment"] == 1.0 and row["right_containment"] == pytest.approx(2 / 3)
    units = spark.createDataFrame([("l", "a/x", "s"), ("l", "a/x", "")], "work_id string, path string, shape string")
    both = cases.compare_commits(left, right, units=(units, units)).first()
    assert (both["shape_shared"], both["shape_left_total"]) == (1, 1)
    empty = cases.compare_commits(left, right, left_include=["none"]).first()
    assert (empty["left_total"], empty["left_containment"]) == (0, 0.0)
    assert {(r["side"], r["path"]) for r in cases.residuals(left, right).collect()} == {("left", "b/x"), ("right", "c/z")}


def test_snapshots_of_asked_works(spark):
    tree = spark.createDataFrame([("a", "p.c", "x", "blob"), ("b", "q.md", "y", "blob")], "work_id string, path string, blob string, kind string")
    units = spark.createDataFrame([("a", "s")], "work_id string, shape string")
    got = cases.snapshot_build(tree, units, ["a", "a"]).collect()
    assert [(r["work_id"], r["files"], r["units"]) for r in got] == [("a", 1, 1)]
    with pytest.raises(ValueError):
        cases.snapshot_build(tree, units, ["nobody"])
    assert {(r["work_id"], r["suffix"]) for r in cases.inventory(tree).collect()} == {("a", ".c"), ("b", ".md")}


def test_validation_of_one_document(spark):
    form = ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in RELATIONS["documents_md"][1])
    good = (1, "modules/a.md", "module", "absent", "novel", "", "memory", "w", "", "# T\n## A\nx [@E001]")
    bad = (2, "modules/b.md", "odd", "absent", "novel", "", "memory", "w", "", "# T\n## A\nx [@E9999]")
    docs = spark.createDataFrame([good, bad], form)
    cards = spark.createDataFrame([(1, "E001", "source_span", "t", "s", "p", "", "x", "f", 1, 1)], "n long, evidence_id string, kind string, title string, source_name string, source_path string, raw_sha string, excerpt string, fact string, columns int, cells int")
    check = lambda path: sorted(r["code"] for r in cases.validate(docs, evidence.with_tables(cards), ["A"], ["A"], "Z", {"memory": []}, path=path).collect())
    assert check("modules/a.md") == [] and check(None) == ["evidence.unknown_ref", "structure.unknown_contract"]


def test_registry_issues(spark):
    columns = RELATIONS["works"][1]
    row = {c: "x" for c in columns} | {"year": 2024, "ord": 1, "repository_type": "competition", "reference_kind": "", "module_ids": ""}
    works = spark.createDataFrame([tuple(row[c] for c in columns)], ", ".join(f"{c} {'int' if c == 'year' else 'long' if c == 'ord' else 'string'}" for c in columns))
    assert cases.validate_works(works, []).count() == 0
    assert [r["detail"] for r in cases.validate_works(works.withColumn("school", F.lit(" ")), []).collect()] == ["school"]
