"""Costly steps run once a row: plans are looked at, as rows alone don't show it."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators import case_rules, code_units, headrecord, search
from tallyloom.plans import registry

TABLES = "/root/testdata/sf0.001"
PARSED = {"case_document_rules": 1, "case_documents_ok": 1, "case_presence": 0}


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", PARSED)
def test_documents_are_parsed_once_and_only_for_what_they_say(spark, name):
    assert plan(registry.QUERIES[name](spark, TABLES)).count("MapInArrow") == PARSED[name]


def test_a_text_is_split_once(spark):
    rows = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None), (4, "\n"), (5, "x\r\ny")], "id long, text string").select("id", T.lines(F.col("text")).alias("ls"))
    assert plan(rows).count("split(") == 1
    assert {r["id"]: r["ls"] for r in rows.collect()} == {1: ["a", "", "b"], 2: [], 3: [], 4: [""], 5: ["x", "y"]}


def test_presence_of_cases_without_modules_or_files(spark):
    files = spark.createDataFrame([("a", "base.md"), ("a", "modules/m.md"), ("a", "modules/n.md"), ("b", "modules/x/y.md"), ("b", "report.md"), ("b", "identity.md.txt")], "case_id string, path string")
    found = case_rules.presence(case_rules.marked(files), files.select("case_id").distinct())
    want = [("a", "identity.md"), ("a", "report.md"), ("b", "base.md"), ("b", "identity.md"), ("b", "modules")]
    assert sorted((r["case_id"], r["path"]) for r in found.collect()) == want


@pytest.mark.parametrize("name", ["call_resolution", "call_sets", "code_functions", "code_shapes"])
def test_sources_are_scanned_once(spark, name, monkeypatch):
    ran, scan = [], code_units.extract
    monkeypatch.setattr(code_units, "extract", lambda blobs: ran.append(scan(blobs)) or ran[-1])
    found = registry.QUERIES[name](spark, TABLES)
    assert len(ran) == 1 and plan(found).count("MapInArrow") == (0 if name.startswith("call_") else 1)  # 0: read from what is written


def test_directories_deal_only_units_of_shapes_that_a_target_has(spark):
    units = spark.createDataFrame([("a", "x/1.c", "s", 1), ("a", "y/2.c", "s", 2), ("b", "z", "s", 3), ("c", "z", "r", 4)], "work_id string, path string, shape string, ord int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "target string, candidate string")
    found = headrecord.directories(pairs, units, ["path", "ord"])
    assert "LeftSemi, (shape" in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "b", "x", 1, 1), ("a", "b", "y", 0, 1), ("a", "c", "x", 0, 1), ("a", "c", "y", 0, 1)]


def test_head_search_counts_only_values_that_a_target_holds(spark):
    bag = spark.createDataFrame([("a", "p", "x"), ("a", "q", "x"), ("b", "p", "x"), ("c", "p", "y")], "work_id string, path string, blob string")
    units = spark.createDataFrame([("a", "s"), ("b", "s")], "work_id string, shape string")
    found = search.head_candidates(bag, units, ["a"])
    assert "LeftSemi, (blob" in plan(found) and "LeftSemi, (shape" in plan(found)
    assert [(r["candidate"], r["blob_shared"], r["shape_shared"], r["score"]) for r in found.orderBy("rank").collect()] == [("b", 1, 1, 1.0), ("c", 0, 0, 0.0)]
