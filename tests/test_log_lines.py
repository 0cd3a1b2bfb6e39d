"""Numbered lines over many splits, and what is wrong with a log's lines."""

import json
import random

import pytest

from tallyloom.sources import files


@pytest.fixture
def small_splits(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "1"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(key)


def test_lines_are_numbered_as_a_plain_reader_does(spark, tmp_path, small_splits):
    rng = random.Random(3)
    lines = ["" if rng.random() < 0.1 else f"{k} " + "é" * rng.randrange(0, 90) for k in range(700)]
    at = tmp_path / "log"
    at.write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = files.numbered_lines(spark, str(at))
    assert got.rdd.getNumPartitions() > 50
    assert sorted((r.line, r.value) for r in got.collect()) == list(enumerate(lines, start=1))


def test_files_of_a_folder_go_on_by_name(spark, tmp_path, small_splits):
    for name, n in (("a", 40), ("b", 0), ("c", 75)):
        (tmp_path / name).write_text("".join(f"{name}{k:020}\n" for k in range(n)))
    got = sorted((r.line, r.value[0], int(r.value[1:])) for r in files.numbered_lines(spark, str(tmp_path)).collect())
    assert got == [(k + 1, "a", k) for k in range(40)] + [(k + 41, "c", k) for k in range(75)]


def test_a_problem_names_its_line(spark, tmp_path, small_splits):
    good = {"evidence_id": "E100", "kind": "source_span", "title": "t", "source": {"display_name": "s"}, "facts": [{"label": "a", "value": "b"}]}
    bad = {
        "json": "{", "object": "[1, 2]", "id": json.dumps(good | {"evidence_id": "E1"}), "kind": json.dumps(good | {"kind": "x"}), "title": json.dumps(good | {"title": "  "}), "source": json.dumps(good | {"source": {"path": "p"}}),
        "facts": json.dumps(good | {"facts": "no list"}), "table": json.dumps(good | {"table": {"columns": ["a"], "rows": [["1", "2"]]}}), "raw_ref": json.dumps(good | {"raw_ref": {"path": "p"}}), "duplicate": json.dumps(good),
    }
    lines, want = [json.dumps(good)], {}
    for k, (problem, line) in enumerate(bad.items()):
        lines += [json.dumps(good | {"evidence_id": f"E{1000 + 40 * k + i}"}) for i in range(rng_of(k))] + [""] + [line]
        want[len(lines)] = problem
    at = tmp_path / "evidence.jsonl"
    at.write_text("\n".join(lines) + "\n")
    assert {r.line: r.problem for r in files.check_log(spark, str(at)).collect()} == want


def rng_of(k):
    return (k * 7) % 30


def test_an_empty_log(spark, tmp_path):
    (tmp_path / "log").write_text("\n\n")
    assert files.check_log(spark, str(tmp_path / "log")).count() == 0
