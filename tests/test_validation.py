"""Validation of a whole case unites every family that is written."""

import pytest

from tallyloom import cases
from tallyloom.operators import evidence
from tallyloom.sources.adapters import RELATIONS


def test_every_family_of_a_case(spark):
    form = ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in RELATIONS["documents_md"][1]) + ", ref string"
    text = "# T\n## A\nx"
    docs = [(1, "modules/a.md", "module", "absent", "novel", "", "memory", "w", "", text, "r1"), (2, "base.md", "base", "absent", "novel", "", "memory", "w", "", text, "r2"), (3, "report.md", "report", "absent", "novel", "", "memory", "w", "", text, "r1")]
    docs = spark.createDataFrame(docs, form)
    cards = spark.createDataFrame([], "n long, evidence_id string, kind string, title string, source_name string, source_path string, raw_sha string, excerpt string, fact string, columns int, cells int")
    given = {
        "works": spark.createDataFrame([("w", "Name")], "work_id string, display_name string"),
        "manifest": spark.createDataFrame([("w", "", "r1")], "work_id string, locked_commit string, locked_ref string"),
        "reviewed": spark.createDataFrame([("w", "old", "unresolved")], "work_id string, reviewed string, state string"),
        "sections": (spark.createDataFrame([("w", "finding", True)], "work_id string, contract string, shown boolean"), spark.createDataFrame([], "work_id string, contract string")),
        "present": ["absent.md"],
        "graph": "report.md",
    }
    run = lambda **more: sorted(r["code"] for r in cases.validate(docs, evidence.with_tables(cards), ["A"], ["A"], "Z", {"memory": []}, **more).collect())
    assert run(**given) == [
        "architecture_graph.missing_mermaid",
        "base.target_ref_mismatch",
        "contradiction.review_stale",
        "contradiction.unresolved",
        "identity.report_title",
        "optional_section.missing_public",
        "structure.missing_file",
    ]
    with pytest.raises(ValueError):
        run(path="base.md", present=["absent.md"])
