"""One broken document among good ones; registry entries and counts in history records and bindings."""

import io
import json
import zipfile

from tallyloom.operators import capture, results
from tallyloom.sources import documents


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_a_broken_file_is_its_own_problem(spark):
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    held = {"a.docx": docx("one", "two"), "b.docx": b"PK\3\4", "c.docx": empty.getvalue(), "d.pdf": b"%PDF-1.4\n1 0 obj<</Type/Page/Contents 2 0 R>>endobj 2 0 obj<</Filter/FlateDecode/Length 3>>stream\nxyz\nendstream endobj trailer<</Root 1 0 R>>", "e.txt": b"l1\nl2\n"}
    files = spark.createDataFrame([("w", p, "W", "c", None, None, bytearray(d)) for p, d in held.items()], "work_id string, path string, display_name string, commit string, object_hash string, local string, content binary")
    parts = documents.read_parts(files)
    problems = {r.path: r.problem for r in parts.collect()}
    assert problems["a.docx"] == problems["e.txt"] == "" and all(problems[p].startswith("can't be read") for p in ("b.docx", "c.docx"))
    asked = spark.createDataFrame([(1, "t", "w", "a.docx", None, 2, None), (2, "t", "w", "b.docx", None, 7, None), (3, "t", "w", "e.txt", None, None, "1:2"), (4, "t", "w", "no.txt", None, None, "1:1")], "n long, title string, work_id string, path string, page int, paragraph int, lines string")
    got = {r.n: (r.problem, r.excerpt) for r in capture.document_cards(asked, parts).collect()}
    assert got[1] == ("", "two") and got[2] == ("can't be read: BadZipFile", "") and got[3] == ("", "l1\nl2") and got[4][0] == "nothing there"


def test_history_records_have_the_registry_and_counts(spark):
    found = spark.createDataFrame([("t", "a", "A", 2, 3, 9, 0.333333), ("t", "b", "B", 1, 1, 9, 0.111111)], "target string, candidate string, display_name string, shared_unique long, shared long, target_total long, containment double")
    works = spark.createDataFrame([("a", 2024, "reference", "kernel", ["memory"], "main")], "work_id string, year int, repository_type string, reference_kind string, module_ids array<string>, review_branch string")
    matches = spark.createDataFrame([("a", "p", "x", 2), ("a", "q", "x", 1)], "candidate string, path string, blob string, n long")
    text = results.history_result(found, {"work_id": "t", "source_file_count": 9, "structural_unit_count": 4}, ("src",), works, matches).first()["text"]
    record = json.loads(text)
    assert record["target"]["source_file_count"] == 9 and record["target"]["structural_unit_count"] == 4
    a, b = record["candidates"]
    assert (a["year"], a["reference_kind"], a["module_ids"], a["review_ref"], a["matched_target_occurrences"]) == (2024, "kernel", ["memory"], "main", 3)
    assert (b["year"], b["repository_type"], b["module_ids"], b["matched_target_occurrences"]) == (0, "competition", [], 0)


def test_bindings_name_the_work(spark):
    manifest = json.dumps({"work": {"work_id": "w", "display_name": "W", "year": 2024, "module_ids": ["m"]}, "repo": {"commit": "c", "review_branch": "main"}})
    manifests = spark.createDataFrame([("w", manifest)], "case_id string, text string")
    snapshots = spark.createDataFrame([("w", "c", "/cache/w", "v1", ["blob"])], "work_id string, commit string, path string, shape_version string, components array<string>")
    got = json.loads(results.fingerprint_bindings(manifests, snapshots).first()["text"])
    assert {k: got[k] for k in ("work_id", "display_name", "year", "repository_type", "module_ids", "review_ref", "commit", "cache_dir", "blob", "structural")} == {
        "work_id": "w", "display_name": "W", "year": 2024, "repository_type": "competition", "module_ids": ["m"], "review_ref": "main", "commit": "c", "cache_dir": "/cache/w", "blob": "/cache/w/blob", "structural": "/cache/w/ast",
    }
