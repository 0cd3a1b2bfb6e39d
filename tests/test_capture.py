"""Cards from what they point at, result records, and the files of cases."""

import io
import json
import zipfile
import zlib

import pytest

from tallyloom.operators import capture, case_rules, results, search
from tallyloom.sources import cases as case_files
from tallyloom.sources import documents

BLOBS = "work_id string, display_name string, commit string, path string, object_hash string, text string"


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [("w", "Work", "c1", "src/a.c", "h1", "one\r\ntwo token\nthree\n"), ("w", "Work", "c1", "src/b/c.rs", "h2", "token x token"), ("w", "Work", "c1", "docs/d.md", "h3", "nothing")]
    return spark.createDataFrame(rows, BLOBS)


def by_n(df):
    return {r["n"]: r for r in df.collect()}


def test_spans(spark, blobs):
    asked = [(1, " t ", "w", "c1", "src/a.c", "2:3"), (2, "t", "w", "c1", "src/a.c", "3"), (3, "t", "w", "c1", "src/a.c", "3:4"), (4, "t", "w", "c1", "src/a.c", "3:2"), (5, "t", "w", "c1", "none", "1"), (6, "t", "w", "c1", "src/a.c", "0"), (7, "t", "w", "c1", "src/b/c.rs", "2")]
    got = by_n(capture.span_cards(spark.createDataFrame(asked, "n long, title string, work_id string, commit string, path string, lines string"), blobs))
    assert {n: r["problem"] for n, r in got.items()} == {1: "", 2: "", 3: "past the end: 3 lines", 4: "bad line range", 5: "nothing there", 6: "bad line range", 7: ""}
    assert (got[1]["title"], got[1]["excerpt"], got[2]["excerpt"], got[7]["excerpt"]) == ("t", "two token\nthree", "three", "x token")
    source = got[1]["source"]
    assert (source["locator"], source["line_start"], source["line_end"], source["object_hash"]) == ("L2-L3", 2, 3, "h1")


def test_ids_of_cards(spark, blobs):
    asked = [(1, "a", "w", "c1", "src/a.c", "1"), (2, "other title", "w", "c1", "src/a.c", "1"), (3, "b", "w", "c1", "src/a.c", "2"), (4, "bad", "w", "c1", "src/a.c", "9")]
    cards = capture.span_cards(spark.createDataFrame(asked, "n long, title string, work_id string, commit string, path string, lines string"), blobs)
    log = capture.empty_log(cards)
    first = capture.append_cards(log, cards)
    assert [(r["evidence_id"], r["title"]) for r in first.orderBy("evidence_id").collect()] == [("E001", "a"), ("E002", "b")]
    assert capture.append_cards(first, cards).count() == 0
    later = first.selectExpr("'E999' AS evidence_id", *[c for c in first.columns if c != "evidence_id"]).limit(1)
    assert {r["evidence_id"] for r in capture.append_cards(later.where("title = 'a'"), cards).collect()} <= {"E1000", "E1001"}


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r><w:r><w:tab/><w:t>end</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        held.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{table}{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    raw = [o.encode() for o in objects]
    for i, lines in enumerate(pages):
        packed = zlib.compress(b"BT " + b" T* ".join(b"(" + x.encode("cp1252").replace(b"(", rb"\(").replace(b")", rb"\)") + b") Tj" for x in lines) + b" ET")
        raw.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode())
        raw.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(raw)) + b"trailer << /Root 1 0 R >>"


def test_documents(spark):
    files = [("w", "a.docx", "Work", "c", "h", None, docx("first", "second")), ("w", "b.pdf", "Work", "", None, "/x/b.pdf", pdf(["one (1)", "two"], ["x" * 13_000])), ("w", "c.md", "Work", "c", "h", None, "l1\nl2 \xff".encode("latin-1"))]
    parts = documents.read_parts(spark.createDataFrame(files, "work_id string, path string, display_name string, commit string, object_hash string, local string, content binary"))
    asked = [
        (1, "a.docx", None, 2, None),
        (2, "a.docx", None, 3, None),
        (3, "b.pdf", 1, None, None),
        (4, "b.pdf", 1, None, "2"),
        (5, "b.pdf", 2, None, None),
        (6, "b.pdf", 2, None, "1:1"),
        (7, "c.md", None, None, "2"),
        (8, "c.md", None, None, None),
        (9, "b.pdf", 9, None, None),
    ]
    requests = spark.createDataFrame([(n, "t", "w", p, page, par, lines) for n, p, page, par, lines in asked], "n long, title string, work_id string, path string, page int, paragraph int, lines string")
    got = by_n(capture.document_cards(requests, parts))
    assert {n for n, r in got.items() if r["problem"]} == {2, 5, 8, 9}
    assert [got[n]["excerpt"] for n in (1, 3, 4, 7)] == ["second\tend", "one (1)\ntwo", "two", "l2 �"]
    assert [got[n]["source"]["locator"] for n in (1, 3, 4, 7)] == ["paragraph 2", "P1", "P1:L2-L2", "L2-L2"]
    assert got[3]["raw_ref"]["path"] == "/x/b.pdf" and got[1]["raw_ref"] is None and len(got[6]["excerpt"]) == 13_000


def test_commits(spark):
    commits = spark.createDataFrame([("w", "Work", "c1", "p1 p2", "a", "t1", "b", "t2", "subject", " more \n")], "work_id string, display_name string, commit string, parents string, author string, author_time string, committer string, commit_time string, subject string, body string")
    numstat = spark.createDataFrame([("w", "c1", "src/a.c", "3", "1"), ("w", "c1", "src2/b.png", "-", "-"), ("w", "c1", "doc.md", "5", "0")], "work_id string, commit string, path string, additions string, deletions string")
    requests = spark.createDataFrame([(1, "t", "w", "c1", None), (2, "t", "w", "c1", ["src/", "src"]), (3, "t", "w", "gone", None)], "n long, title string, work_id string, commit string, paths array<string>")
    got = by_n(capture.commit_cards(requests, commits, numstat))
    facts = {n: [f["value"] for f in got[n]["facts"]] for n in (1, 2)}
    assert facts[1] == ["p1, p2", "a", "t1", "b", "t2", "3", "8", "1"] and facts[2][5:] == ["1", "3", "1"]
    assert got[1]["excerpt"] == "subject\n\nmore" and got[2]["source"]["locator"] == "paths: src, src/" and got[3]["problem"]
    assert got[1]["table"]["rows"][0] == ["doc.md", "5", "0"]


def test_searches(spark, blobs):
    requests = spark.createDataFrame([(1, "t", "w", "c1", "tok[a-z]+", None), (2, "t", "w", "c1", "token", ["src/b"]), (3, "t", "w", "c1", "absent", None)], "n long, title string, work_id string, commit string, pattern string, paths array<string>")
    got = by_n(capture.search_cards(requests, blobs))
    assert [[f["value"] for f in got[n]["facts"]][2] for n in (1, 2, 3)] == ["3", "2", "0"]
    assert got[1]["table"]["rows"] == [["src/a.c:2", "two token"], ["src/b/c.rs:1", "token"], ["src/b/c.rs:2", "x token"]]
    assert got[3]["problem"] == "" and got[3]["table"]["rows"] == [] and "0" in got[3]["excerpt"]


BAG = "work_id string, path string, blob string"
SIDES = ({"work_id": "l", "display_name": "Left", "ref": "main", "commit": "a" * 40}, {"work_id": "r", "display_name": "Right", "ref": "", "commit": "b" * 40})


@pytest.fixture(scope="module")
def pair(spark):
    left = spark.createDataFrame([("l", "a/x", "1"), ("l", "a/y", "2"), ("l", "b/x", "3")], BAG)
    right = spark.createDataFrame([("r", "a/x", "1"), ("r", "c/z", "2"), ("r", "c/z", "2")], BAG)
    units = [spark.createDataFrame([(f"{s}/x", 1, f"f_{s}", 0, "s1"), (f"{s}/y", 2, "g", 1, "")], "path string, line int, symbol string, ord long, shape string") for s in ("a", "c")]
    return results.commit_pair(left, right, SIDES, ((("a/",), ()), ((), ("d",))), tuple(units))


def test_comparison_record_and_card(spark, pair):
    text = pair.first()["text"]
    found = json.loads(text)
    assert found["blob_overlap"]["content_instances"] == {"shared_instances": 2, "target_total_instances": 2, "candidate_total_instances": 3, "target_containment": 1.0, "candidate_containment": 0.666667, "balanced": 0.666667}
    assert found["blob_overlap"]["relocated_examples"] == [{"blob": "2", "left_paths": ["a/y"], "right_paths": ["c/z"]}]
    assert [x["blob"] for x in found["blob_overlap"]["right_residual_occurrences"]] == ["2"] and found["blob_overlap"]["left_residual_occurrences"] == []
    assert found["ast_overlap"]["renamed_or_relocated_instances"] == 1
    card = capture.comparison_cards(spark.createDataFrame([(1, "t", "facts.json", text), (2, "t", "x", '{"schema": "odd"}')], "n long, title string, path string, text string"))
    one, two = (by_n(card)[n] for n in (1, 2))
    assert [f["value"] for f in one["facts"]] == ["Left", "Right", "main@" + "a" * 12, "b" * 12, "包含 a", "排除 d", "2", "3", "2", "1.0", "0.666667", "1", "1", "2", "1", "1"]
    assert one["table"]["rows"] == [["Blob 跨路径", "a/y", "c/z", "2"], ["AST 结构", "a/x:f_a", "c/x:f_c", "s1"]] and two["problem"]


def test_search_records_and_cards(spark):
    bag = spark.createDataFrame([("t", "p", "1"), ("t", "q", "2"), ("u", "p", "1"), ("v", "p", "9"), ("x", "p", "2")], BAG)
    units = spark.createDataFrame([("t", "s")], "work_id string, shape string")
    names = spark.createDataFrame([("u", "zeta", "c1"), ("x", "alpha", "c2")], "work_id string, display_name string, commit string")
    head = results.head_result(search.head_candidates(bag, units, ["t"], 30, names), {"work_id": "t", "display_name": "T", "commit": "h"}).first()["text"]
    assert [c["work_id"] for c in json.loads(head)["candidates"]] == ["x", "u", "v"]
    history = spark.createDataFrame([("u", "1"), ("u", "2"), ("v", "1"), ("x", "2")], "work_id string, object_id string")
    found = search.history_search(bag.where("work_id = 't'"), history, "t", 30, names)
    past = results.history_result(found, {"work_id": "t", "display_name": "T", "commit": "h"}, ("src",)).first()["text"]
    assert [(c["work_id"], c["target_history_containment"]) for c in json.loads(past)["candidates"]] == [("u", 1.0), ("x", 0.5), ("v", 0.5)]
    cards = by_n(capture.result_cards(spark.createDataFrame([(1, "t", "a", head), (2, "t", "b", past), (3, "t", "c", "{}")], "n long, title string, path string, text string")))
    assert cards[1]["table"]["rows"][0] == ["alpha", "c2", "0.5", "0.0"] and cards[2]["table"]["rows"][0][2:] == ["1.0", "2"]
    assert cards[1]["source"]["display_name"] == cards[2]["source"]["display_name"] == "T" and cards[3]["problem"]
    assert [f["value"] for f in cards[2]["facts"]][1] == "3"


def test_reuse_of_snapshots(spark):
    snapshots = spark.createDataFrame([("a", "1", ["blob", "ast"], "v1"), ("b", "1", ["blob"], None), ("c", "1", ["blob", "ast"], "v0")], "work_id string, commit string, components array<string>, shape_version string")
    wanted = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "work_id string, commit string")
    assert [r["work_id"] for r in results.reusable(snapshots, wanted).collect()] == ["a"]
    assert sorted(r["work_id"] for r in results.reusable(snapshots, wanted, components=("blob",)).collect()) == ["a", "b", "c"]


def test_case_files(spark, tmp_path):
    works = spark.createDataFrame([("w", 2024, "S", "T", "N", "S-N", "repos/w", "competition", "", ["m"], "main")], "work_id string, year int, school string, team string, work_name string, display_name string, canonical_dir string, repository_type string, reference_kind string, module_ids array<string>, review_branch string")
    states = spark.createDataFrame([("w", "/r/w", "main", "c1", "t1")], "work_id string, path string, current_branch string, commit string, tree string")
    manifests = results.case_manifests(works, states)
    root = str(tmp_path / "cases")
    assert case_files.put_records(manifests, root, "case_state/manifest.json") == 1
    case_files.touch(spark, f"{root}/w/evidence.jsonl")
    case_files.put_text(spark, f"{root}/w/modules/m.md", "---\ncontract: module_review\nstatus: absent\n---\n# T\n")
    case_files.put_text(spark, f"{root}/w/identity.md", "---\ncontract: identity\nwork_id: w\ndisplay_name: S-N\n---\n")
    case_files.put_text(spark, f"{root}/w/identity.md", "---\ncontract: identity\nwork_id: w\ndisplay_name: S-N2\n---\n")
    held = case_files.read_cases(spark, root)
    assert sorted(r["path"] for r in held.collect()) == ["case_state/manifest.json", "evidence.jsonl", "identity.md", "modules/m.md"]
    tags = results.tags(case_rules.parsed(held))
    row = json.loads(tags.first()["text"])
    assert (row["display_name"], row["module_summary"]["absent"], row["risk_tags"], row["base"]["ref"]) == ("S-N2", 1, [], "")
    entry = json.loads(results.index(tags).first()["text"])
    assert entry["public_paths"]["html"] == "reports/w/report.html" and tuple(results.index_counts(tags).first()) == (1, 0)
    snapshots = spark.createDataFrame([("w", "c1", "/cache/w", "v1")], "work_id string, commit string, path string, shape_version string")
    assert json.loads(results.fingerprint_bindings(manifests, snapshots).first()["text"])["path"] == "/cache/w"
    tree = spark.createDataFrame([("w", "src/a.C"), ("w", "top"), ("w", ".github/x.yml")], "work_id string, path string")
    inventory = results.inventory_records(tree).first()
    assert json.loads(inventory["text"]) == {"work_id": "w", "file_count": 3, "suffixes": {"<none>": 1, ".c": 1, ".yml": 1}, "top_level_dirs": ["src"]} and "`src/`" in inventory["markdown"]


def test_publish(spark, tmp_path):
    for name in ("assets/index.html", "assets/js/app.js", "site/report.html"):
        case_files.put_text(spark, f"{tmp_path}/{name}", name)
    case_files.publish(spark, f"{tmp_path}/assets", f"{tmp_path}/site", f"{tmp_path}/out/w")
    assert sorted(str(p.relative_to(tmp_path / "out/w")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")) == ["index.html", "js/app.js", "report.html"]
    with pytest.raises(FileNotFoundError):
        case_files.publish(spark, f"{tmp_path}/none", f"{tmp_path}/site", f"{tmp_path}/out/w")
