"""One clean case, and for each code a case that differs from it in one thing."""

import json

import pytest

from tallyloom.operators import case_rules as rules
from tallyloom.sources.files import CARDS

TAXONOMY = {"memory": ["paging", "heap"], "scheduler": ["runqueue"]}
HASH = "abcdef1234567"


def page(front, heads, title="Title", tail=""):
    lines = ["---", *(f"{k}: {v}" for k, v in front.items()), "---", f"# {title}"]
    return "\n".join([*lines, *(f"## {h}\ntext of it" for h in heads)]) + "\n" + tail


BASE = {
    "contract": "base_decision",
    "status": "accepted",
    "target_review_ref": "main",
    "target_review_commit": HASH,
    "selected_base_work_id": "b",
    "selected_base_display_name": "B",
    "selected_base_ref": "main",
    "selected_base_commit": HASH,
    "target_introduction_commit": HASH,
    "target_introduction_kind": "exact",
    "direction": "from_base",
    "confidence": "high",
}
NO_BASE = BASE | {"status": "no_reliable_base", "target_introduction_kind": "unknown"} | dict.fromkeys(rules.OF_BASE, '""')
MODULE = {"contract": "module_review", "module_id": "memory", "status": "partial", "originality": "novel", "base_delta": "none"}
CHEAT = {"contract": "finding_set", "finding_type": "cheat", "status": "findings", "public": "true"}
GRAPH = "```mermaid\ngraph TD\n```"


def report(heads, graph=GRAPH, title="School-Work", detail="### memory"):
    own = {rules.GRAPH_SECTION: graph, rules.MODULE_SECTION: detail + "\ntext", rules.EVIDENCE_SECTION: "see [@E001]"}
    return f"---\ncontract: final_report\n---\n# {title}\n" + "\n".join(f"## {h}\n{own.get(h, 'text')}" for h in heads) + "\n"


REPORT = [*rules.REPORT_BEFORE, rules.SECTION_OF["findings/cheat.md"], *rules.REPORT_AFTER]
CARD = {"evidence_id": "E001", "kind": "source_span", "title": "t", "source": {"display_name": "s"}, "excerpt": "x", "facts": []}


def clean():
    return {
        "identity.md": page({"contract": "identity", "display_name": "School-Work"}, []),
        "base.md": page(BASE, rules.HEADINGS["base_decision"]),
        "report.md": report(REPORT),
        "modules/memory.md": page(MODULE, [*rules.HEADINGS["module_review"], rules.LINKED_SECTION], tail="### paging：x\n"),
        "findings/cheat.md": page(CHEAT, rules.HEADINGS["cheat"]),
        "issues/contradictions.md": page({"contract": "contradiction_set", "status": "resolved"}, rules.HEADINGS["contradiction_set"]),
        "evidence.jsonl": json.dumps(CARD) + "\n",
    }


MANIFEST = json.dumps({"repo": {"review_branch": "main", "commit": HASH}})
B, M, F, C, R = "base.md", "modules/memory.md", "findings/cheat.md", "issues/contradictions.md", "report.md"


def swap(path, a, b, n=1):
    def change(files):
        assert a in files[path], (path, a)
        files[path] = files[path].replace(a, b, n)

    return change


def put(path, text):
    return lambda files: files.__setitem__(path, text)


def drop(path):
    return lambda files: files.pop(path)


def base(heads=rules.HEADINGS["base_decision"], **fields):
    return put(B, page({k: v for k, v in (BASE | fields).items() if v is not None}, heads))


STALE = "contradiction.review_stale"
CHANGES = {
    "missing_file": (drop("identity.md"), ["contradiction.material_missing", "structure.missing_file"]),
    "missing_modules": (drop(M), ["structure.missing_modules"]),
    "parse_error": (swap(M, "module_id: memory", "module_id: [memory"), ["structure.parse_error"]),
    "missing_contract": (swap(M, "contract: module_review\n", ""), ["structure.contract_path_mismatch", "structure.missing_contract"]),
    "unknown_contract": (swap(M, "module_review", "odd"), ["structure.contract_path_mismatch", "structure.unknown_contract"]),
    "h1": (swap(M, "# Title\n", "# Title\n# Again\n"), ["structure.h1"]),
    "report_h1": (swap(R, "# School-Work\n", "# School-Work\n# Again\n"), ["structure.h1", "structure.report_h1"]),
    "missing_frontmatter": (base(direction=None), ["structure.empty_frontmatter", "structure.missing_frontmatter"]),
    "empty_frontmatter": (base(selected_base_ref='" "'), ["structure.empty_frontmatter"]),
    "missing_heading": (swap(M, "## 证据\ntext of it\n", ""), ["structure.missing_heading"]),
    "empty_heading": (swap(M, "## 适用范围\ntext of it", "## 适用范围\n "), ["structure.empty_heading"]),
    "deeper_text": (swap(M, "## 适用范围\ntext of it", "## 适用范围\n### part"), []),
    "heading_order": (base(heads=[*rules.HEADINGS["base_decision"]][::-1]), ["structure.heading_order"]),
    "report_heading_order": (put(R, report([REPORT[1], REPORT[0], *REPORT[2:]])), ["structure.report_heading_order"]),
    "unknown_h2": (swap(F, "## 结论", "## Odd\nx\n## 结论"), ["structure.unknown_h2"]),
    "report_unknown_h2": (put(R, report([*REPORT, "Odd"])), ["structure.report_heading_order", "structure.report_unknown_h2"]),
    "optional_heading_order": (put(M, page(MODULE, [rules.LINKED_SECTION, *rules.HEADINGS["module_review"]])), ["structure.optional_heading_order"]),
    "heading_depth": (swap(R, "### memory", "### memory\n#### deep"), ["structure.heading_depth"]),
    "module_h3_missing": (swap(R, "### memory", "memory"), ["structure.module_h3_missing"]),
    "invalid_enum": (swap(M, "status: partial", "status: odd"), ["structure.invalid_enum"]),
    "base_status": (base(status="odd"), ["structure.invalid_enum"]),
    "public_text": (swap(F, "public: true", 'public: "yes"'), ["structure.invalid_public"]),
    "public_of_none": (swap(F, "status: findings", "status: no_findings"), ["optional_section.hidden_leak", "structure.invalid_public"]),
    "unknown_finding_type": (swap(F, "finding_type: cheat", "finding_type: odd"), ["structure.finding_path_mismatch", "structure.unknown_finding_type"]),
    "invalid_output_path": (put("modules/x.md", page(BASE, rules.HEADINGS["base_decision"])), ["structure.contract_path_mismatch", "structure.invalid_output_path", "structure.module_path_mismatch"]),
    "module_path_mismatch": (swap(M, "module_id: memory", "module_id: scheduler"), ["structure.module_path_mismatch", "taxonomy.unknown_node"]),
    "unknown_module": (swap(M, "module_id: memory", "module_id: odd"), ["structure.module_path_mismatch", "taxonomy.unknown_module"]),
    "unknown_node": (swap(M, "paging：", "runqueue: "), ["taxonomy.unknown_node"]),
    "commit_missing": (base(selected_base_commit="abc"), ["base.commit_missing"]),
    "introduction_kind": (base(target_introduction_kind="odd"), ["base.introduction_kind"]),
    "no_base": (put(B, page(NO_BASE, rules.HEADINGS["base_decision"])), []),
    "unexpected_value": (put(B, page(NO_BASE | {"selected_base_ref": "main"}, rules.HEADINGS["base_decision"])), ["base.unexpected_value"]),
    "no_base_commit": (put(B, page(NO_BASE | {"target_review_commit": "abc"}, rules.HEADINGS["base_decision"])), ["base.commit_missing", "base.target_commit_mismatch"]),
    "target_ref": (base(target_review_ref="dev"), ["base.target_ref_mismatch"]),
    "fork_leak": (swap(F, "text of it", "see T2020260000001-1"), ["identity.platform_fork_leak"]),
    "bare_suffix": (swap(F, "text of it", "the 42作品"), ["identity.bare_suffix_name"]),
    "report_title": (put(R, report(REPORT, title="Other")), ["identity.report_title"]),
    "bad_card": (put("evidence.jsonl", json.dumps(CARD | {"kind": "odd"})), ["evidence.invalid", "evidence.unknown_ref"]),
    "no_json": (put("evidence.jsonl", json.dumps(CARD) + "\nnonsense\n"), ["evidence.invalid", "evidence.unknown_ref"]),
    "twice": (put("evidence.jsonl", (json.dumps(CARD) + "\n") * 2), ["evidence.invalid", "evidence.unknown_ref"]),
    "unknown_ref": (swap(F, "text of it", "as in [@E999]"), ["evidence.unknown_ref"]),
    "contradiction_missing": (drop(C), ["contradiction.missing"]),
    "unresolved": (swap(C, "status: resolved", "status: unresolved"), ["contradiction.unresolved"]),
    "material_missing": (drop("evidence.jsonl"), ["contradiction.material_missing", "evidence.unknown_ref"]),
    "status_changed": (swap(C, "status: resolved", "status: none"), [STALE, STALE]),
    "without_source": (drop(F), ["optional_section.without_source"]),
    "missing_public": (put(R, report([h for h in REPORT if h != rules.SECTION_OF["findings/cheat.md"]])), ["optional_section.missing_public"]),
    "missing_mermaid": (put(R, report(REPORT, graph="words")), ["architecture_graph.missing_mermaid"]),
    "multiple_mermaid": (put(R, report(REPORT, graph=GRAPH + "\n" + GRAPH)), ["architecture_graph.multiple_mermaid"]),
}
#: A change of the report leaves the review fresh, a change of anything else does not.
KEPT = {"report_h1", "report_heading_order", "report_unknown_h2", "heading_depth", "module_h3_missing", "report_title", "missing_public", "missing_mermaid", "multiple_mermaid", "contradiction_missing", "unresolved", "material_missing", "missing_file", "status_changed"}


@pytest.fixture(scope="module")
def found(spark):
    cases = {"clean": clean()}
    for name, (change, _) in CHANGES.items():
        cases[name] = clean()
        change(cases[name])
    cases["reviewed"] = clean()
    cases |= {k: clean() for k in ("no_manifest", "bad_manifest", "other_commit", "no_review", "bad_review", "other_schema", "no_files")}
    rows = [(name, path, text) for name, files in cases.items() for path, text in files.items()]
    files = spark.createDataFrame(rows, "case_id string, path string, text string")
    plain = spark.createDataFrame([("plain", p, t) for p, t in clean().items()], files.schema)
    review = rules.review_record(plain, rules.parsed(plain)).first()["text"]
    manifests = {name: MANIFEST for name in cases} | {"bad_manifest": "{", "other_commit": MANIFEST.replace(HASH, "1234567")}
    manifests.pop("no_manifest")
    reviews = {name: review for name in cases} | {"bad_review": "{", "other_schema": '{"schema": "x"}', "no_files": json.dumps(json.loads(review) | {"files": {}})}
    reviews.pop("no_review")
    frame = lambda found: spark.createDataFrame(list(found.items()), "case_id string, text string")
    issues = rules.case_issues(files, frame(manifests), frame(reviews), TAXONOMY, CARDS)
    one = rules.case_issues(files, frame(manifests), frame(reviews), TAXONOMY, CARDS, path="modules/memory.md")
    out = {}
    for which, df in (("all", issues), ("one", one)):
        for r in df.collect():
            out.setdefault((which, r["case_id"]), []).append(r["code"])
    return {k: sorted(v) for k, v in out.items()}


def test_clean_case(found):
    assert ("all", "clean") not in found and ("one", "clean") not in found


@pytest.mark.parametrize("name", CHANGES)
def test_each_change(found, name):
    want = CHANGES[name][1] + ([] if name in KEPT else [STALE])
    assert found.get(("all", name), []) == sorted(want)


def test_manifests_and_reviews(found):
    assert found["all", "no_manifest"] == ["base.manifest_missing"]
    assert found["all", "bad_manifest"] == ["base.manifest_invalid"]
    assert found["all", "other_commit"] == ["base.target_commit_mismatch"]
    assert found["all", "no_review"] == ["contradiction.review_missing"]
    assert found["all", "bad_review"] == found["all", "other_schema"] == found["all", "no_files"] == ["contradiction.review_invalid"]


def test_one_document_of_each_case(found):
    assert found["one", "missing_modules"] == ["structure.missing_file"] and found["one", "h1"] == ["structure.h1"]
    assert ("one", "fork_leak") not in found


def test_places(spark):
    docs = [("c", "../out.md", "module_review"), ("c", "/abs.md", ""), ("c", "modules/deep/x.md", "module_review"), ("c", "base.md", "module_review")]
    files = spark.createDataFrame([(c, p, page({"contract": k} if k else {}, [])) for c, p, k in docs], "case_id string, path string, text string")
    got = {}
    for r in rules.document_issues(rules.parsed(files), TAXONOMY).collect():
        got.setdefault(r["path"], set()).add(r["code"])
    places = {"structure.output_outside_case", "structure.invalid_output_path", "structure.contract_path_mismatch"}
    assert {p: got[p] & places for p in got} == {"../out.md": {"structure.output_outside_case"}, "/abs.md": {"structure.output_outside_case"}, "modules/deep/x.md": {"structure.invalid_output_path"}, "base.md": {"structure.invalid_output_path", "structure.contract_path_mismatch"}}


def test_cases_and_works(spark):
    works = spark.createDataFrame([("a", "repos/a"), ("b", "repos/b"), ("c", "repos/c")], "work_id string, canonical_dir string")
    states = spark.createDataFrame([("a", True, True), ("b", True, False)], "work_id string, there boolean, has_git boolean")
    assert sorted((r["case_id"], r["code"]) for r in rules.repositories(works, states).collect()) == [("b", "identity.not_git_repo"), ("c", "identity.repo_missing")]
    asked = spark.createDataFrame([("a",), ("z",)], "work_id string")
    assert [(r["case_id"], r["code"]) for r in rules.unknown_works(asked, works).collect()] == [("z", "identity.unknown_work")]
    cases, manifests = spark.createDataFrame([("x",), ("y",)], "case_id string"), spark.createDataFrame([("x", "{}")], "case_id string, text string")
    assert [(r["case_id"], r["code"]) for r in rules.without_manifest(cases, manifests).collect()] == [("y", "case.manifest_missing")]
    failed = rules.check_failed("x", ValueError("no"), cases).first()
    assert (failed["code"], failed["detail"]) == ("case.check_all_failed", "no")


def test_check_all(spark):
    from tallyloom import cases

    frame = lambda found: spark.createDataFrame(found, "case_id string, text string")
    files = spark.createDataFrame([("c", p, t) for p, t in clean().items()], "case_id string, path string, text string")
    review = rules.review_record(files, rules.parsed(files))
    built = []
    run = lambda build: [r["code"] for r in cases.check_all(files, frame([("c", MANIFEST)]), review, TAXONOMY, CARDS, build).collect()]
    assert run(built.append) == [] and len(built) == 1
    assert run(lambda _: 1 / 0) == ["case.check_all_failed"]
    assert [r["code"] for r in cases.check_all(files, frame([]), review, TAXONOMY, CARDS, built.append).collect()] == ["base.manifest_missing"] and len(built) == 1
