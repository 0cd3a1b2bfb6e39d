"""Whole cases: compiled reports against a plain twin, and documents that must not stop the job."""

import json
import os
import re
from collections import defaultdict

import pytest
import yaml

from tallyloom.operators import case_rules, markdown, report
from tallyloom.plans import registry
from tallyloom.sources.adapters import relation
from tallyloom.sources.files import CARDS

TABLES = "/root/testdata/sf0.001"
# Fixed values, as the reports' readers know them.
VIEWS = {"整体结论": "overview", "重点结论": "overview", "真实工作量分层": "lineage", "Base、其他来源与同届传播关系": "lineage", "内核架构图": "architecture", "模块实现细节及 Base 差异": "modules"}
RISK = ("文档声明审查", "开发历史与 AI 使用", "测评定向与结果真实性")
CITED = r"\[@(E\d{3,})\]"


def slug(text):
    return re.sub(r"[^a-z0-9一-鿿-]+", "", re.sub(r"\s+", "-", text.strip().lower())) or "section"


def split(text):
    if text.startswith("---\n") and (end := text.find("\n---", 4)) >= 0:
        return yaml.safe_load(text[4:end]) or {}, text[text.find("\n", end + 1) + 1 :]
    return {}, text


def heads(body):
    rows, found = body.splitlines(), []
    for k, line in enumerate(rows):
        if m := re.match(r"^(#{1,6})\s+(.+?)\s*$", line):
            found.append((len(m[1]), m[2], k))
    return rows, found


def plain_report(files, titles):
    front, body = zip(*(split(files.get(p, "")) for p in ("identity.md", "base.md", "report.md")))
    cards = {}
    for line in files.get("evidence.jsonl", "").splitlines():
        card = json.loads(line)
        cards.setdefault(card["evidence_id"], card)
    rows, found = heads(body[2])
    tops = [h for h in found if h[0] == 2]
    sections, cites = [], defaultdict(list)

    def cite(e, *place):
        if place not in cites[e]:
            cites[e].append(place)

    for k, (_, title, at) in enumerate(tops):
        text = "\n".join(rows[at : tops[k + 1][2] if k + 1 < len(tops) else len(rows)]).strip()
        ids = sorted(set(re.findall(CITED, text)))
        sections.append({"id": slug(title), "title": title, "markdown": text, "evidence_ids": ids})
        for e in ids:
            cite(e, "report.md", title, title, VIEWS.get(title, "risk" if title in RISK else "evidence"), slug(title))
    modules = []
    for path in sorted(p for p in files if p.startswith("modules/")):
        own, text = split(files[path])
        title = str(own.get("module_title") or titles.get(own["module_id"], own["module_id"]))
        modules.append({"module_id": own["module_id"], "title": title, **{c: own[c] for c in ("status", "originality", "base_delta")}, "markdown": text, "evidence_ids": sorted(set(re.findall(CITED, text)))})
        rows, found = heads(text)
        inside = set()
        for k, (_, name, at) in enumerate(found):
            ids = set(re.findall(CITED, "\n".join(rows[at + 1 : found[k + 1][2] if k + 1 < len(found) else len(rows)])))
            inside |= ids
            for e in ids:
                cite(e, path, name, title, "modules", f"module-{slug(own['module_id'])}")
        for e in set(re.findall(CITED, text)) - inside:
            cite(e, path, title, title, "modules", f"module-{slug(own['module_id'])}")
    shown = []
    for e in sorted(set(cites) & set(cards), key=lambda e: int(e[1:])):
        card = dict(cards[e])
        if card.pop("raw_ref", None) and card["kind"] in ("fingerprint_comparison", "search_result"):
            card["source"] = card["source"] | {"path": ""}
        shown.append(card | {"references": [dict(zip(("document", "section", "label", "view", "anchor"), p)) for p in cites[e]]})
    public = lambda p: (f := split(files.get(p, ""))[0]).get("status") == "findings" and str(f.get("public", "true")).lower() != "false"
    names = {"status": "status", "display_name": "selected_base_display_name", "source_ref": "selected_base_ref", "source_commit": "selected_base_commit"} | {c: c for c in ("target_review_ref", "target_review_commit", "target_introduction_commit", "direction", "confidence")}
    return {
        "generated_by": "report_data_compiler",
        "schema": "report_data.v3",
        "identity": {c: str(front[0].get(c, "")) for c in ("work_id", "display_name", "school", "team", "work_name")},
        "base": {k: str(front[1].get(c, "")) for k, c in names.items()},
        "sections": sections,
        "modules": modules,
        "evidence": shown,
        "optional_sections": {"doc_claim": public("findings/doc-claims.md"), "cheat": public("findings/cheat.md"), "ai": public("findings/history-ai.md")},
    }


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")
def test_reports_of_all_cases(spark):
    files = defaultdict(dict)
    for r in relation(spark, TABLES, "case_files").collect():
        files[r.case_id][r.path] = r.text
    got = {r.case_id: r for r in registry.QUERIES["case_reports"](spark, TABLES).collect()}
    assert set(got) == set(files)
    for case, own in files.items():
        want, found = plain_report(own, {"memory": "Memory", "scheduler": "Scheduling"}), json.loads(got[case].report)
        for m in found["modules"]:
            assert m.pop("anchors") == [p for p in dict.fromkeys(re.findall(r"`(src/./a\.rs)`", m["markdown"]))]
        assert found == want
        assert [json.loads(x) for x in got[case].evidence.splitlines()] == want["evidence"]


def test_a_case_without_anything_but_an_identity(spark):
    files = spark.createDataFrame([("c", "identity.md", "---\ncontract: identity\nwork_id: c\n---\n"), ("d", "report.md", "## x [@E001]\n")], "case_id string, path string, text string")
    rows = report.case_reports(files, case_rules.in_case(case_rules.parsed(files)), {}, CARDS).collect()
    assert len(rows) == 1 and rows[0].evidence == ""
    assert (r := json.loads(rows[0].report))["sections"] == r["modules"] == r["evidence"] == [] and r["base"]["status"] == ""


BAD = ["date: 2026-13-45", "a: " + "[" * 3000, "x: !!python/object:os.system y", "a: b: c"]


@pytest.mark.parametrize("front", BAD)
def test_one_bad_front_matter_is_one_issue(spark, front):
    """Bad values, nesting too deep and bad syntax are the document's own problem; the others are judged as ever."""
    rows = [("c", f"modules/m{k}.md", "---\ncontract: module_review\nmodule_id: memory\n---\n# A\n") for k in range(5)]
    files = spark.createDataFrame([*rows, ("c", "modules/bad.md", f"---\n{front}\n---\n# A\n")], "case_id string, path string, text string")
    found = case_rules.document_issues(case_rules.parsed(files), {"memory": []}).collect()
    assert [r.path for r in found if r.code == "structure.parse_error"] == ["modules/bad.md"]
    assert {r.path for r in found} == {r[1] for r in rows} | {"modules/bad.md"}
    docs = spark.createDataFrame([(1, f"---\n{front}\n---\nbody"), (2, "---\ncontract: x\n---\nbody")], "id long, text string")
    assert {r.id: (r.contract, r.body) for r in markdown.frontmatter(docs, "text").collect()} == {1: ("", "body"), 2: ("x", "body")}


def test_front_matter_ends_where_the_first_line_of_hyphens_begins(spark):
    texts = ["---\na: 1\n---\nb", "---\na: 1\n---more\nb\nc", "---\n---\nb", "---\n\n---\nb", "---\na: 1\n---", "---\na: 1\n", "--- \na: 1\n---\nb", "", "---\na: '\n---\n'\n---\nb"]
    files = spark.createDataFrame([("c", f"f{k}.md", t) for k, t in enumerate(texts)], "case_id string, path string, text string")
    got = {r.path: (dict(r.fields), r.body) for r in case_rules.parsed(files).collect()}
    for k, t in enumerate(texts):
        try:
            front, body = split(t) if t != "---\na: 1\n---" else ({"a": 1}, t)
            want = ({str(a): str(b) for a, b in front.items()}, body)
        except yaml.YAMLError:
            want = ({}, "")
        assert got[f"f{k}.md"] == want, t


def test_a_path_given_twice_counts_once(spark):
    files = spark.createDataFrame([("c", "base.md", "x"), ("c", "base.md", "x"), ("c", "identity.md", "y")], "case_id string, path string, text string")
    assert len(case_rules.material(files).first().files) == 2


def test_documents_lie_in_files_for_all_cores_and_are_not_dealt_again(spark):
    """Families read the parsed documents where they were written; headings are of lines split once."""
    from tallyloom.functions import texts
    from tallyloom.operators import case_rules
    from tallyloom.plans import wholecases

    docs = wholecases.case_files(spark, "/root/testdata/sf0.001")[1]
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    some = spark.createDataFrame([("a", "report.md", "", "final_report", {}, None, "# T\n#no\n ## indented\n## S ### deep  \ntext\n#\tx")], "case_id string, path string, problem string, contract string, fields map<string,string>, public boolean, body string")
    plan = case_rules.headings(some)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    got = case_rules.headings(some).first()
    assert [(h.line, h.level, h.title, h.body) for h in got.heads] == [(1, 1, "T", "#no\n ## indented"), (4, 2, "S", ""), (5, 3, "deep", "text"), (7, 1, "x", "")]
    assert [tuple(h) for h in some.select(texts.headings("body").alias("h")).first().h] == [(1, 1, "T"), (4, 2, "S"), (5, 3, "deep"), (7, 1, "x")]
