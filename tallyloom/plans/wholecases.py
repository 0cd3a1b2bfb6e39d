"""Queries over whole cases: the issues of all their files, their references and compiled reports.

A case stands for a customer: its own documents come from `customer`, its module reviews from `orders`. Most documents depart from their contracts in one of the ways that the SQL names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import case_rules, report, rules
from tallyloom.operators.cuts import durable
from tallyloom.plans.registry import query
from tallyloom.sources.adapters import RELATIONS, UNIONS, relation
from tallyloom.sources.files import CARDS

TAXONOMY = {"memory": ["paging", "heap"], "scheduler": ["runqueue"]}
TITLES = {"memory": "Memory", "scheduler": "Scheduling"}
HASH = "abcdef1234567"
_CHEAT, _CLAIMS = case_rules.SECTION_OF["findings/cheat.md"], case_rules.SECTION_OF["findings/doc-claims.md"]
_LF = "|| chr(10) ||"


def _lines(*parts: str) -> str:
    """SQL text of lines; a part is SQL and gives its own line feed."""
    return " || ".join(parts)


def _line(text: str) -> str:
    return f"'{text}' || chr(10)"


def _when(test: str, then: str, other: str = "''") -> str:
    return f"CASE WHEN {test} THEN {then} ELSE {other} END"


def _heads(names, skip: dict[str, str] | None = None) -> list[str]:
    return [_when(skip[n], "''", _line(f"## {n}") + " || " + _line("text of it")) if skip and n in skip else _line(f"## {n}") + " || " + _line("text of it") for n in names]


_S = "c_custkey"
_FILE = {"case_id": f"'w' || CAST({_S} AS STRING)"}
_BASE_FIELDS = {
    "status": "'accepted'", "target_review_ref": _when(f"{_S} % 19 = 0", "'dev'", "'main'"), "target_review_commit": _when(f"{_S} % 7 = 0", "'zzz'", f"'{HASH}'"),
    "selected_base_work_id": "'b'", "selected_base_display_name": "'Base ' || c_name", "selected_base_ref": _when(f"{_S} % 6 = 0", "chr(34) || chr(34)", "'main'"), "selected_base_commit": f"'{HASH}'",
    "target_introduction_commit": f"'{HASH}'", "target_introduction_kind": _when(f"{_S} % 13 = 0", "'odd'", "'exact'"), "direction": "'from_base'", "confidence": _when(f"{_S} % 5 = 0", "'unsure'", "'high'"),
}
_GRAPH = _lines(_line("```mermaid"), _line("graph TD"), _line("```"))
_REPORT_OF = {
    case_rules.REPORT_BEFORE[1]: _lines(_line("see [@E001] and [@E003]"), _when(f"{_S} % 14 = 0", _line("and [@E009]")), _when(f"{_S} % 12 = 0", _line("#### deep") + " || " + _line("text"))),
    case_rules.GRAPH_SECTION: _when(f"{_S} % 8 = 0", _line("none"), _when(f"{_S} % 8 = 1", _lines(_GRAPH, _GRAPH), _GRAPH)),
    case_rules.MODULE_SECTION: _lines(_line("### memory"), _line("text [@E002] [@E001]")),
}


def _report_section(name: str) -> str:
    return _lines(_line(f"## {name}"), _REPORT_OF.get(name, _line("text [@E001]")))


_CARD = (
    '{{"evidence_id":"E00{n}","kind":"{kind}","title":"card {n}","source":{{"display_name":"source","path":"src/f{n}.c"}},"excerpt":"x","facts":[{{"label":"n","value":"{n}"}}]{raw}}}'
)
_RAW = ',"raw_ref":{"path":"raw/%d.json","sha256":"aa"}'
_LOG = [
    _CARD.format(n=n, kind=kind, raw=_RAW % n if raw else "").replace("{", "{{").replace("}", "}}")
    for n, (kind, raw) in enumerate([("source_span", 1), ("document_span", 0), ("fingerprint_comparison", 1), ("search_result", 1), ("search_result", 0), ("git_commit", 0)], start=1)
]

RELATIONS |= {
    "file_identity": ("customer", _FILE | {"path": "'identity.md'", "text": _lines(_line("---"), _line("contract: identity"), f"'work_id: w' || CAST({_S} AS STRING) || chr(10)", "'display_name: School-' || c_name || chr(10)", "'school: n' || CAST(c_nationkey AS STRING) || chr(10)", _line("team: t"), "'work_name: ' || c_name || chr(10)", _line("---"), _line("# Identity"))}, ""),
    "file_base": ("customer", _FILE | {"path": "'base.md'", "text": _lines(_line("---"), _line("contract: base_decision"), *[f"'{k}: ' || {v} || chr(10)" for k, v in _BASE_FIELDS.items()], _line("---"), _line("# Base"), *_heads(case_rules.HEADINGS["base_decision"]))}, f"{_S} % 11 <> 0"),
    "file_report": ("customer", _FILE | {"path": "'report.md'", "text": _lines(
        _line("---"), _line("contract: final_report"), _line("---"), _when(f"{_S} % 9 = 0", _line("# Other"), f"'# School-' || c_name || chr(10)"),
        *[_report_section(n) for n in case_rules.REPORT_BEFORE],
        _when(f"{_S} % 4 = 1", _lines(_line(f"## {_CLAIMS}"), _line("claims [@E005]"))), _when(f"{_S} % 2 = 0", _lines(_line(f"## {_CHEAT}"), _line("cheat [@E004]"))),
        _report_section(case_rules.MODULE_SECTION), _when(f"{_S} % 10 = 0", "''", _report_section(case_rules.EVIDENCE_SECTION)),
    )}, ""),
    "file_cheat": ("customer", _FILE | {"path": "'findings/cheat.md'", "text": _lines(_line("---"), _line("contract: finding_set"), _line("finding_type: cheat"), _line("status: findings"), _line("public: true"), _line("---"), _line("# Cheat"), *_heads(case_rules.HEADINGS["cheat"]))}, f"{_S} % 3 = 0"),
    "file_claims": ("customer", _FILE | {"path": "'findings/doc-claims.md'", "text": _lines(_line("---"), _line("contract: finding_set"), _line("finding_type: doc_claim"), _line("status: no_findings"), _line("public: false"), _line("---"), _line("# Claims"), *_heads(case_rules.HEADINGS["doc_claim"]))}, f"{_S} % 5 = 1"),
    "file_conflicts": ("customer", _FILE | {"path": "'issues/contradictions.md'", "text": _lines(_line("---"), _line("contract: contradiction_set"), "'status: ' || " + _when(f"{_S} % 16 = 0", "'unresolved'", "'resolved'") + " || chr(10)", _line("---"), _line("# Conflicts"), *_heads(case_rules.HEADINGS["contradiction_set"]))}, f"{_S} % 15 <> 0"),
    "file_log": ("customer", _FILE | {"path": "'evidence.jsonl'", "text": _lines(*[_line(card) for card in _LOG])}, ""),
    "file_modules": ("orders", {
        "case_id": "'w' || CAST(o_custkey AS STRING)",
        "path": "'modules/m' || CAST(o_orderkey AS STRING) || '.md'",
        "text": _lines(
            _line("---"), _line("contract: module_review"), "'module_id: ' || CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'scheduler' ELSE 'network' END || chr(10)",
            _when("o_orderkey % 4 = 0", "'module_title: Part ' || CAST((o_orderkey + o_custkey) % 20 AS STRING) || chr(10)"),
            "'status: ' || " + _when("o_orderkey % 6 = 0", "'absent'", "'partial'") + " || chr(10)", "'originality: ' || " + _when("o_orderkey % 5 = 0", "'odd'", "'adapted_minor'") + " || chr(10)", _line("base_delta: none"), _line("---"),
            _when("o_orderkey % 3 = 0", _line("before all [@E006] [@E002]")), "'# Module ' || CAST(o_orderkey AS STRING) || chr(10)",
            *[_lines(_line(f"## {h}"), "'text `src/' || o_orderstatus || '/a.rs` [@E00' || CAST(1 + (o_orderkey + o_custkey) % 2 AS STRING) || ']' || chr(10)" if k < 2 else _line("text of it")) for k, h in enumerate(case_rules.HEADINGS["module_review"])],
            _when("o_orderkey % 7 = 0", _lines(_line("### paging: x"), _line("again [@E003][@E003] then [@E001]"), _line("### paging: x"), _line("more [@E003]"))),
        ),
    }, ""),
}
RELATIONS["case_manifests"] = ("customer", _FILE | {"text": _when(f"{_S} % 18 = 1", "'{{broken'", f"""'{{{{"repo":{{{{"review_branch":"main","commit":"{HASH}"}}}}}}}}'""")}, f"{_S} % 18 <> 0")
RELATIONS["old_reviews"] = ("customer", _FILE | {"text": f"""'{{{{"schema":"x.{case_rules.REVIEW_SCHEMA}","status":"resolved","files":{{{{"a":"b"}}}},"digest":"x"}}}}'"""}, f"{_S} % 3 = 2")
UNIONS["case_files"] = ("file_identity", "file_base", "file_report", "file_cheat", "file_claims", "file_conflicts", "file_log", "file_modules")


def case_files(spark, d):
    """(case_id, path, text) of all cases, and their documents, parsed once.

    Files are dealt to all cores before they are parsed, so the written documents lie in as many files of like size.
    """
    files = relation(spark, d, "case_files")
    return files, durable(case_rules.in_case(case_rules.parsed(files)), "documents")


def _reviews(spark, d, files, docs):
    """The reviews that cases keep: of each third fresh ones, of each third outdated ones, of the rest none."""
    third = (F.substring("case_id", 2, 20).cast("long") % 3) == 0
    return case_rules.review_record(files.where(third), docs.where(third)).unionByName(relation(spark, d, "old_reviews"))


def _all_issues(spark, d):
    files, docs = case_files(spark, d)
    return case_rules.case_issues(files, relation(spark, d, "case_manifests"), _reviews(spark, d, files, docs), TAXONOMY, CARDS, docs=docs)


_of = lambda path, code, detail, where, table="customer": f"SELECT {_FILE['case_id'].replace('STRING', 'VARCHAR')} AS case_id, '{path}' AS path, '{code}' AS code, {detail} AS detail FROM {table} WHERE {where}"
_module = lambda code, detail, where: f"SELECT 'w' || o_custkey::VARCHAR AS case_id, 'modules/m' || o_orderkey::VARCHAR || '.md' AS path, '{code}' AS code, {detail} AS detail FROM orders WHERE ({where})"
_FINE, _THERE = "c_custkey % 18 > 1", "c_custkey % 11 <> 0"
_CONFLICTS = "issues/contradictions.md"
_RESOLVED = "c_custkey % 15 <> 0 AND c_custkey % 16 <> 0"
CASE_ISSUES_SQL = "\nUNION ALL ".join(
    [
        _of("base.md", "structure.missing_file", "''", "c_custkey % 11 = 0"),
        "SELECT 'w' || c_custkey::VARCHAR, 'modules', 'structure.missing_modules', '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
        _of("base.md", "structure.invalid_enum", "'confidence=unsure'", f"{_THERE} AND c_custkey % 5 = 0"),
        _of("base.md", "base.commit_missing", "'target_review_commit'", f"{_THERE} AND c_custkey % 7 = 0"),
        _of("base.md", "structure.empty_frontmatter", "'selected_base_ref'", f"{_THERE} AND c_custkey % 6 = 0"),
        _of("base.md", "base.introduction_kind", "'odd'", f"{_THERE} AND c_custkey % 13 = 0"),
        _of("base.md", "base.manifest_missing", "''", f"{_THERE} AND c_custkey % 18 = 0"),
        _of("base.md", "base.manifest_invalid", "''", f"{_THERE} AND c_custkey % 18 = 1"),
        _of("base.md", "base.target_ref_mismatch", "'main'", f"{_THERE} AND {_FINE} AND c_custkey % 19 = 0"),
        _of("base.md", "base.target_commit_mismatch", f"'{HASH}'", f"{_THERE} AND {_FINE} AND c_custkey % 7 = 0"),
        _of("report.md", "identity.report_title", "'Other'", "c_custkey % 9 = 0"),
        _of("report.md", "architecture_graph.missing_mermaid", f"'{case_rules.GRAPH_SECTION}'", "c_custkey % 8 = 0"),
        _of("report.md", "architecture_graph.multiple_mermaid", f"'{case_rules.GRAPH_SECTION}'", "c_custkey % 8 = 1"),
        _of("report.md", "structure.missing_heading", f"'{case_rules.EVIDENCE_SECTION}'", "c_custkey % 10 = 0"),
        _of("report.md", "structure.heading_depth", "'deep'", "c_custkey % 12 = 0"),
        _of("report.md", "evidence.unknown_ref", "'E009'", "c_custkey % 14 = 0"),
        _of("report.md", "optional_section.without_source", f"'{_CHEAT}'", "c_custkey % 3 <> 0 AND c_custkey % 2 = 0"),
        _of("report.md", "optional_section.missing_public", f"'{_CHEAT}'", "c_custkey % 3 = 0 AND c_custkey % 2 = 1"),
        _of("report.md", "optional_section.without_source", f"'{_CLAIMS}'", "c_custkey % 5 <> 1 AND c_custkey % 4 = 1"),
        _of("report.md", "optional_section.hidden_leak", f"'{_CLAIMS}'", "c_custkey % 5 = 1 AND c_custkey % 4 = 1"),
        _of(_CONFLICTS, "contradiction.missing", "''", "c_custkey % 15 = 0"),
        _of(_CONFLICTS, "contradiction.unresolved", "''", "c_custkey % 15 <> 0 AND c_custkey % 16 = 0"),
        _of(_CONFLICTS, "contradiction.review_missing", "''", f"{_RESOLVED} AND c_custkey % 3 = 1"),
        _of(_CONFLICTS, "contradiction.material_missing", "''", f"{_RESOLVED} AND c_custkey % 3 <> 1 AND c_custkey % 11 = 0"),
        _of(_CONFLICTS, "contradiction.review_stale", "'material'", f"{_RESOLVED} AND c_custkey % 3 = 2 AND c_custkey % 11 <> 0"),
        _module("structure.invalid_enum", "'originality=odd'", "o_orderkey % 5 = 0"),
        _module("taxonomy.unknown_module", "'network'", "(o_orderkey + o_custkey) % 3 = 2"),
        "SELECT 'w' || o_custkey::VARCHAR, 'modules/m' || o_orderkey::VARCHAR || '.md', 'taxonomy.unknown_node', unnest(['paging', 'paging']) FROM orders WHERE (o_orderkey + o_custkey) % 3 = 1 AND o_orderkey % 7 = 0",
        _module("structure.module_path_mismatch", "'m' || o_orderkey::VARCHAR", "true"),
    ]
)


@query(CASE_ISSUES_SQL)
def whole_case_issues(spark, d):
    """Every issue of every case: documents, presence, base lock, evidence, title, contradictions, optional sections, graph."""
    return _all_issues(spark, d)


@query(f"SELECT count(*) = 0 AS ok, count(*) AS issues FROM ({CASE_ISSUES_SQL})")
def whole_cases_ok(spark, d):
    """Whether all cases pass, over the union of every rule."""
    return rules.ok(_all_issues(spark, d))


_title = "CASE WHEN o_orderkey % 4 = 0 THEN 'Part ' || ((o_orderkey + o_custkey) % 20)::VARCHAR WHEN (o_orderkey + o_custkey) % 3 = 0 THEN 'Memory' WHEN (o_orderkey + o_custkey) % 3 = 1 THEN 'Scheduling' ELSE 'network' END"
_anchor = "'module-' || CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'scheduler' ELSE 'network' END"
_cited = lambda section, ids, place, where: f"SELECT 'w' || o_custkey::VARCHAR AS case_id, unnest([{ids}]) AS evidence_id, 'modules/m' || o_orderkey::VARCHAR || '.md' AS document, {section} AS section, {_title} AS label, 'modules' AS view, {_anchor} AS anchor, ({place})::INT AS place FROM orders WHERE ({where})"
_lifted = lambda title, ids, place, view, where="true": f"SELECT 'w' || c_custkey::VARCHAR AS case_id, unnest([{ids}]) AS evidence_id, 'report.md' AS document, '{title}' AS section, '{title}' AS label, '{view}' AS view, '{title}' AS anchor, ({place})::INT AS place FROM customer WHERE {where}"
_HEAD = case_rules.HEADINGS["module_review"]
_BEFORE = case_rules.REPORT_BEFORE
_SLUG = {t: "".join(c for c in t.lower().replace(" ", "-") if c.isascii() and (c.isalnum() or c == "-") or "一" <= c <= "鿿") for t in (*_BEFORE, *case_rules.REPORT_AFTER, _CHEAT, _CLAIMS)}
REFERENCES_SQL = "\nUNION ALL ".join(
    [
        *[_cited(f"'{h}'", "'E00' || (1 + (o_orderkey + o_custkey) % 2)::VARCHAR", 1 + k, "true") for k, h in enumerate(_HEAD[:2])],
        _cited("'paging: x'", "'E003', 'E001'", len(_HEAD) + 1, "o_orderkey % 7 = 0"),
        _cited(_title, "'E006'", f"{len(_HEAD) + 1} + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END", "o_orderkey % 3 = 0"),
        _cited(_title, "'E002'", f"{len(_HEAD) + 1} + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END", "o_orderkey % 3 = 0 AND (o_orderkey + o_custkey) % 2 = 0"),
        _lifted(_BEFORE[0], "'E001'", 0, "overview"),
        _lifted(_BEFORE[1], "'E001', 'E003'", 1, "overview"),
        _lifted(_BEFORE[1], "'E009'", 1, "overview", "c_custkey % 14 = 0"),
        _lifted(_BEFORE[2], "'E001'", 2, "lineage"),
        _lifted(_BEFORE[3], "'E001'", 3, "lineage"),
        _lifted(_CLAIMS, "'E005'", 5, "risk", "c_custkey % 4 = 1"),
        _lifted(_CHEAT, "'E004'", "5 + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END", "risk", "c_custkey % 2 = 0"),
        _lifted(case_rules.MODULE_SECTION, "'E002', 'E001'", "5 + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END", "modules"),
        _lifted(case_rules.EVIDENCE_SECTION, "'E001'", "6 + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END", "evidence", "c_custkey % 10 <> 0"),
    ]
)
_ANCHOR_SQL = "CASE " + " ".join(f"WHEN document = 'report.md' AND anchor = '{t}' THEN '{slug}'" for t, slug in _SLUG.items()) + " ELSE anchor END"


@query(f"SELECT * REPLACE ({_ANCHOR_SQL} AS anchor) FROM ({REFERENCES_SQL})")
def case_references(spark, d):
    """Where each case cites its evidence, by report section or module heading."""
    return report.case_references(case_files(spark, d)[1], TITLES)


@query()
def case_reports(spark, d):
    """The compiled report and public evidence of each case; tests/test_whole_cases.py has the plain twin."""
    return report.case_reports(*case_files(spark, d), TITLES, CARDS)
