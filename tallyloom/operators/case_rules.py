"""Contract rules of whole cases, from their files.

A case is a set of files (case_id, path, text); `parsed` reads the Markdown ones. The rules of one
document are a single projection over its front matter and the array of its headings: no join and
no shuffle, however many documents there are. Rules that relate files of a case (manifest, review,
optional sections, the report's title) are joins by case. Every rule gives issues (case_id, path,
code, detail); severity is always `error`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import front
from tallyloom.functions import texts as T
from tallyloom.operators import evidence
from tallyloom.operators.cuts import durable

# File names, contracts, fields, headings and vocabularies of cases.
CONTRACT_OF = {
    "identity.md": "identity",
    "base.md": "base_decision",
    "report.md": "final_report",
    "issues/contradictions.md": "contradiction_set",
    "findings/doc-claims.md": "finding_set",
    "findings/history-ai.md": "finding_set",
    "findings/cheat.md": "finding_set",
}
FINDING_OF = {"findings/doc-claims.md": "doc_claim", "findings/history-ai.md": "history_ai", "findings/cheat.md": "cheat"}
SECTION_OF = {"findings/doc-claims.md": "文档声明审查", "findings/history-ai.md": "开发历史与 AI 使用", "findings/cheat.md": "测评定向与结果真实性"}
FIELDS = {
    "base_decision": (
        "status",
        "target_review_ref",
        "target_review_commit",
        "selected_base_work_id",
        "selected_base_display_name",
        "selected_base_ref",
        "selected_base_commit",
        "target_introduction_commit",
        "target_introduction_kind",
        "direction",
        "confidence",
    ),
    "module_review": ("module_id", "status", "originality", "base_delta"),
    "finding_set": ("finding_type", "status", "public"),
    "contradiction_set": ("status",),
}
VALUES = {
    ("base_decision", "confidence"): ("high", "medium", "low"),
    ("module_review", "status"): ("implemented", "partial", "minimal", "absent"),
    ("module_review", "originality"): ("novel", "adapted_major", "adapted_minor", "inherited", "external", "uncertain"),
    ("module_review", "base_delta"): ("major", "minor", "none", "unclear"),
    ("finding_set", "status"): ("findings", "no_findings"),
    ("contradiction_set", "status"): ("none", "unresolved", "resolved"),
}
BASE_STATUS = ("accepted", "no_reliable_base")
OF_BASE = ("selected_base_work_id", "selected_base_display_name", "selected_base_ref", "selected_base_commit", "target_introduction_commit")
BASE_HASHES = ("target_review_commit", "selected_base_commit", "target_introduction_commit")
HEADINGS = {
    "base_decision": ("选中 Base", "证据覆盖", "未选候选", "方向判断", "Base 之后需要描述的模块"),
    "module_review": ("适用范围", "实现内容", "相对 Base 的变化", "真实工作量判断", "继承、外部依赖与缺失", "文档声明复核", "证据"),
    "contradiction_set": ("冲突清单", "仲裁结果", "待补事实"),
    "doc_claim": ("目标计划与开发过程", "架构与功能声明复核", "来源依赖与 AI 披露", "复现说明与待补材料", "结论"),
    "history_ai": ("提交与持续演进", "AI 使用披露", "生成内容与人工修改验证", "开发记录与贡献可追溯性", "结论"),
    "cheat": ("测试结果造假", "测例特征识别与输入硬编码", "非通用实现、语义与安全边界绕过", "需评委复核的实现", "结论"),
}
LINKED_SECTION = "需联动结论"
GRAPH_SECTION, MODULE_SECTION, EVIDENCE_SECTION = "内核架构图", "模块实现细节及 Base 差异", "证据索引"
REPORT_BEFORE = ("整体结论", "重点结论", "真实工作量分层", "Base、其他来源与同届传播关系", GRAPH_SECTION)
REPORT_AFTER = (MODULE_SECTION, EVIDENCE_SECTION)
REVIEW_SCHEMA = "contradiction_review.v1"  # the end of the schema name; what stands before it is the writer's
MATERIAL = ("identity.md", "base.md", "evidence.jsonl", "issues/contradictions.md")

#: A file with front matter: what stands between two lines that begin with three hyphens, and what follows the second.
FRONT = re.compile(r"---\n(?P<front>.*?)\n---[^\n]*(?:\n(?P<body>.*))?\Z", re.DOTALL)
REQUIRED_DOCUMENTS = ("identity.md", "base.md", "report.md")
_ISSUES = "array<struct<code:string,detail:string>>"


def marked(files: DataFrame) -> DataFrame:
    """A case's Markdown files."""
    return files.where(F.col("path").endswith(".md"))


def parsed(files: DataFrame) -> DataFrame:
    """(case_id, path, problem, contract, fields, public, body) of a case's Markdown files.

    `fields` holds every front matter key with its value as text; `public` is the value of that key
    where it is a YAML boolean; `problem` says why a file could not be read, and is empty otherwise.
    """

    def read(text: str) -> tuple[str, dict, str]:
        parts = FRONT.match(text)
        if not parts:
            return "", {}, text
        try:
            found = front.loaded(parts["front"].strip() or "{}")
        except Exception as error:  # a date that is none, nesting too deep, bad syntax: the document's own problem, not the job's
            return str(error).split("\n")[0] or "bad front matter", {}, ""
        return "", found if isinstance(found, dict) else {}, text if parts["body"] is None else parts["body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read(t or "") for t in batch.column(2).to_pylist()]
            fields = [[(str(k), _text(v)) for k, v in own.items()] for _, own, _ in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()),
                    batch.column(1).cast(pa.string()),
                    pa.array([p for p, _, _ in got], pa.string()),
                    pa.array([_text(own.get("contract", "")).strip() for _, own, _ in got], pa.string()),
                    pa.array(fields, pa.map_(pa.string(), pa.string())),
                    pa.array([own.get("public") if isinstance(own.get("public"), bool) else None for _, own, _ in got], pa.bool_()),
                    pa.array([b for _, _, b in got], pa.string()),
                ],
                ["case_id", "path", "problem", "contract", "fields", "public", "body"],
            )

    return marked(files).select("case_id", "path", "text").mapInArrow(run, "case_id string, path string, problem string, contract string, fields map<string,string>, public boolean, body string")


def _text(value) -> str:
    return str(value)


def in_case(docs: DataFrame) -> DataFrame:
    """The documents that a case is made of."""
    named = F.col("path").isin("identity.md", "base.md", "report.md", "issues/contradictions.md")
    return docs.where(named | F.col("path").rlike(r"^(modules|findings)/[^/]+\.md$"))


def _issue(code: str, test: Column, detail: Column | str = "") -> Column:
    """An array with the issue if the test holds."""
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(F.lit(code).alias("code"), text.alias("detail")))).otherwise(F.array().cast(_ISSUES))


def _each(code: str, details: Column) -> Column:
    """An issue for each of an array of details."""
    return F.transform(details, lambda x: F.struct(F.lit(code).alias("code"), x.alias("detail")))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _field(name: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit("")))


def headings(docs: DataFrame) -> DataFrame:
    """Add `heads`, an array of (line, level, title, body), each body up to the next heading of any level.

    With them come `titles`, those of all headings, and `h1` and `h2`, those of these levels: rules ask for them many
    times, and a lambda that made them would do so for each of its elements.
    """
    at = docs.withColumn("__lines", T.lines(F.col("body"))).withColumn("__heads", T.headings_of(F.col("__lines")))  # split once

    def head(x: Column, following: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["level"].alias("level"), F.trim(x["title"]).alias("title"), following.alias("until"))

    ends = F.concat(F.transform(F.slice("__heads", 2, F.greatest(F.size("__heads"), F.lit(1))), lambda x: x["line"]), F.array(F.size("__lines") + 1))
    at = at.withColumn("__heads", F.zip_with("__heads", F.slice(ends, 1, F.size("__heads")), head))
    own = F.transform(F.array("__lines"), lambda ls: F.transform("__heads", lambda x: F.struct(x["line"], x["level"], x["title"], F.array_join(F.slice(ls, x["line"] + 1, F.greatest(x["until"] - x["line"] - 1, F.lit(0))), "\n").alias("body"))))[0]
    at = at.withColumn("heads", own).drop("__lines", "__heads")
    of = lambda level: F.transform(F.filter("heads", lambda h: h["level"] == level), lambda h: h["title"])
    return at.withColumns({"titles": F.transform("heads", lambda h: h["title"]), "h1": of(1), "h2": of(2)})


def _titles(level: int) -> Column:
    return F.col(f"h{level}")


def _sections(required: tuple[str, ...], level: int | None = None) -> list[Column]:
    """Required headings that are missing, or there but without text in them or deeper headings below."""
    titles = F.col("titles")
    there = titles if level is None else _titles(level)
    missing = F.filter(_texts(required), lambda r: ~F.array_contains(there, r))

    def filled(r: Column) -> Column:
        at = F.array_position(titles, r).cast("int")
        deeper = F.coalesce(F.try_element_at("heads", at + 1)["level"] > F.element_at("heads", at)["level"], F.lit(False))
        return deeper | (F.btrim(F.element_at("heads", at)["body"], F.lit(" \t\r\n\x0b\x0c")) != "")

    empty = F.filter(_texts(required), lambda r: F.array_contains(there, r) & ~filled(r))
    return [_each("structure.missing_heading", missing), _each("structure.empty_heading", empty)]


def _order(required: tuple[str, ...]) -> Column:
    """Required second-level headings must rise; of equal titles the last counts."""
    line = lambda r: F.array_max(F.transform(F.filter("heads", lambda h: (h["level"] == 2) & (h["title"] == r)), lambda h: h["line"]))
    places = F.filter(F.transform(_texts(required), line), lambda p: p.isNotNull())
    return _issue("structure.heading_order", places != F.array_sort(places))


def _unknown(allowed: tuple[str, ...], code: str = "structure.unknown_h2") -> Column:
    return _each(code, F.filter(_titles(2), lambda t: ~t.isin(*allowed)))


def _ruled(required: tuple[str, ...], allowed: tuple[str, ...]) -> list[Column]:
    return [*_sections(required), _order(required), _unknown(allowed)]


def _fields(contract: str) -> Column:
    return _each("structure.missing_frontmatter", F.filter(_texts(FIELDS[contract]), lambda f: ~F.map_contains_key("fields", f)))


def _blank(names: tuple[str, ...]) -> Column:
    own = F.array(*[F.when(_field(n) == "", F.lit(n)) for n in names])
    return _each("structure.empty_frontmatter", F.array_compact(own))


def _values(contract: str) -> list[Column]:
    return [_issue("structure.invalid_enum", ~_field(f).isin(*allowed), F.concat(F.lit(f"{f}="), _field(f))) for (c, f), allowed in VALUES.items() if c == contract]


def _base() -> list[Column]:
    accepted, none = _field("status") == "accepted", _field("status") == "no_reliable_base"
    kind = _field("target_introduction_kind")
    out = [_fields("base_decision"), *_ruled(HEADINGS["base_decision"], HEADINGS["base_decision"]), *_values("base_decision")]
    out.append(_issue("structure.invalid_enum", ~_field("status").isin(*BASE_STATUS), F.concat(F.lit("status="), _field("status"))))
    for f in BASE_HASHES:
        needed = accepted | none if f == "target_review_commit" else accepted
        out.append(_issue("base.commit_missing", needed & ~_field(f).rlike(T.COMMIT), f))
    out.append(_issue("base.introduction_kind", (accepted & ~kind.isin("exact", "initial_visible")) | (none & (kind != "unknown")), kind))
    out += [_issue("base.unexpected_value", none & (_field(f) != ""), f) for f in OF_BASE]
    always = ("direction", "confidence")
    of_target = ("target_review_ref", "target_review_commit")
    blank = F.when(accepted, _blank((*of_target, *OF_BASE[:3], *always))).when(none, _blank((*of_target, *always))).otherwise(_blank(always))
    return [*out, blank]


def _module(taxonomy: dict[str, list[str]]) -> list[Column]:
    known, node = _field("module_id").isin(*taxonomy), r"^[a-z][a-z0-9-]*"
    named = F.transform(F.filter("heads", lambda h: (h["level"] == 3) & h["title"].rlike(T.NODE_HEADING)), lambda h: F.regexp_extract(h["title"], node, 0))
    nodes = F.create_map(*[x for m, own in taxonomy.items() for x in (F.lit(m), _texts(own))]) if taxonomy else F.create_map().cast("map<string,array<string>>")
    strange = F.filter(named, lambda n: ~F.array_contains(F.try_element_at(nodes, _field("module_id")), n))
    last = F.try_element_at(_titles(2), F.lit(-1))
    return [
        _fields("module_review"),
        *_ruled(HEADINGS["module_review"], (*HEADINGS["module_review"], LINKED_SECTION)),
        _issue("structure.optional_heading_order", F.array_contains(_titles(2), LINKED_SECTION) & (last != LINKED_SECTION), LINKED_SECTION),
        *_values("module_review"),
        _issue("taxonomy.unknown_module", ~known, _field("module_id")),
        F.when(known, _each("taxonomy.unknown_node", strange)).otherwise(F.array().cast(_ISSUES)),
    ]


def _finding() -> list[Column]:
    kind, public, status = _field("finding_type"), F.col("public"), _field("status")
    by_kind = F.array().cast(_ISSUES)
    for name in FINDING_OF.values():
        by_kind = F.when(kind == name, F.concat(*_ruled(HEADINGS[name], HEADINGS[name]))).otherwise(by_kind)
    wrong = public.isNull() | ((status == "no_findings") & public) | ((status == "findings") & ~public)
    return [
        _fields("finding_set"),
        *_values("finding_set"),
        _issue("structure.invalid_public", wrong, _field("public")),
        _issue("structure.unknown_finding_type", ~kind.isin(*FINDING_OF.values()), kind),
        by_kind,
    ]


def _report() -> list[Column]:
    optional = tuple(SECTION_OF.values())
    required, ordered = (*REPORT_BEFORE, *REPORT_AFTER), (*REPORT_BEFORE, *optional, *REPORT_AFTER)
    top = _titles(2)
    expected = F.filter(_texts(ordered), lambda t: F.array_contains(top, t))
    line = lambda title: F.array_min(F.transform(F.filter("heads", lambda h: (h["level"] == 2) & (h["title"] == title)), lambda h: h["line"]))
    begin, end = line(MODULE_SECTION), line(EVIDENCE_SECTION)
    within = F.exists("heads", lambda h: (h["level"] == 3) & (h["line"] > begin) & (h["line"] < end))
    return [
        _issue("structure.report_h1", F.size(_titles(1)) != 1, F.size(_titles(1))),
        *_sections(required, 2),
        _unknown(ordered, "structure.report_unknown_h2"),
        _issue("structure.report_heading_order", top != expected),
        _each("structure.heading_depth", F.transform(F.filter("heads", lambda h: h["level"] > 3), lambda h: h["title"])),
        _issue("structure.module_h3_missing", begin.isNotNull() & end.isNotNull() & ~within, MODULE_SECTION),
    ]


def _structure(taxonomy: dict[str, list[str]]) -> Column:
    contract = F.col("contract")
    h1 = _issue("structure.h1", F.size(_titles(1)) != 1, F.size(_titles(1)))
    of = {
        "base_decision": [h1, *_base()],
        "module_review": [h1, *_module(taxonomy)],
        "finding_set": [h1, *_finding()],
        "contradiction_set": [h1, _fields("contradiction_set"), *_values("contradiction_set"), *_ruled(HEADINGS["contradiction_set"], HEADINGS["contradiction_set"])],
        "final_report": [h1, *_report()],
    }
    out = F.when(contract == "", _issue("structure.missing_contract", F.lit(True))).when(contract == "identity", F.array().cast(_ISSUES))
    for name, found in of.items():
        out = out.when(contract == name, F.concat(*found))
    return out.otherwise(F.concat(h1, _issue("structure.unknown_contract", F.lit(True), contract)))


def _place() -> list[Column]:
    """Path, contract and name must agree."""
    path, contract = F.col("path"), F.col("contract")
    fixed = F.create_map(*[F.lit(x) for kv in CONTRACT_OF.items() for x in kv])
    finding = F.create_map(*[F.lit(x) for kv in FINDING_OF.items() for x in kv])
    outside, module = path.rlike(r"^(/|\.\./|\.\.$)"), path.rlike(r"^modules/[^/]+\.md$")
    wanted, kind = F.try_element_at(fixed, path), F.try_element_at(finding, path)
    singular = contract.isin(*CONTRACT_OF.values()) & ~F.coalesce(wanted == contract, F.lit(False))
    stem = F.regexp_extract(path, r"^modules/([^/]+)\.md$", 1)
    inside = [
        _issue("structure.contract_path_mismatch", wanted.isNotNull() & (contract != wanted), wanted),
        _issue("structure.invalid_output_path", singular, path),
        _issue("structure.finding_path_mismatch", kind.isNotNull() & ~F.coalesce(F.try_element_at("fields", F.lit("finding_type")) == kind, F.lit(False)), kind),
        _issue("structure.invalid_output_path", (contract == "module_review") & ~module, path),
        _issue("structure.contract_path_mismatch", module & (contract != "module_review"), F.lit("module_review")),
        _issue("structure.module_path_mismatch", module & ~F.coalesce(F.try_element_at("fields", F.lit("module_id")) == stem, F.lit(False)), stem),
    ]
    return [_issue("structure.output_outside_case", outside, path), F.when(~outside, F.concat(*inside)).otherwise(F.array().cast(_ISSUES))]


def _names() -> list[Column]:
    """The first platform id, and the first bare number used as a name, of any document but the identity."""
    own = F.col("contract") != "identity"
    fork, bare = (F.regexp_extract("body", p, 0) for p in (T.FORK_ID, T.BARE_SUFFIX))
    return [_issue("identity.platform_fork_leak", own & (fork != ""), fork), _issue("identity.bare_suffix_name", own & (bare != ""), bare)]


def _issues(rows: DataFrame, found: Column) -> DataFrame:
    each = rows.select("case_id", "path", F.explode(found).alias("i"))
    return each.select("case_id", "path", "i.code", F.coalesce("i.detail", F.lit("")).alias("detail"))


def document_issues(docs: DataFrame, taxonomy: dict[str, list[str]]) -> DataFrame:
    """Issues of each document by itself: structure, place and names, or that it can't be read; documents are passed over once."""
    bad = _issue("structure.parse_error", F.col("problem") != "", F.col("problem"))
    own = F.concat(_structure(taxonomy), *_place(), *_names())
    return _issues(headings(docs), F.when(F.col("problem") == "", own).otherwise(bad))


def presence(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """Documents (case_id, path) that every case must have, and at least one module."""
    wanted = cases.select("case_id", F.explode(_texts(REQUIRED_DOCUMENTS)).alias("path"))
    missing = wanted.join(docs.where(F.col("path").isin(*REQUIRED_DOCUMENTS)).select("case_id", "path"), ["case_id", "path"], "left_anti")
    modules = docs.where(F.col("path").rlike(r"^modules/[^/]+\.md$")).select("case_id").distinct()  # a row a case before it is dealt
    without = cases.select("case_id").join(modules, "case_id", "left_anti")
    out = missing.select("case_id", "path", F.lit("structure.missing_file").alias("code"), F.lit("").alias("detail"))
    return out.unionByName(without.select("case_id", F.lit("modules").alias("path"), F.lit("structure.missing_modules").alias("code"), F.lit("").alias("detail")))


_MANIFEST = "struct<repo:struct<review_branch:string,commit:string>>"


def base_lock(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Base documents against (case_id, text) manifests: there, readable, and of the same branch and commit."""
    own = docs.where("contract = 'base_decision' AND problem = ''").join(manifests.select("case_id", F.col("text").alias("__text")), "case_id", "left")
    own = own.withColumn("__at", F.from_json("__text", _MANIFEST, {"mode": "PERMISSIVE"})).withColumn("__fine", F.try_parse_json("__text").isNotNull())
    there, fine = F.col("__text").isNotNull(), F.col("__text").isNotNull() & F.col("__fine")
    locked = lambda c: F.trim(F.coalesce(F.col(f"__at.repo.{c}"), F.lit("")))
    found = [
        _issue("base.manifest_missing", ~there),
        _issue("base.manifest_invalid", there & ~fine),
        _issue("base.target_ref_mismatch", fine & (_field("target_review_ref") != locked("review_branch")), locked("review_branch")),
        _issue("base.target_commit_mismatch", fine & (_field("target_review_commit") != locked("commit")), locked("commit")),
    ]
    return _issues(own, F.concat(*found))


def material(files: DataFrame) -> DataFrame:
    """(case_id, files, digest): content hashes of what a review of contradictions rests on, by path, and their digest."""
    own = files.where(F.col("path").isin(*MATERIAL) | F.col("path").rlike(r"^(modules|findings)/[^/]+\.md$"))
    each = own.groupBy("case_id", "path").agg(F.min(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))  # a path given twice counts once
    hashed = each.select("case_id", F.struct("path", "sha").alias("f"))
    listed = hashed.groupBy("case_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    lines = F.array_join(F.transform("fs", lambda f: F.concat(f["path"], F.lit("\0"), f["sha"], F.lit("\n"))), "")
    return listed.select("case_id", F.map_from_entries("fs").alias("files"), F.sha2(lines, 256).alias("digest"))


_REVIEW = "struct<schema:string,status:string,files:map<string,string>,digest:string>"


def review_record(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, text): the JSON record that freezes what a resolved review rests on."""
    status = docs.where("path = 'issues/contradictions.md'").select("case_id", _field("status").alias("status"))
    held = material(files).join(status, "case_id")
    return held.select("case_id", F.to_json(F.struct(F.lit(REVIEW_SCHEMA).alias("schema"), "status", "files", "digest")).alias("text"))


def contradictions(files: DataFrame, docs: DataFrame, reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Whether each case's contradictions are settled, and by a review of the material as it is now."""
    path = "issues/contradictions.md"
    own = docs.where(F.col("path") == path).select("case_id", "problem", _field("status").alias("status"))
    at = cases.select("case_id").join(own, "case_id", "left").join(reviews.select("case_id", F.col("text").alias("review")), "case_id", "left")
    now = material(files)
    there = functools.reduce(lambda a, b: a & b, [F.map_contains_key("files", p) for p in MATERIAL])
    at = at.join(now.select("case_id", "files", F.col("digest").alias("now"), there.alias("whole")), "case_id", "left")
    at = at.withColumns({"r": F.from_json("review", _REVIEW, {"mode": "PERMISSIVE"}), "fine": F.try_parse_json("review").isNotNull(), "path": F.lit(path)})
    read = F.col("fine") & F.endswith(F.coalesce("r.schema", F.lit("")), F.lit(REVIEW_SCHEMA))
    same_status = F.coalesce(F.col("r.status") == F.col("status"), F.lit(False))
    recorded = F.coalesce(F.size("r.files") > 0, F.lit(False))
    entries = lambda c: F.array_sort(F.map_entries(c))
    fresh = F.coalesce((entries("r.files") == entries("files")) & (F.col("r.digest") == F.col("now")), F.lit(False))
    after = F.when(~F.coalesce("whole", F.lit(False)), _issue("contradiction.material_missing", F.lit(True)))
    after = after.when(~recorded, _issue("contradiction.review_invalid", F.lit(True), "files")).otherwise(_issue("contradiction.review_stale", ~fresh, "material"))
    found = (
        F.when(F.col("problem").isNull(), _issue("contradiction.missing", F.lit(True)))
        .when(F.col("problem") != "", F.array().cast(_ISSUES))
        .when(F.col("status") == "unresolved", _issue("contradiction.unresolved", F.lit(True)))
        .when(F.col("review").isNull(), _issue("contradiction.review_missing", F.lit(True)))
        .when(~F.coalesce(read, F.lit(False)), _issue("contradiction.review_invalid", F.lit(True), "schema"))
        .otherwise(F.concat(_issue("contradiction.review_stale", ~same_status, "status"), after))
    )
    return _issues(at, found)


def optional_sections(docs: DataFrame) -> DataFrame:
    """Public findings and the report's sections go together both ways, heading by heading."""
    report = headings(docs.where("path = 'report.md' AND problem = ''")).select("case_id", "path", _titles(2).alias("top"))
    pairs = F.array(*[F.struct(F.lit(p).alias("source"), F.lit(t).alias("title")) for p, t in SECTION_OF.items()])
    report = report.select("*", F.explode(pairs).alias("w")).select("case_id", "path", "top", "w.source", "w.title")
    public = (_field("status") == "findings") & (F.lower(F.coalesce(F.try_element_at("fields", F.lit("public")), F.lit("true"))) != "false")
    finding = docs.select("case_id", F.col("path").alias("source"), F.col("problem"), public.alias("shown"))
    at = report.join(finding, ["case_id", "source"], "left")
    there, section, read = F.col("problem").isNotNull(), F.array_contains("top", F.col("title")), F.col("problem") == ""
    found = [
        _issue("optional_section.without_source", ~there & section, F.col("title")),
        _issue("optional_section.missing_public", read & F.col("shown") & ~section, F.col("title")),
        _issue("optional_section.hidden_leak", read & ~F.col("shown") & section, F.col("title")),
    ]
    return _issues(at, F.concat(*found))


def architecture_graph(docs: DataFrame) -> DataFrame:
    """The report's architecture section holds exactly one diagram, not an empty one, before its next heading."""
    report = headings(docs.where("path = 'report.md' AND problem = ''"))
    first = F.try_element_at(F.filter("heads", lambda h: h["title"] == GRAPH_SECTION), F.lit(1))["body"]
    blocks = F.regexp_extract_all(F.coalesce(first, F.lit("")), F.lit(T.MERMAID), F.lit(1))
    none = (F.size(blocks) == 0) | (F.btrim(F.try_element_at(blocks, F.lit(1)), F.lit(" \t\r\n")) == "")
    found = [_issue("architecture_graph.missing_mermaid", none, GRAPH_SECTION), _issue("architecture_graph.multiple_mermaid", ~none & (F.size(blocks) > 1), GRAPH_SECTION)]
    return _issues(report, F.concat(*found))


def report_title(docs: DataFrame) -> DataFrame:
    """The top heading of a report holds the display name that the case's identity gives."""
    named = docs.where("contract = 'identity' AND problem = ''").groupBy("case_id").agg(F.min_by(_field("display_name"), "path").alias("display_name"))
    report = headings(docs.where("contract = 'final_report' AND problem = ''")).join(named, "case_id")
    title = F.coalesce(F.try_element_at(_titles(1), F.lit(1)), F.lit(""))
    return _issues(report, _issue("identity.report_title", (F.col("display_name") != "") & ~F.contains(title, F.col("display_name")), title))


def evidence_issues(docs: DataFrame, cards: DataFrame) -> DataFrame:
    """Bad cards (case_id, evidence_id, problem) and citations of cards that a case's log lacks; a log with a bad card counts as empty."""
    bad = cards.where("problem <> ''")
    invalid = bad.groupBy("case_id").agg(F.min(F.struct("evidence_id", "problem")).alias("b"))
    invalid = invalid.select("case_id", F.lit("evidence.jsonl").alias("path"), F.lit("evidence.invalid").alias("code"), F.concat_ws(" ", "b.evidence_id", "b.problem").alias("detail"))
    fine = cards.join(bad.select("case_id"), "case_id", "left_anti").select("case_id", "evidence_id")
    cites = docs.where("problem = ''").select("case_id", "path", F.explode(T.references(F.col("body"))).alias("evidence_id"))
    unknown = cites.join(fine, ["case_id", "evidence_id"], "left_anti")
    return invalid.unionByName(unknown.select("case_id", "path", F.lit("evidence.unknown_ref").alias("code"), F.col("evidence_id").alias("detail")))


def log_cards(files: DataFrame, form: str) -> DataFrame:
    """(case_id, evidence_id, problem) of every line of the cases' evidence logs; a line that is no card is a problem too."""
    lines = files.where("path = 'evidence.jsonl'").select("case_id", F.explode(T.lines(F.col("text"))).alias("line")).where(F.trim("line") != "")
    read = lines.select("case_id", F.try_parse_json("line").isNotNull().alias("fine"), F.from_json("line", form, {"mode": "PERMISSIVE"}).alias("c"))
    flat = read.select("case_id", "fine", "c.*").withColumn("source_name", F.coalesce("source.display_name", F.lit("")))
    flat = flat.withColumns({c: F.coalesce(c, F.lit("")) for c in ("evidence_id", "kind", "title")})
    raw = F.col("raw_ref").isNotNull() & ((F.coalesce("raw_ref.path", F.lit("")) == "") | (F.coalesce("raw_ref.sha256", F.lit("")) == ""))
    again = evidence.validated(flat).select("case_id", "evidence_id", F.when(~F.col("fine"), "json").when(F.col("problem") != "", F.col("problem")).when(raw, "raw_ref").otherwise("").alias("problem"))
    counted = again.groupBy("case_id", "evidence_id").agg(F.count(F.lit(1)).alias("n"), F.max("problem").alias("problem"))
    return counted.select("case_id", "evidence_id", F.when(F.col("problem") != "", F.col("problem")).when(F.col("n") > 1, "duplicate").otherwise("").alias("problem"))


def case_issues(files: DataFrame, manifests: DataFrame, reviews: DataFrame, taxonomy: dict[str, list[str]], card_form: str, path: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """All issues of cases given by their files (case_id, path, text), or those of one document of each.

    `manifests` and `reviews` hold (case_id, text), the JSON a case keeps beside its documents. `docs` are
    the parsed documents (`in_case`, a written table) where the caller has them.
    """
    docs = durable(in_case(parsed(files)), "documents") if docs is None else docs  # every family reads the parsed documents
    cases = files.select("case_id").distinct()
    cards = log_cards(files, card_form)
    if path is not None:
        docs = docs.where(F.col("path") == path)
        absent = cases.join(docs, "case_id", "left_anti").select("case_id", F.lit(path).alias("path"), F.lit("structure.missing_file").alias("code"), F.lit("").alias("detail"))
        parts = [absent, document_issues(docs, taxonomy), base_lock(docs, manifests), evidence_issues(docs, cards)]
        return functools.reduce(DataFrame.unionByName, parts)
    parts = [
        presence(docs, cases),
        document_issues(docs, taxonomy),
        base_lock(docs, manifests),
        evidence_issues(docs, cards),
        report_title(docs),
        contradictions(files, docs, reviews, cases),
        optional_sections(docs),
        architecture_graph(docs),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def unknown_works(asked: DataFrame, works: DataFrame) -> DataFrame:
    """Issues for asked works (work_id) that the registry lacks."""
    none = asked.select("work_id").distinct().join(works.select("work_id"), "work_id", "left_anti")
    return none.select(F.col("work_id").alias("case_id"), F.lit("").alias("path"), F.lit("identity.unknown_work").alias("code"), F.col("work_id").alias("detail"))


def repositories(works: DataFrame, states: DataFrame) -> DataFrame:
    """Issues of works whose directory (work_id, there, has_git) is missing or holds no repository."""
    at = works.select(F.col("work_id").alias("case_id"), F.col("canonical_dir").alias("path"), "work_id").join(states, "work_id", "left")
    there = F.coalesce("there", F.lit(False))
    return _issues(at, F.concat(_issue("identity.repo_missing", ~there), _issue("identity.not_git_repo", there & ~F.coalesce("has_git", F.lit(False)))))


def without_manifest(cases: DataFrame, manifests: DataFrame) -> DataFrame:
    """Issues of cases that were never begun."""
    none = cases.select("case_id").distinct().join(manifests.select("case_id"), "case_id", "left_anti")
    return none.select("case_id", F.lit("case_state/manifest.json").alias("path"), F.lit("case.manifest_missing").alias("code"), F.lit("").alias("detail"))


def check_failed(case_id: str, error: Exception, like: DataFrame) -> DataFrame:
    """The issue that building a case's report gave up with an error."""
    return like.sparkSession.createDataFrame([(case_id, "", "case.check_all_failed", str(error))], "case_id string, path string, code string, detail string")
